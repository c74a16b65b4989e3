"""Values or an error: the strict counterparts of columns that are null or findings where a file is wrong.

An error ends the query with the file and what is wrong with it, through Spark's own ``raise_error``. It is a filter, so that no later
choice of columns leaves the check out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import quoted, valid_id
from .validate import filled, text

# Keys that every concept must have (fixed values).
REQUIRED_KEYS = ("type",)


def missing_keys() -> Column:
    """Required keys that a concept lacks, has without a value, or has with one of the wrong shape."""
    lacks = lambda k: ~filled(k) | (text(k).isNull() if k == "type" else F.lit(False))
    return F.array_compact(F.array(*(F.when(F.coalesce(lacks(k), F.lit(True)), F.lit(k)) for k in REQUIRED_KEYS)))


def document_error() -> Column:
    """What is wrong with a concept as a document, null if nothing is."""
    return F.when(F.size(missing_keys()) > 0, F.concat(F.lit("Missing required frontmatter keys: "), F.array_join(missing_keys(), ", ")))


def _or_fail(df: DataFrame, message: Column) -> DataFrame:
    return df.where(F.when(message.isNotNull(), F.raise_error(message).cast("boolean")).otherwise(True))


def parsed_or_fail(rows: DataFrame) -> DataFrame:
    """Parsed rows; a concept that cannot be read ends the query with its path and the error."""
    return _or_fail(rows, F.when((F.col("role") == "concept") & F.col("error").isNotNull(), F.concat("rel_path", F.lit(": "), "error")))


def valid_or_fail(concepts: DataFrame) -> DataFrame:
    """Concepts; one without its required keys ends the query."""
    return _or_fail(concepts, F.concat(F.col("rel_path"), F.lit(": "), document_error()))


def moment_or_fail(column: Column | str, parsed: Column | str) -> Column:
    """``parsed`` where it has a value; a text in ``column`` without one ends the query."""
    column, parsed = (F.col(c) if isinstance(c, str) else c for c in (column, parsed))
    wrong = F.concat(F.lit("not an ISO-8601 date/datetime: "), quoted(column))
    return F.when(column.isNotNull() & parsed.isNull(), F.raise_error(wrong)).otherwise(parsed)


def id_or_fail(segments: Column) -> Column:
    """Segments of a concept id; such as make none end the query."""
    return F.coalesce(valid_id(segments), F.raise_error(F.concat(F.lit("invalid concept id: "), quoted(F.array_join(segments, "/")))).cast("array<string>"))
