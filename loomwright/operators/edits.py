"""Frontmatter that can be changed: keys set, removed and renamed as column expressions, and documents written out again.

The entries of a document are an array in the order of its keys; each has the key, whether that is a text, the kind of its value and
the value in its normal form. Keys are looked up among the text ones, and of repeated ones the first counts. A key that is set keeps its
place if it is there, and comes last if not.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import yaml_subset as yaml

_ENTRY = "struct<key:string,is_text:boolean,kind:string,yaml:string>"


def entries(fm: Column | str = "fm") -> Column:
    """The entries of parsed documents, from their column ``fm``."""
    return F.transform(fm, lambda e: F.struct(e["key"], e["is_text"], e["kind"], e["yaml"]))


def keys(own: Column) -> Column:
    """Text keys in order."""
    return F.transform(F.filter(own, lambda e: e["is_text"]), lambda e: e["key"])


def _place(own: Column, key: str) -> Column:
    """Place of a text key from zero, null if it is not there."""
    at = F.filter(F.transform(own, lambda e, i: F.when(e["is_text"] & (e["key"] == key), i)), lambda i: i.isNotNull())
    return F.get(at, F.lit(0))


def contains(own: Column, key: str) -> Column:
    return _place(own, key).isNotNull()


def get(own: Column, key: str) -> Column:
    """A key's value in normal form, null if it is not there."""
    return F.get(own, _place(own, key))["yaml"]


def _python(value):
    if isinstance(value, dict) or hasattr(value, "asDict"):
        items = value.items() if isinstance(value, dict) else value.asDict().items()
        return yaml.Pairs([(k, _python(v)) for k, v in items])
    if value is None or isinstance(value, (str, bool, int, float)):
        return value
    if hasattr(value, "tolist"):
        return _python(value.tolist())
    return [_python(v) for v in value] if isinstance(value, (list, tuple)) else str(value)


@F.pandas_udf(T.StructType([T.StructField("kind", T.StringType()), T.StructField("yaml", T.StringType())]))
def _value(values: pd.Series) -> pd.DataFrame:
    made = [None if v is None or v is pd.NaT else _python(v) for v in values]
    return pd.DataFrame({"kind": [yaml.kind_of(v) for v in made], "yaml": [yaml.emit(v).strip("\n") for v in made]})


def value_of(column: Column | str) -> Column:
    """A column of texts, numbers, truth values or arrays of those as frontmatter values."""
    return _value(column)


def _with(own: Column, change, *more: Column) -> Column:
    """``change`` of the entries and further values, each of which is worked out once however often it is used there (and may be
    made in Python, which the functions of array elements can't call)."""
    held = F.array(F.struct(own.alias("c0"), *(m.alias(f"c{i + 1}") for i, m in enumerate(more))))
    return F.get(F.transform(held, lambda s: change(*(s[f"c{i}"] for i in range(len(more) + 1)))), F.lit(0))


def set_value(own: Column, key: str, value: Column) -> Column:
    """The entries with ``key`` at ``value`` (of ``value_of``)."""

    def change(own: Column, value: Column) -> Column:
        new = F.struct(F.lit(key).alias("key"), F.lit(True).alias("is_text"), value["kind"].alias("kind"), value["yaml"].alias("yaml")).cast(_ENTRY)
        at = F.coalesce(_place(own, key), F.size(own))
        return F.concat(F.slice(own, F.lit(1), at), F.array(new), F.slice(own, at + 2, F.size(own)))

    return _with(_plain(own), change, value)


def remove(own: Column, key: str) -> Column:
    def change(own: Column) -> Column:
        at = F.coalesce(_place(own, key), F.size(own))
        return F.concat(F.slice(own, F.lit(1), at), F.slice(own, at + 2, F.size(own)))

    return _with(_plain(own), change)


def rename(own: Column, old: str, new: str) -> Column:
    """The entries with another name for a key. Where ``new`` is there already, both stay, and the first counts."""

    def change(own: Column) -> Column:
        at = F.coalesce(_place(own, old), F.size(own))
        name = lambda e: F.struct(F.lit(new).alias("key"), e["is_text"].alias("is_text"), e["kind"].alias("kind"), e["yaml"].alias("yaml")).cast(_ENTRY)
        return F.concat(F.slice(own, F.lit(1), at), F.transform(F.slice(own, at + 1, F.lit(1)), name), F.slice(own, at + 2, F.size(own)))

    return _with(_plain(own), change)


def _plain(own: Column) -> Column:
    return own.cast(f"array<{_ENTRY}>")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _written_keys(every: pd.Series) -> pd.Series:
    return pd.Series([[yaml._key(k) for k in own] for own in every], dtype=object)


def document(own: Column, body: Column | str = "body") -> Column:
    """The text of a document with these entries, in normal form."""
    body = F.col(body) if isinstance(body, str) else body
    nested = lambda e: e["kind"].isin("list", "map") & ~e["yaml"].isin("[]", "{}")

    def line(e: Column, k: Column) -> Column:
        name = F.when(e["is_text"], k).otherwise(e["key"])
        return F.when(nested(e), F.concat(name, F.lit(":\n  "), F.replace(e["yaml"], F.lit("\n"), F.lit("\n  ")))).otherwise(F.concat(name, F.lit(": "), e["yaml"]))

    front = _with(own, lambda own, names: F.when(F.size(own) == 0, F.lit("{}")).otherwise(F.array_join(F.zip_with(own, names, line), "\n")), _written_keys(F.transform(own, lambda e: e["key"])))
    return F.concat(F.lit("---\n"), front, F.lit("\n---\n\n"), body, F.when(F.endswith(body, F.lit("\n")), "").otherwise("\n"))
