"""Change logs as rows, and their structural rules as windows over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import once, quoted, strict_date, trimmed
from .ordering import written


def _line(line: Column) -> Column:
    def told(t: Column) -> Column:
        kind = F.when(t == "", "blank").when(t.startswith("## "), "date").when(t.startswith("# "), "title").when(t.rlike("^[*-] "), "bullet").otherwise("other")
        # a heading or bullet without text is cut to its sign, which is none of the three
        rest = F.when(t.startswith("## "), trimmed(F.substr(t, F.lit(4)))).when(t.startswith("# ") | t.rlike("^[*-] "), trimmed(F.substr(t, F.lit(3))))
        return F.struct(line.alias("line"), kind.alias("kind"), rest.alias("rest"))

    return once(F.regexp_replace(F.regexp_replace(line, r"^\s+", ""), r"\s+$", ""), told)


def lines(logs: DataFrame) -> DataFrame:
    """``bundle, rel_path, path_segs, no, line, kind, rest``; kind is date, title, bullet, blank or other."""
    # what a line is stands beside it before lines become rows: then no later filter or column works it out again
    told = F.transform(F.split("text", "\n", -1), lambda x: F.struct((x == "").alias("none"), once(F.regexp_replace(x, "\r$", ""), _line).alias("own")))
    each = logs.where("utf8_ok").select("bundle", "rel_path", "path_segs", F.posexplode(told).alias("no", "l"), F.size(F.split("text", "\n", -1)).alias("n"))
    return each.where("not (no = n - 1 and l.none)").select("bundle", "rel_path", "path_segs", (F.col("no") + 1).alias("no"), "l.own.line", "l.own.kind", "l.own.rest")


def _file():
    return Window.partitionBy("bundle", "rel_path").orderBy("no")


def days(log_lines: DataFrame) -> DataFrame:
    """A row for each date heading: its number, text, parsed date and number of entries."""
    heads = log_lines.where("kind in ('date', 'bullet')").withColumn("day", F.count_if(F.col("kind") == "date").over(_file()))
    return heads.where("day > 0").groupBy("bundle", "rel_path", "path_segs", "day").agg(
        F.min_by("rest", "no").alias("date_text"), F.count_if(F.col("kind") == "bullet").alias("n_entries")
    ).withColumn("date", strict_date(F.col("date_text")))


def entries(log_lines: DataFrame) -> DataFrame:
    """A row for each bullet under a date: ``day, date_text, pos, kind, text``; kind is what stands in bold before it."""
    w = _file()
    rows = log_lines.where("kind in ('date', 'bullet')").withColumn("day", F.count_if(F.col("kind") == "date").over(w))
    rows = rows.withColumn("date_text", F.last(F.when(F.col("kind") == "date", F.col("rest")), ignorenulls=True).over(w)).where("kind = 'bullet' and day > 0")
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("bundle", "rel_path", "day").orderBy("no")))
    bold = F.regexp_extract("rest", r"(?s)^\*\*(.*?)\*\*\s*:?\s*(.*)$", 1)
    has = F.col("rest").rlike(r"(?s)^\*\*.*?\*\*")
    return rows.select(
        "bundle", "rel_path", "day", "date_text", "pos",
        F.when(has, trimmed(bold)).alias("kind"),
        F.when(has, F.regexp_extract("rest", r"(?s)^\*\*(.*?)\*\*\s*:?\s*(.*)$", 2)).otherwise(F.col("rest")).alias("text"),
    )


def titles(log_lines: DataFrame) -> DataFrame:
    """The first title of each log that stands before any date."""
    rows = log_lines.where("kind in ('date', 'title')").groupBy("bundle", "rel_path").agg(F.min_by(F.struct("kind", "rest"), "no").alias("f"))
    return rows.select("bundle", "rel_path", F.when(F.col("f.kind") == "title", F.col("f.rest")).alias("title"))


def out_of_order(log_days: DataFrame) -> DataFrame:
    """Dates that are newer than the date before them."""
    w = Window.partitionBy("bundle", "rel_path").orderBy("day")
    dated = log_days.where("date is not null").withColumn("before", F.lag(F.struct("date", "date_text")).over(w))
    return dated.where("date > before.date").select("bundle", "rel_path", "path_segs", "day", "date_text", F.col("before.date_text").alias("before"))


def problems(logs: DataFrame) -> DataFrame:
    """``bundle, rel_path, path_segs, phase, item, message`` of every structural rule a log breaks, in report order."""
    rows = written(lines(logs))  # lines are read by several windows
    per_day = days(rows)
    base = ["bundle", "rel_path", "path_segs"]
    none = logs.where("utf8_ok").select(*base).join(per_day.select("bundle", "rel_path").distinct(), ["bundle", "rel_path"], "left_anti")
    found = none.select(*base, F.lit(0).alias("phase"), F.lit(0).alias("item"), F.lit("log contains no date groups").alias("message"))
    empty = per_day.where("n_entries = 0").select(*base, F.lit(1).alias("phase"), F.col("day").cast("int").alias("item"), F.concat(F.lit("log date group "), quoted(F.col("date_text")), F.lit(" has no entries")).alias("message"))
    order = out_of_order(per_day).select(*base, F.lit(2).alias("phase"), F.col("day").cast("int").alias("item"), F.concat(F.lit("log date groups are not newest first: "), quoted(F.col("date_text")), F.lit(" follows "), quoted(F.col("before"))).alias("message"))
    before = Window.partitionBy("bundle", "rel_path").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("saw_date", F.coalesce(F.max(F.col("kind") == "date").over(before), F.lit(False)))
    seen = seen.withColumn("saw_title", F.coalesce(F.max((F.col("kind") == "title") & ~F.col("saw_date")).over(before), F.lit(False)))
    seen = seen.withColumn("last", F.last(F.when(F.col("kind").isin("date", "bullet"), F.col("kind")), ignorenulls=True).over(before))
    continues = F.col("saw_date") & F.coalesce(F.col("last") == "bullet", F.lit(False)) & F.col("line").rlike(r"^\s")
    at = F.concat(F.lit(" at line "), F.col("no").cast("string"))
    message = (
        F.when((F.col("kind") == "title") & (F.col("saw_date") | F.col("saw_title")), F.concat(F.lit("log contains non-log content"), at))
        .when((F.col("kind") == "bullet") & ~F.col("saw_date"), F.concat(F.lit("log contains an entry outside a date group"), at))
        .when((F.col("kind") == "other") & ~continues, F.concat(F.lit("log contains non-log content"), at))
    )
    line = seen.withColumn("message", message).where("message is not null").select(*base, F.lit(3).alias("phase"), F.col("no").alias("item"), "message")
    wrong = per_day.where("date is null").select(*base, F.lit(4).alias("phase"), F.col("day").cast("int").alias("item"), F.concat(F.lit("log date heading is not ISO-8601 `YYYY-MM-DD`: "), quoted(F.col("date_text"))).alias("message"))
    return found.unionByName(empty).unionByName(order).unionByName(line).unionByName(wrong)


def to_markdown(logs: DataFrame) -> DataFrame:
    """``bundle, rel_path, markdown``: each log written out again from its rows."""
    rows = written(lines(logs))
    bullets = entries(rows).withColumn("line", F.concat(F.lit("* "), F.when(F.col("kind").isNotNull(), F.concat(F.lit("**"), "kind", F.lit("**: "))).otherwise(""), "text"))
    bullets = bullets.groupBy("bundle", "rel_path", "day").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("b"))
    groups = days(rows).join(bullets, ["bundle", "rel_path", "day"], "left")
    group = F.array_join(F.concat(F.array(F.concat(F.lit("## "), "date_text")), F.coalesce(F.col("b.line"), F.array().cast("array<string>"))), "\n")
    groups = groups.select("bundle", "rel_path", "day", F.concat(group, F.lit("\n")).alias("g")).groupBy("bundle", "rel_path").agg(F.sort_array(F.collect_list(F.struct("day", "g"))).alias("g"))
    out = logs.where("utf8_ok").select("bundle", "rel_path").join(titles(rows), ["bundle", "rel_path"], "left").join(groups, ["bundle", "rel_path"], "left")
    head = F.when(F.col("title").isNotNull(), F.concat(F.lit("# "), "title", F.lit("\n\n"))).otherwise("")
    return out.select("bundle", "rel_path", F.concat(head, F.coalesce(F.array_join(F.col("g.g"), "\n"), F.lit(""))).alias("markdown"))
