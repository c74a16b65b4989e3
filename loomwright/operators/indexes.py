"""Directory indexes, built from the deepest folders up."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import markdown_escaped, percent_encoded


def directories(files: DataFrame) -> DataFrame:
    """``bundle, dir, dir_segs, depth``: every folder above a markdown file, the root (empty) included."""
    segs = F.split("rel_path", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(segs) - 1), lambda n: F.slice(segs, F.lit(1), n))
    md = files.where(F.col("rel_path").rlike(r"(?s)(^|/)[^/]+\.md\z")).select("bundle", F.explode(ups).alias("dir_segs")).distinct()
    return md.select("bundle", F.array_join("dir_segs", "/").alias("dir"), "dir_segs", F.size("dir_segs").alias("depth"))


def subdirectories(files: DataFrame) -> DataFrame:
    """``bundle, dir, name, child``: each folder in its parent, with or without markdown."""
    segs = F.split("rel_path", "/")
    ups = F.when(F.size(segs) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(segs) - 1, F.lit(1))), lambda n: F.slice(segs, F.lit(1), n)))
    each = files.select("bundle", F.explode(ups).alias("s")).distinct()
    return each.select("bundle", F.array_join(F.slice("s", F.lit(1), F.size("s") - 1), "/").alias("dir"), F.element_at("s", -1).alias("name"), F.array_join("s", "/").alias("child"))


def file_rows(rows: DataFrame) -> DataFrame:
    """``bundle, dir, type, title, link, description, name`` of each document an index lists; change logs count too."""
    name = F.element_at("path_segs", -1)
    own = lambda k: F.try_element_at("node", F.lit(k))["text"]
    stem = F.regexp_replace(name, r"\.md$", "")
    return rows.where("role <> 'index' and error is null").select(
        "bundle",
        F.array_join(F.slice("path_segs", F.lit(1), F.size("path_segs") - 1), "/").alias("dir"),
        F.coalesce(own("type"), F.lit("")).alias("type"),
        F.coalesce(F.nullif(own("title"), F.lit("")), stem).alias("title"),
        percent_encoded(name).alias("link"),
        F.coalesce(own("description"), F.lit("")).alias("description"),
        name.alias("name"),
    )


def default_description(titles: Column, n: Column) -> Column:
    shown = F.array_join(F.filter(titles, lambda t: t != ""), ", ")
    return F.format_string("Contains %d entries: %s.", n, F.when(shown == "", "no titled entries").otherwise(shown))


def entries(rows: DataFrame, files: DataFrame, synthesize: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """Rows of every index. One step for each depth: a folder's row in its parent carries a description made of
    the folder's own rows, so depths follow one another; folders of one depth are one job.

    ``synthesize(titles, descriptions, n)`` gives a folder's description as a column.
    """
    dirs, subs, docs = directories(files), subdirectories(files), file_rows(rows)
    deepest = dirs.agg(F.max("depth")).first()[0] or 0
    described = dirs.where("false").select("bundle", F.col("dir").alias("child"), F.lit("").alias("about"))
    made = []
    for depth in range(deepest, -1, -1):
        level = dirs.where(F.col("depth") == depth).select("bundle", "dir")
        folders = subs.join(level, ["bundle", "dir"], "left_semi").join(described, ["bundle", "child"], "left")
        folders = folders.select("bundle", "dir", F.lit("Subdirectories").alias("type"), F.col("name").alias("title"), F.concat(percent_encoded(F.col("name")), F.lit("/index.md")).alias("link"), F.coalesce("about", F.lit("")).alias("description"), "name")
        own = docs.join(level, ["bundle", "dir"], "left_semi").unionByName(folders)
        made.append(own)
        listed = own.groupBy("bundle", "dir").agg(F.sort_array(F.collect_list(F.struct("name", "title", "description"))).alias("x"), F.count("*").alias("n"))
        text = (synthesize or (lambda titles, _, n: default_description(titles, n)))(F.col("x.title"), F.col("x.description"), F.col("n"))
        about = F.when((F.col("n") == 1) & (F.col("x")[0]["description"] != ""), F.col("x")[0]["description"]).otherwise(text)
        now = listed.where("dir <> ''").select("bundle", F.col("dir").alias("child"), about.alias("about"))
        described = described.unionByName(now)
    return reduce(DataFrame.unionByName, made)


def texts(index_entries: DataFrame, rows: DataFrame) -> DataFrame:
    """``bundle, rel_path, content``: each index as written. The root keeps the version it declares."""
    line = F.concat(F.lit("* ["), markdown_escaped(F.col("title")), F.lit("]("), F.col("link"), F.lit(")"), F.when(F.col("description") != "", F.concat(F.lit(" - "), markdown_escaped(F.col("description")))).otherwise(""))
    typed = index_entries.withColumn("type", F.when(F.col("type") == "", "Other").otherwise(F.col("type"))).withColumn("line", line)
    groups = typed.groupBy("bundle", "dir", "type").agg(F.sort_array(F.collect_list(F.struct(F.lower("title").alias("t"), "name", "line"))).alias("x"))
    groups = groups.withColumn("g", F.concat(F.lit("# "), markdown_escaped(F.col("type")), F.lit("\n\n"), F.array_join(F.col("x.line"), "\n")))
    pages = groups.groupBy("bundle", "dir").agg(F.sort_array(F.collect_list(F.struct("type", "g"))).alias("x"))
    pages = pages.withColumn("body", F.concat(F.array_join(F.col("x.g"), "\n\n"), F.lit("\n")))
    kept = rows.where("role = 'index' and size(path_segs) = 1 and error is null").select("bundle", F.get(F.filter("fm", lambda e: e["is_text"] & (e["key"] == "okf_version")), F.lit(0))["yaml"].alias("version"), F.lit("").alias("dir")).where("version is not null")
    pages = pages.join(kept, ["bundle", "dir"], "left")
    head = F.when(F.col("version").isNotNull(), F.concat(F.lit("---\nokf_version: "), "version", F.lit("\n---\n\n"))).otherwise("")
    return pages.select("bundle", F.when(F.col("dir") == "", "index.md").otherwise(F.concat("dir", F.lit("/index.md"))).alias("rel_path"), F.concat(head, "body").alias("content"))


def index_text(entries_of_one: list[tuple[str, str, str, str]]) -> str:
    """Index of a few (type, title, link, description) rows without Spark, links encoded."""
    from urllib.parse import quote

    clean = lambda t: "".join(" " if c in "\n\r" else "\\" + c if c in "\\[]<>&" else c for c in t)
    groups: dict[str, list] = {}
    for kind, title, link, about in entries_of_one:
        groups.setdefault(kind or "Other", []).append((title, link, about))
    parts = []
    for kind in sorted(groups):
        lines = [f"* [{clean(t)}]({quote(u, safe='/~')}){' - ' + clean(d) if d else ''}" for t, u, d in sorted(groups[kind], key=lambda e: e[0].lower())]
        parts.append(f"# {clean(kind)}\n\n" + "\n".join(lines))
    return "\n\n".join(parts) + "\n"


