"""The two graphs of a bundle as edge tables: cross-links, and derivations through sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import field_paths, link_ids, link_kind, once, valid_id, without_anchor


def raw_links(concepts: DataFrame) -> DataFrame:
    """``bundle, src_id, src_segs, src_path, seq, text, raw, kind, candidates``: a row for each inline link."""
    each = concepts.select("bundle", F.col("id").alias("src_id"), F.col("id_segs").alias("src_segs"), F.col("path_segs").alias("src_path"), F.posexplode("links").alias("seq", "link"))
    return each.select(
        "bundle", "src_id", "src_segs", "src_path", "seq", F.col("link.text").alias("text"), F.col("link.raw").alias("raw"), link_kind(F.col("link.raw")).alias("kind"),
        _readings(F.col("src_segs")).alias("candidates"),
    )


def _readings(source: Column) -> Column:
    """The ids that ``link`` of a file can mean, the plain reading first."""

    def read(kind: Column) -> Column:
        plain = link_ids(without_anchor(F.col("link.raw")), kind, source)
        decoded = F.when(F.col("link.decoded").isNotNull(), link_ids(F.col("link.decoded"), kind, source))
        return F.array_distinct(F.array_compact(F.array(plain, decoded)))

    return once(link_kind(F.col("link.raw")), read)


def ids(concepts: DataFrame) -> DataFrame:
    return concepts.select("bundle", "id").distinct()


def first_existing(rows: DataFrame, keys: list[str], candidates: str, concepts: DataFrame) -> DataFrame:
    """For each row the first candidate that is a concept: ``target_segs, exists``; without one, the first candidate.

    Rows have one candidate as a rule and take one equi-join; only those with more are exploded and joined back.
    """
    known = ids(concepts).select(F.col("bundle").alias("known_bundle"), F.col("id").alias("known_id"))
    on = lambda c: (F.col("bundle") == F.col("known_bundle")) & (c == F.col("known_id"))
    one = rows.where(F.size(candidates) == 1).withColumn("target_segs", F.col(candidates)[0]).withColumn("target_id", F.array_join("target_segs", "/"))
    one = one.join(known, on(F.col("target_id")), "left").withColumn("exists", F.col("known_id").isNotNull()).drop("known_bundle", "known_id", "target_id")
    many = rows.where(F.size(candidates) > 1)
    tried = many.select(*keys, F.posexplode(candidates).alias("pos", "c")).withColumn("cid", F.array_join("c", "/"))
    tried = tried.join(known, on(F.col("cid")), "left").withColumn("missing", F.col("known_id").isNull())
    best = tried.groupBy(*keys).agg(F.min_by(F.struct(F.col("c").alias("target_segs"), (~F.col("missing")).alias("exists")), F.struct("missing", "pos")).alias("best"))
    many = many.join(best, keys).withColumn("target_segs", F.col("best.target_segs")).withColumn("exists", F.col("best.exists")).drop("best")
    return one.unionByName(many)


def links(raw: DataFrame, concepts: DataFrame) -> DataFrame:
    """Resolved links: those with no candidate are dropped, the rest exist or are broken."""
    found = first_existing(raw, ["bundle", "src_id", "seq"], "candidates", concepts)
    return found.select("bundle", "src_id", "src_segs", "src_path", "seq", F.array_join("target_segs", "/").alias("target_id"), "target_segs", "exists", "text", "raw")


def backlinks(resolved: DataFrame) -> DataFrame:
    """Distinct ``target_id, src_id`` edges; a concept's link to itself counts."""
    return resolved.where("exists").select("bundle", "target_id", "src_id", "src_path").dropDuplicates(["bundle", "target_id", "src_id"])


def source_rows(concepts: DataFrame) -> DataFrame:
    """A row for each entry of ``sources``."""
    return concepts.select("bundle", F.col("id").alias("src_id"), F.col("id_segs").alias("src_segs"), F.col("path_segs").alias("src_path"), F.posexplode("sources").alias("seq", "source"))


def resolved_sources(concepts: DataFrame) -> DataFrame:
    """``source_rows`` with ``concept_id``: the concept that a source's resource names, itself excepted."""
    rows = source_rows(concepts)
    paths = F.when(F.col("source.resource").isNotNull(), field_paths(F.col("source.resource"), F.col("src_segs"))).otherwise(F.array().cast("array<string>"))
    ways = F.flatten(F.transform(paths, lambda p: F.array_compact(F.array(F.when(p.endswith(".md"), _as_id(F.regexp_replace(p, r"\.md$", ""))), _as_id(p)))))
    rows = rows.withColumn("ways", F.array_distinct(ways))
    known = ids(concepts).select(F.col("bundle").alias("known_bundle"), F.col("id").alias("known_id"))
    tried = rows.select("bundle", "src_id", "seq", F.posexplode("ways").alias("pos", "way"))
    hits = tried.join(known, (F.col("bundle") == F.col("known_bundle")) & (F.array_join("way", "/") == F.col("known_id")))
    best = hits.groupBy("bundle", "src_id", "seq").agg(F.min_by("known_id", "pos").alias("hit"))
    rows = rows.drop("ways").join(best, ["bundle", "src_id", "seq"], "left")
    return rows.withColumn("concept_id", F.when(F.col("hit") != F.col("src_id"), F.col("hit"))).drop("hit")


def _as_id(path: Column) -> Column:
    """The id that a path spells, null if it spells none."""
    return valid_id(F.filter(F.split(path, "/", -1), lambda s: s != ""))


def derivations(sources: DataFrame) -> DataFrame:
    """A row for each source that is a concept, in order; repeats stay."""
    return sources.where("concept_id is not null").select("bundle", "src_id", "src_path", "seq", "concept_id")


def derived_by(sources: DataFrame) -> DataFrame:
    return derivations(sources).select("bundle", "concept_id", "src_id", "src_path").dropDuplicates(["bundle", "concept_id", "src_id"])


def tag_edges(concepts: DataFrame) -> DataFrame:
    """``bundle, tag, path_segs, pos, id``: an edge for each time a concept names a tag."""
    return concepts.select("bundle", "id", "path_segs", F.posexplode("tags").alias("pos", "tag")).select("bundle", "tag", "path_segs", "pos", "id")


def tags(concepts: DataFrame) -> DataFrame:
    """``bundle, tag, ids``: the edges of each tag as one list in path order, for tags that few concepts have."""
    listed = tag_edges(concepts).groupBy("bundle", "tag").agg(F.sort_array(F.collect_list(F.struct("path_segs", "pos", "id"))).alias("x"))
    return listed.select("bundle", "tag", F.col("x.id").alias("ids"))


def attributions(concepts: DataFrame) -> DataFrame:
    """A row for each footnote label of a document, in order of first appearance: how often it is cited and defined,
    and the first source with that id."""
    labels = F.array_distinct(F.concat(F.col("refs.label"), F.col("defs.label")))
    each = concepts.select("bundle", "id", "path_segs", "rel_path", "refs", "defs", "sources", F.posexplode(labels).alias("ord", "label"))
    same = F.filter("sources", lambda s: s["id"] == F.col("label"))
    return each.select(
        "bundle", "id", "path_segs", "rel_path", "ord", "label",
        F.size(F.filter("refs", lambda r: r["label"] == F.col("label"))).alias("n_refs"),
        F.size(F.filter("defs", lambda d: d["label"] == F.col("label"))).alias("n_defs"),
        F.get(same, F.lit(0)).alias("source"),
        F.size("sources").alias("n_sources"),
    )


def index_listings(indexes: DataFrame) -> DataFrame:
    """A row for each id that each link of an index can mean: ``bundle, rel_path, path_segs, dir_segs, raw, target_segs, target_id``."""
    at = indexes.where("error is null").select(
        "bundle", "rel_path", "path_segs", F.slice("path_segs", 1, F.size("path_segs") - 1).alias("dir_segs"), "links",
        F.transform("path_segs", lambda s, i: F.when(i == F.size("path_segs") - 1, F.regexp_replace(s, r"\.md$", "")).otherwise(s)).alias("id_segs"), F.lit("").alias("id"),
    )
    raw = at.select("bundle", "rel_path", "path_segs", "dir_segs", "id_segs", F.explode("links").alias("link"))
    return raw.select("bundle", "rel_path", "path_segs", "dir_segs", F.col("link.raw").alias("raw"), F.explode(_readings(F.col("id_segs"))).alias("target_segs")).withColumn("target_id", F.array_join("target_segs", "/"))
