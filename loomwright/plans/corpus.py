"""A bundle written from the ``documents`` table, so that every operator has a large deterministic input.

Everything about a document follows from its number, by remainders; an oracle can therefore say what each
operator must find without parsing anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINK_SPAN = 1050


def _path(n: str) -> str:
    return f"concat('d', ({n}) % 10, '/doc_', {n}, '.md')"


def front_matter(edited: bool) -> Column:
    """Frontmatter of document ``n``, a line each."""
    status = "case when n % 8 = 0 then 'draft' when n % 8 = 1 then 'deprecated' when n % 8 = 2 then 'experimental' when n % 8 = 3 then '' else 'stable' end"
    if edited:
        status = f"case when n % 50 = 3 then 'archived' else {status} end"
    lines = [
        "case when n % 53 <> 0 then concat('type: ', case when n % 7 = 0 then 'Attested Computation' when n % 5 = 0 then 'Metric' else 'Note' end) end",
        "case when n % 43 <> 0 then concat('title: ', case when n % 41 = 0 then 'Shared title' else concat('Document ', n) end) end",
        "case when n % 6 <> 0 then concat('description: About ', n) end",
        "case when n % 29 = 0 then concat('tags: ', lang) else concat('tags: [', lang, ', s', n % 4, ']') end",
        "case when n % 9 <> 0 then concat('generated: { by: writer/1.0, at: 2026-05-', 10 + n % 17, 'T08:00:00Z }') end",
        "case when n % 3 < 2 then concat('verified:\\n- by: ', case when n % 3 = 0 then 'human:reviewer' else 'process:nightly' end, '\\n  at: 2026-05-', 10 + n % 20, case when n % 31 = 0 then '' else 'T00:00:00Z' end) end",
        f"case when ({status}) <> '' then concat('status: ', {status}) end",
        "case when n % 37 = 0 then 'stale_after: soon' when n % 4 = 0 then concat('stale_after: 2026-06-', 10 + n % 20) when n % 4 = 1 then \"stale_after: '2026-08-15T00:00:00Z'\" end",
        "case when n % 5 = 0 then concat('sources:\\n- id: s1\\n  resource: ../', " + _path("n + 1") + ", '\\n- id: s2\\n  resource: https://example.com/', n) end",
        "case when n % 45 = 0 then 'timestamp: 2026-05-01T00:00:00Z' end",
        "case when n % 7 = 0 then concat('runtime: sql\\nparameters:\\n- { name: year, type: integer, required: true }\\nexecutor: { resource: run.md, receipt: [log] }', case when n % 14 = 0 then '' else '\\nattester: { resource: check.py }' end) end",
    ]
    if edited:
        lines.append("case when n % 50 = 4 then concat('owner: team', n) end")
    return F.concat_ws("\n", *map(F.expr, lines))


def body(edited: bool) -> Column:
    """Body of document ``n``: its whole text between a heading and its links, notes and computation."""
    target = f"((n * 7 + 3) % {LINK_SPAN})"
    parts = [
        "concat('# Document ', n, '\\n\\n', coalesce(text, ''), '\\n')" if not edited else "concat('# Document ', n, '\\n\\n', case when n % 50 = 2 then 'Edited.\\n' else '' end, coalesce(text, ''), '\\n')",
        f"concat('[next](/', {_path(target)}, ') [peer](../', {_path('n + 1')}, '#part)')",
        "case when n % 20 = 0 then concat('[gone](/gone/x', n, '.md)') end",
        "case when n % 97 = 0 then concat('[me](doc_', n, '.md)') end",
        "case when n % 5 = 0 then '\\nClaim[^s1] and other[^zz].\\n\\n[^s1]: first source' end",
        "case when n % 11 = 0 then concat('\\n# Citations\\n\\n[1] [Site](https://example.com/', n, ')') end",
        "case when n % 7 = 0 then concat('\\n# Computation\\n\\n```sql\\nSELECT ', n, '\\n```') end",
    ]
    return F.concat(F.concat_ws("\n", *map(F.expr, parts)), F.lit("\n"))


def corpus_files(spark: SparkSession, sf_dir: str, edited: bool = False) -> DataFrame:
    """``bundle, rel_path, content`` of the written bundle; ``edited`` gives a later snapshot of it.

    The snapshot drops every fiftieth document, moves, edits, archives and extends the four after it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("n"), "lang", "text")
    if edited:
        docs = docs.where("n % 50 <> 0")
    path = F.expr(_path("n")) if not edited else F.expr(f"case when n % 50 = 1 then concat('d', n % 10, '/moved_', n, '.md') else {_path('n')} end")
    pages = docs.select(path.alias("rel_path"), F.concat(F.lit("---\n"), front_matter(edited), F.lit("\n---\n\n"), body(edited)).alias("content"))
    listed = docs.where("n % 10 < 5 and n % 3 <> 0").groupBy((F.col("n") % 10).alias("k")).agg(F.array_join(F.sort_array(F.collect_list(F.expr("concat('* [Document ', n, '](doc_', n, '.md)')"))), "\n").alias("rows"))
    indexes = listed.select(F.expr("concat('d', k, '/index.md')").alias("rel_path"), F.expr("concat('# Notes\\n\\n', rows, '\\n* [Gone](gone_', k, '.md)\\n')").alias("content"))
    log = "concat('# Log ', id, '\\n\\n## 2026-02-0', 1 + id % 9, '\\n* **New**: a', id, '\\n## 2026-01-15\\n* b\\n', if(id % 3 = 0, '## 2026-03-01\\n* c\\n', ''), if(id % 4 = 0, '## soon\\n* d\\n', ''), if(id % 5 = 0, 'stray\\n', ''))"
    logs = spark.range(10).select(F.expr("concat('d', id, '/log.md')").alias("rel_path"), F.expr(log).alias("content"))
    root = spark.range(1).select(F.lit("index.md").alias("rel_path"), F.lit('---\nokf_version: "0.1"\n---\n\n# Parts\n\n* [d0](d0/index.md)\n').alias("content"))
    every = pages.unionByName(indexes).unionByName(logs).unionByName(root)
    return every.select(F.lit("a").alias("bundle"), "rel_path", F.encode("content", "utf-8").alias("content"))
