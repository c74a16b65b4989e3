"""Small bundles written from ``documents``, one for each: a change log that holds the document's text and an index that declares a
version, in all the forms that the rules for logs, indexes and versions tell apart.

Which form a document takes follows from its number, by remainders, so an oracle can say what must be found. The lines of a log are
written once, in SQL that Spark and DuckDB both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DATED = "n % 11 <> 0"


def _where(condition: str, line: str) -> str:
    return f"CASE WHEN {condition} THEN {line} END"


#: The lines of the log of document ``n``, null where it has none; ``flat`` is its text in one line.
LINES = (
    "'# History ' || n", "''", _where("n % 13 = 0", "'* early'"),
    _where(_DATED, "'## 2026-02-' || lpad(CAST(1 + n % 28 AS STRING), 2, '0')"),
    _where(_DATED, "'* **New**: ' || coalesce(lang, '-') || ' ' || coalesce(source, '-')"), _where(_DATED, "'  more of it'"), _where(_DATED, "'* Text: ' || flat || '.'"),
    _where(f"n % 17 = 0 AND {_DATED}", "'# Again'"),
    _where(_DATED, "'## 2026-01-15'"), _where(f"n % 7 <> 0 AND {_DATED}", "'* b'"),
    _where(f"n % 3 = 0 AND {_DATED}", "'## 2026-03-01'"), _where(f"n % 3 = 0 AND {_DATED}", "'* c'"),
    _where(f"n % 4 = 0 AND {_DATED}", "'## soon'"), _where(f"n % 4 = 0 AND {_DATED}", "'* d'"),
    _where("n % 5 = 0", "'stray ' || n"),
)
#: Index of document ``n`` by n modulo eight; a null one is no UTF-8.
INDEXES = (
    '---\nokf_version: "0.2"\n---\n\n# Parts\n', '---\nokf_version: "0.1"\n---\n\n# Parts\n', '---\nokf_version: "9.9"\n---\n\n# Parts\n', "# Parts\n",
    '---\nokf_version: "0.2"\ntitle: x\n---\n\n# Parts\n', "---\n- a\n---\n", None, "---\nokf_version: 2\n---\n\n# Parts\n",
)


def history_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bundle, rel_path, content``: of each document a bundle with an index and a log. Every nineteenth log is no UTF-8."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("n"), "lang", "source", F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ").alias("flat"))
    lines = F.filter(F.array(*map(F.expr, LINES)), lambda x: x.isNotNull())
    log = F.concat(F.encode(F.concat(F.array_join(lines, "\n"), F.lit("\n")), "utf-8"), F.when(F.expr("n % 19 = 0"), F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))))
    index = F.element_at(F.array(*map(F.lit, INDEXES)), (F.col("n") % 8 + 1).cast("int"))
    files = F.array(F.struct(F.lit("log.md").alias("rel_path"), log.alias("content")), F.struct(F.lit("index.md").alias("rel_path"), F.coalesce(F.encode(index, "utf-8"), F.unhex(F.lit("FF"))).alias("content")))
    return docs.select(F.concat(F.lit("h"), "n").alias("bundle"), F.explode(files).alias("f")).select("bundle", "f.rel_path", "f.content")


#: What the oracles start from: each document with the lines of its log, its days and entries.
PRELUDE = rf"""WITH d AS (SELECT doc_id::BIGINT AS n, lang, source, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS flat FROM documents),
h AS (SELECT n, 'h' || n AS bundle, n % 19 <> 0 AS readable, lang, source, flat, list_filter([{', '.join(LINES)}], lambda x: x IS NOT NULL) AS lines FROM d),
heads AS (SELECT n, bundle, list_filter(lines, lambda x: starts_with(x, '## ')) AS heads FROM h WHERE readable),
days AS (SELECT n, bundle, unnest(range(1, len(heads) + 1)) AS day, unnest(list_transform(heads, lambda x: x[4:])) AS date_text FROM heads),
told AS (SELECT h.n, h.bundle, e.date_text, e.pos, e.kind, e.text FROM h, LATERAL (SELECT unnest([
  {{'date_text': '2026-02-' || lpad((1 + n % 28)::VARCHAR, 2, '0'), 'pos': 1, 'kind': 'New', 'text': coalesce(lang, '-') || ' ' || coalesce(source, '-'), 'has': TRUE}},
  {{'date_text': '2026-02-' || lpad((1 + n % 28)::VARCHAR, 2, '0'), 'pos': 2, 'kind': '-', 'text': 'Text: ' || flat || '.', 'has': TRUE}},
  {{'date_text': '2026-01-15', 'pos': 1, 'kind': '-', 'text': 'b', 'has': n % 7 <> 0}}, {{'date_text': '2026-03-01', 'pos': 1, 'kind': '-', 'text': 'c', 'has': n % 3 = 0}},
  {{'date_text': 'soon', 'pos': 1, 'kind': '-', 'text': 'd', 'has': n % 4 = 0}}]) AS e) WHERE h.readable AND e.has AND h.n % 11 <> 0),
entries AS (SELECT t.n, t.bundle, d.day, t.date_text, t.pos, t.kind, t.text FROM told t JOIN days d ON d.n = t.n AND d.date_text = t.date_text),
problems AS (SELECT bundle, unnest(list_filter([
  CASE WHEN n % 11 = 0 THEN 'log contains no date groups' END, CASE WHEN n % 7 = 0 AND n % 11 <> 0 THEN 'log date group "2026-01-15" has no entries' END,
  CASE WHEN n % 3 = 0 AND n % 11 <> 0 THEN 'log date groups are not newest first: "2026-03-01" follows "2026-01-15"' END,
  CASE WHEN n % 13 = 0 THEN 'log contains an entry outside a date group at line 3' END,
  CASE WHEN n % 17 = 0 AND n % 11 <> 0 THEN 'log contains non-log content at line ' || list_position(lines, '# Again') END,
  CASE WHEN n % 5 = 0 THEN 'log contains non-log content at line ' || list_position(lines, 'stray ' || n) END,
  CASE WHEN n % 4 = 0 AND n % 11 <> 0 THEN 'log date heading is not ISO-8601 `YYYY-MM-DD`: "soon"' END], lambda x: x IS NOT NULL)) AS message FROM h WHERE readable),
versions AS (SELECT bundle, CASE n % 8 WHEN 1 THEN '0.1' WHEN 2 THEN '9.9' ELSE '0.2' END AS version FROM h WHERE n % 8 IN (0, 1, 2, 4))
"""  # fmt: skip

#: DuckDB SQL behind the prelude.
ORACLES = {
    "s15_declared_version": "SELECT bundle, version FROM versions",
    "s17_log_entries": "SELECT bundle, day::BIGINT AS day, date_text, pos::BIGINT AS pos, kind, text FROM entries",
    "w1_log_order": "SELECT bundle, '2026-03-01' AS date_text, '2026-01-15' AS before FROM h WHERE readable AND n % 3 = 0 AND n % 11 <> 0",
    "w2_log_problems": "SELECT bundle, message FROM problems",
    "k11_log_markdown": """SELECT h.bundle, '# History ' || h.n || chr(10) || chr(10) || coalesce(g.groups, '') AS markdown FROM h LEFT JOIN (SELECT n, string_agg('## ' || date_text || chr(10) || bullets, chr(10) ORDER BY day) AS groups FROM
        (SELECT d.n, d.day, d.date_text, coalesce(string_agg('* ' || CASE WHEN kind = '-' THEN '' ELSE '**' || kind || '**: ' END || text || chr(10), '' ORDER BY pos), '') AS bullets FROM days d LEFT JOIN entries e ON e.n = d.n AND e.day = d.day GROUP BY d.n, d.day, d.date_text) GROUP BY n) g ON g.n = h.n WHERE h.readable""",
    "v17_reserved_files": """SELECT bundle, 'V18' AS code, message || ' (§9)' AS message FROM problems UNION ALL SELECT bundle, 'V18', 'unreadable reserved log.md: stream did not contain valid UTF-8 (§9)' FROM h WHERE NOT readable
        UNION ALL SELECT bundle, 'V17', CASE n % 8 WHEN 4 THEN 'root index.md frontmatter should declare only `okf_version` (§12)' WHEN 5 THEN 'unparseable reserved index.md: Frontmatter must be a YAML mapping (§8)' ELSE 'unreadable reserved index.md: stream did not contain valid UTF-8 (§8)' END FROM h WHERE n % 8 IN (4, 5, 6)
        UNION ALL SELECT bundle, 'V19', CASE version WHEN '0.1' THEN 'bundle targets format v0.1; read as v0.2 under the §13.1 fallbacks' ELSE 'bundle declares an unrecognized `okf_version: ' || version || '`; consuming it best-effort as v0.2 (§12)' END FROM versions WHERE version <> '0.2'""",
    "stream_log_entries": "SELECT date_text, count(*) AS n FROM entries GROUP BY date_text",
}
