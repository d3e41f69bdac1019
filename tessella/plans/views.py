"""Fixture views over the given tables, each as a DataFrame and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunks import chunk_by_lines
from ..operators.code import BRANCHES, NAME_AFTER, PYTHON_PATTERNS, chunk_by_patterns
from ..sources.tables import table

EXTENSIONS = (".py", ".js", ".go", ".md", ".json", ".txt")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % 6 + 1).cast("int"))
    return docs.select("*", F.col("source").alias("collection"), (F.col("doc_id") % 150).alias("owner_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk_by_lines(corpus(spark, d).select("doc_id", "text", "lang", "collection", "path"), 10)


def code_view(spark: SparkSession, d: str) -> DataFrame:
    """Each document as code: its lines in turn begin classes and functions, branch, or are kept as statements."""
    line = lambda x, i: F.when(i % 7 == 0, F.concat(F.lit("class C"), (i + 1).cast("string"), F.lit(":"))).when(i % 7 == 1, F.concat(F.lit("    def f_"), (i + 1).cast("string"), F.lit("(x):"))).when(i % 7 == 3, F.concat(F.lit("        if x: "), x)).otherwise(F.concat(F.lit("        "), x))
    return corpus(spark, d).withColumn("text", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n"))


def pattern_chunks(spark: SparkSession, d: str) -> DataFrame:
    own = F.when(F.col("start_line") % 4 == 0, F.array("name")).otherwise(F.array().cast("array<string>"))
    return chunk_by_patterns(code_view(spark, d)).withColumn("dependencies", own)


def md_view(spark: SparkSession, d: str) -> DataFrame:
    """corpus with md: its lines as headers, bullets, numbered items and paragraphs, with a link and page marks."""
    mark = lambda i: F.when(i % 5 == 0, "## ").when(i % 5 == 2, "- ").when(i % 5 == 3, "1. ").otherwise("")
    line = lambda x, i: F.concat(F.when(i % 20 == 0, F.concat(F.lit("--- Page "), F.floor(i / 20 + 1).cast("string"), F.lit("\n"))).otherwise(""), mark(i), x, F.when(i == 1, " [l](u)").otherwise(""), F.when(i % 5 == 4, "\n").otherwise(""))
    return corpus(spark, d).withColumn("md", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n"))


def brace_view(spark: SparkSession, d: str) -> DataFrame:
    """Each document as code with braces: every third line opens a function, which is closed before the next one."""
    opener = lambda i: F.concat(F.when(i > 0, "}\n").otherwise(""), F.lit("func f"), i.cast("string"), F.lit("() {"))
    line = lambda x, i: F.when(i % 3 == 0, opener(i)).otherwise(F.concat(F.lit("    "), x))
    return corpus(spark, d).withColumn("text", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n"))


def structured(spark: SparkSession, d: str) -> DataFrame:
    """Each event as JSON (an object, a nested one, an array), XML, YAML, CSV, or what only looks like one."""
    e = table(spark, d, "events")
    k, text = F.col("event_id") % 8, lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    kind, own, user, props = F.col("event_type"), F.col("event_id"), F.col("user_id"), F.col("props")
    body = (
        F.when(k == 0, props)
        .when(k == 1, text('{"a": ', props, ', "b": [1, {"c": []}], "n": ', user, ', "s": "x]{"}'))
        .when(k == 2, text("[", props, ', [], "x]"]'))
        .when(k == 3, text('<r a="', own, '"><k b="1">', kind, "</k><j/></r>"))
        .when(k == 4, text("name: ", kind))
        .when(k == 6, text("{", kind, "}"))
        .otherwise(text("id,type\n", own, ",", kind, "\n", user, ",x"))
    )
    return e.select("event_id", F.when(k == 7, "t.CSV").otherwise("t").alias("path"), body.alias("text"))


def query_table(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "conversations").where("role = 'user'")
    return said.select(F.col("conv_id").alias("user_id"), "turn", F.substring_index("text", ".", 1).alias("query"), F.concat(F.lit("src"), (F.col("conv_id") % 5).cast("string")).alias("collection"))


def query_log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", "ts", "user_id", F.col("event_type").alias("query_type"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
        F.col("value").alias("processing_time"), (F.col("event_id") % 11).alias("result_count"), (F.col("user_id") % 5).alias("collection"),
    )


def api_usage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", "ts", F.col("user_id").alias("api_key_id"), F.col("event_type").alias("endpoint"), F.when(F.col("event_id") % 2 == 0, "GET").otherwise("POST").alias("method"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"), F.col("value").alias("response_time_ms"),
    )


def members(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("collection_id"), F.col("o_custkey").alias("user_id")).distinct()
    role = F.element_at(F.array(*[F.lit(r) for r in ("viewer", "editor", "admin", "owner")]), ((F.col("collection_id") + F.col("user_id")) % 4 + 1).cast("int"))
    return pairs.withColumn("role", role).withColumn("is_active", (F.col("collection_id") + F.col("user_id")) % 5 != 0)


def collections(spark: SparkSession, d: str) -> DataFrame:
    visibility = F.element_at(F.array(F.lit("private"), F.lit("internal"), F.lit("public")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("collection_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("workspace_id"), F.col("s_suppkey").alias("owner_id"), visibility.alias("visibility"))


_HITS = ", ".join(f"({i}, '{n}', '(?i){p}')" for i, (n, p) in enumerate(PYTHON_PATTERNS.items()))
SQL = {
    "corpus": "SELECT *, source AS collection, doc_id % 150 AS owner_id, source || '/' || doc_id || (['.py', '.js', '.go', '.md', '.json', '.txt'])[CAST(doc_id % 6 + 1 AS INT)] AS path FROM documents",
    "chunks": """SELECT doc_id, lang, collection, path, CAST(b AS INT) AS chunk_no, 'block_' || b AS name, CAST(b * 10 + 1 AS INT) AS start_line, CAST(least(b * 10 + 10, len(ls)) AS INT) AS end_line, array_to_string(ls[b * 10 + 1 : b * 10 + 10], chr(10)) AS content
        FROM (SELECT *, unnest(range(0, CAST(ceil(len(ls) / 10.0) AS BIGINT))) AS b FROM (SELECT *, string_split(text, chr(10)) AS ls FROM corpus))""",
    "code_view": """SELECT * REPLACE (array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE i % 7 WHEN 1 THEN 'class C' || i || ':' WHEN 2 THEN '    def f_' || i || '(x):'
        WHEN 4 THEN '        if x: ' || x ELSE '        ' || x END), chr(10)) AS text) FROM corpus""",
    "pattern_chunks": f"""SELECT doc_id, chunk_no, type, name, start_line, end_line, content, CAST(least(1 + len(regexp_extract_all(content, '{BRANCHES}')), 20) AS INT) AS complexity, CASE WHEN start_line % 4 = 0 THEN [name] ELSE [] END AS dependencies
        FROM (SELECT doc_id, CAST(k - 1 AS INT) AS chunk_no, pat AS type, CASE WHEN regexp_matches(trim(ln), '{NAME_AFTER}') THEN regexp_extract(trim(ln), '{NAME_AFTER}', 1) ELSE pat || '_unknown' END AS name,
            CAST(i AS INT) AS start_line, CAST(e AS INT) AS end_line, array_to_string(ls[i : e], chr(10)) AS content
            FROM (SELECT *, row_number() OVER w AS k, coalesce(lead(i) OVER w - 1, len(ls)) AS e FROM (SELECT doc_id, ls, unnest(ls) AS ln, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM code_view))
                JOIN (VALUES {_HITS}) h(o, pat, re) ON regexp_matches(ln, re) WINDOW w AS (PARTITION BY doc_id ORDER BY i, o)))""",
    "md_view": """SELECT *, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 20 = 0 THEN '--- Page ' || ((i - 1) // 20 + 1) || chr(10) ELSE '' END
        || CASE (i - 1) % 5 WHEN 0 THEN '## ' WHEN 2 THEN '- ' WHEN 3 THEN '1. ' ELSE '' END || x || CASE WHEN i = 2 THEN ' [l](u)' ELSE '' END || CASE WHEN (i - 1) % 5 = 4 THEN chr(10) ELSE '' END), chr(10)) AS md FROM corpus""",
    "brace_view": """SELECT * REPLACE (array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 3 > 0 THEN '    ' || x ELSE CASE WHEN i > 1 THEN '}' || chr(10) ELSE '' END || 'func f' || (i - 1) || '() {' END), chr(10)) AS text) FROM corpus""",
    "structured": """SELECT event_id, CASE event_id % 8 WHEN 0 THEN props WHEN 1 THEN '{"a": ' || props || ', "b": [1, {"c": []}], "n": ' || user_id || ', "s": "x]{"}' WHEN 2 THEN '[' || props || ', [], "x]"]'
        WHEN 3 THEN '<r a="' || event_id || '"><k b="1">' || event_type || '</k><j/></r>' WHEN 4 THEN 'name: ' || event_type WHEN 6 THEN '{' || event_type || '}' ELSE 'id,type' || chr(10) || event_id || ',' || event_type || chr(10) || user_id || ',x' END AS text FROM events""",
    "query_table": "SELECT conv_id AS user_id, turn, split_part(text, '.', 1) AS query, 'src' || (conv_id % 5) AS collection FROM conversations WHERE role = 'user'",
    "query_log": "SELECT event_id, ts, user_id, event_type AS query_type, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, value AS processing_time, event_id % 11 AS result_count, user_id % 5 AS collection FROM events",
    "api_usage": "SELECT event_id, ts, user_id AS api_key_id, event_type AS endpoint, CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, value AS response_time_ms FROM events",
    "members": "SELECT *, (['viewer', 'editor', 'admin', 'owner'])[CAST((collection_id + user_id) % 4 + 1 AS INT)] AS role, (collection_id + user_id) % 5 <> 0 AS is_active FROM (SELECT DISTINCT l_suppkey AS collection_id, o_custkey AS user_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "collections": "SELECT s_suppkey AS collection_id, s_name AS name, s_nationkey AS workspace_id, s_suppkey AS owner_id, (['private', 'internal', 'public'])[CAST(s_suppkey % 3 + 1 AS INT)] AS visibility FROM supplier",
}
ORDER = list(SQL)


def with_views(sql: str) -> str:
    """``sql`` with the views it names (and those they name) as common table expressions."""
    need, text = [], sql
    for name in reversed(ORDER):
        if name in text:
            need.append(name)
            text += SQL[name]
    views = ", ".join(f"{n} AS ({SQL[n]})" for n in reversed(need))
    if not views:
        return sql
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(start):
            return f"{start}{views}, {sql[len(start):]}"
    return f"WITH {views} {sql}"
