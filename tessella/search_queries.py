"""Registered queries of searches, tenants, collections and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import profile as P
from .operators import dedup as D
from .operators import lockout as L
from .operators import rank as RK
from .operators import retrieval as R
from .operators import search as SE
from .operators import vectors as V
from .plans import views as W
from .registry import QUERIES, register
from .sources.tables import table

_STOP = ", ".join(f"'{w}'" for w in P.STOP_WORDS)
_KEYS = r"list_filter(regexp_extract_all(lower(query), '[\p{L}\p{N}_]+'), lambda w: NOT list_contains([" + _STOP + "], w))"
_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


def _vector_queries(s: SparkSession, d: str) -> DataFrame:
    """Each vector whose id is divisible by 50 asks with the first sentence of the document of its id."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), F.substring_index("text", ".", 1).alias("query"))
    asked = table(s, d, "embeddings").where("vec_id % 50 = 0").join(docs, "vec_id")
    return asked.select(F.col("vec_id").alias("query_id"), "embedding", "query", P.keywords(F.col("query")).alias("keywords"), P.query_type(F.col("query")).alias("type"), P.query_complexity(F.col("query")).alias("complexity"))


_ASKED = f"asked AS (SELECT vec_id AS query_id, embedding, query, list_distinct({_KEYS}) AS ks, {{kind}} AS type, {{level}} AS complexity FROM (SELECT vec_id, embedding, split_part(text, '.', 1) AS query FROM embeddings JOIN documents ON vec_id = doc_id WHERE vec_id % 50 = 0))"
_WORDS = r"len(list_filter(regexp_split_to_array(query, '\s+'), lambda w: w <> ''))"
_CODE = "(" + " OR ".join(f"regexp_matches(query, '(?i){p}')" for p in P.CODE_PATTERNS) + ")"
_KIND = f"CASE WHEN regexp_matches(lower(query), '{P.QUESTION}') THEN 'question' WHEN {_CODE} THEN 'code' WHEN regexp_matches(lower(query), '{P.SUMMARY}') THEN 'summary' ELSE 'semantic' END"
_ASKED = _ASKED.replace("{kind}", _KIND).replace("{level}", f"CASE WHEN {_WORDS} <= 2 THEN 'simple' WHEN {_WORDS} <= 5 THEN 'medium' ELSE 'complex' END")


def _searches(k: int) -> str:
    """Views of the vector hits (near), the keyword hits (words) and both fused (both)."""
    return f"""{_ASKED}, sims AS (SELECT a.query_id, b.vec_id AS doc_id, {_COS} AS s FROM asked a, embeddings b WHERE b.embedding IS NOT NULL),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM sims WHERE s >= 0) WHERE rank <= {k}),
    wide AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS r FROM sims JOIN asked USING (query_id) WHERE s >= 0.1 AND len(ks) > 0) WHERE r <= {2 * k}),
    told AS (SELECT query_id, doc_id, s, r, len(list_filter(ks, lambda w: contains(lower(text), w))) / len(ks) AS score FROM wide JOIN documents USING (doc_id)),
    words AS (SELECT * FROM (SELECT query_id, doc_id, score, s, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r) AS rank FROM told WHERE score >= 0.1) WHERE rank <= {k}),
    fused AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM near UNION ALL SELECT query_id, doc_id, rank FROM words) GROUP BY 1, 2),
    both_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused) WHERE rank <= {k})"""


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text")


register(
    "ret2_keyword_search",
    f"WITH {_searches(10)} SELECT query_id, doc_id, round(score, 6) AS score, round(s, 6) AS vector_score, rank FROM words",
    lambda s, d: SE.keyword_search(_vector_queries(s, d), table(s, d, "embeddings"), _docs(s, d), 10).withColumns({"score": F.round("score", 6), "vector_score": F.round("vector_score", 6)}),
)
register("ret7_hybrid_search", f"WITH {_searches(10)} SELECT query_id, doc_id, score, rank FROM both_", lambda s, d: SE.hybrid_search(_vector_queries(s, d), table(s, d, "embeddings"), _docs(s, d), 10))
register(
    "ret7_hybrid_weighted",
    f"""WITH {_searches(10)}, w AS (SELECT coalesce(n.query_id, w.query_id) AS query_id, coalesce(n.doc_id, w.doc_id) AS doc_id, round(0.7 * coalesce(n.s, 0) + 0.3 * coalesce(w.score, 0), 8) AS score FROM near n FULL JOIN words w ON n.query_id = w.query_id AND n.doc_id = w.doc_id)
    SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS k FROM w) WHERE k <= 10""",
    lambda s, d: SE.hybrid_search(_vector_queries(s, d), table(s, d, "embeddings"), _docs(s, d), 10, method="weighted").select("query_id", "doc_id", "score"),
)
_ADAPTIVE = """SELECT query_id, doc_id, score, rank, 'hybrid' AS strategy FROM both_ SEMI JOIN (SELECT query_id FROM asked WHERE type = 'code' OR complexity <> 'simple') USING (query_id)
    UNION ALL SELECT query_id, doc_id, s, rank, 'vector' FROM near SEMI JOIN (SELECT query_id FROM asked WHERE type <> 'code' AND complexity = 'simple') USING (query_id)"""
register(
    "ret7_adaptive_search",
    f"WITH {_searches(10)} SELECT query_id, doc_id, round(score, 6) AS score, rank, strategy FROM ({_ADAPTIVE})",
    lambda s, d: SE.adaptive_search(_vector_queries(s, d), table(s, d, "embeddings"), _docs(s, d), 10).withColumn("score", F.round("score", 6)),
)


def _retrieve(s: SparkSession, d: str) -> DataFrame:
    """Queries to hits: adaptive search, features of the 50 candidates, re-ranking, and the final filters."""
    queries = _vector_queries(s, d)
    hits = SE.adaptive_search(queries, table(s, d, "embeddings"), _docs(s, d), 50).select("query_id", "doc_id", "score")
    docs = W.corpus(s, d)
    asked = queries.select("query_id", "query", F.col("type").alias("kind"), RK.word_set(F.col("query")).alias("asked"))
    prepared = RK.prepare_contents(docs, F.col("path"), P.document_type(F.col("path")), F.col("doc_id") % 2 == 0)
    ranked = RK.rerank(*RK.rerank_features(hits, asked, prepared)).drop("rank").join(docs.select("doc_id", "lang"), "doc_id")
    return R.final_filters(ranked, 0.1, ["en", "fr", "de"], 5).select("query_id", "doc_id", "score", "lang", "rank")


def retrieve_sql(features: str, weights: str, total: str) -> str:
    """SQL of ``_retrieve`` around the feature expressions of the re-ranking queries, which read the hits k."""
    asked = features.replace("(SELECT user_id * 1000 + turn AS query_id, query FROM query_table)", "(SELECT query_id, query FROM asked)")
    return f"""WITH {_searches(50)}, k AS (SELECT query_id, doc_id, score FROM ({_ADAPTIVE})), scored AS (SELECT query_id, doc_id, round(({weights}) / ({total})::DOUBLE, 6) AS score FROM ({asked})),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM scored) WHERE n <= 10)
        SELECT query_id, doc_id, score, lang, rank FROM (SELECT query_id, doc_id, score, lang, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM best JOIN documents USING (doc_id) WHERE score >= 0.1 AND lang IN ('en', 'fr', 'de')) WHERE rank <= 5"""


def register_retrieval(features: str, weights: str, total: str) -> None:
    register("ret11_retrieve_vectors", retrieve_sql(features, weights, total), _retrieve)


# tenants
def _points(s: SparkSession, d: str) -> DataFrame:
    kinds = F.element_at(F.array(*[F.lit(v) for v in ("public", "internal", "private")]), (F.col("vec_id") % 3 + 1).cast("int"))
    rows = table(s, d, "embeddings").withColumn("visibility", kinds).withColumn("name", F.concat(F.lit("Set-"), F.col("label").cast("string")))
    return SE.tenant_tag(rows, (F.col("label") % 3).cast("long"), F.col("name"), F.col("vec_id") % 7)


_POINTS = "points AS (SELECT vec_id, embedding, (['public', 'internal', 'private'])[CAST(vec_id % 3 + 1 AS INT)] AS visibility, label % 3 AS workspace_id, 'ws_' || (label % 3) AS tenant_id, vec_id % 7 AS created_by, 'ws_' || (label % 3) || '_set_' || label AS tenant_collection FROM embeddings)"
register("acl7_tenant_tag", f"WITH {_POINTS} SELECT * EXCLUDE (embedding) FROM points", lambda s, d: _points(s, d).drop("embedding", "label", "name"))


def _tenant_queries(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", (F.col("label") % 3).cast("long").alias("workspace_id"), (F.col("vec_id") / 50 % 7).cast("long").alias("user_id"))


_TENANT = f"""WITH {_POINTS} SELECT query_id, vec_id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM
    (SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS s FROM embeddings a JOIN points b ON b.workspace_id = a.label % 3 WHERE a.vec_id % 50 = 0 @OWN)) WHERE rank <= 5"""
_OWN = "AND (b.visibility IN ('public', 'internal') OR b.created_by = (a.vec_id // 50) % 7)"
register("acl8_tenant_search", _TENANT.replace("@OWN", _OWN), lambda s, d: SE.tenant_search(_tenant_queries(s, d), _points(s, d), 5).withColumn("score", F.round("score", 6)))
register("acl8_tenant_private", _TENANT.replace("@OWN", "AND b.vec_id >= 10"), lambda s, d: SE.tenant_search(_tenant_queries(s, d), _points(s, d), 5, True, {"vec_id": {"gte": 10}}).withColumn("score", F.round("score", 6)))
register(
    "acl6_user_collections",
    "SELECT user_id, collection_id, name, role FROM members JOIN collections USING (collection_id) WHERE is_active AND role = 'admin'",
    lambda s, d: SE.user_collections(W.collections(s, d), W.members(s, d), "admin"),
)
register("acl6_public_collections", "SELECT collection_id, name FROM collections WHERE visibility = 'public' AND name ILIKE '%R#%1%'", lambda s, d: SE.public_collections(W.collections(s, d), "r#%1").select("collection_id", "name"))

# indexing, logs and collections
register(
    "src7_build_index",
    """SELECT doc_id || '_chunk_' || b AS id, collection, doc_id, path AS source_file, CAST(b AS INT) AS chunk_index, CAST(b * 50 + 1 AS INT) AS start_line, CAST(least(b * 50 + 50, len(ls)) AS INT) AS end_line, array_to_string(ls[b * 50 + 1 : b * 50 + 50], chr(10)) AS content
    FROM (SELECT *, unnest(range(0, CAST(ceil(len(ls) / 50.0) AS BIGINT))) AS b FROM (SELECT *, string_split(text, chr(10)) AS ls FROM corpus))""",
    lambda s, d: SE.build_index(W.corpus(s, d)),
)
_ENTITY = lambda t, p: f"SELECT user_id, turn, '{t}' AS type, unnest(regexp_extract_all(query, '{p}', 1)) AS value FROM query_table"
_TOKENS = lambda t, p: f"SELECT user_id, turn, '{t}' AS type, unnest(list_filter(regexp_extract_all(query, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '{p}'))) AS value FROM query_table"
register(
    "qry5_entities",
    "SELECT user_id, turn, type, value, count(*) AS n FROM (" + " UNION ALL ".join([*[_ENTITY(t, p) for t, p in P.ENTITIES.items()], *[_TOKENS(t, p) for t, p in P.TOKEN_ENTITIES.items()]]) + ") GROUP BY ALL",
    lambda s, d: W.query_table(s, d).select("user_id", "turn", F.explode(P.entities(F.col("query"))).alias("e")).groupBy("user_id", "turn", "e.type", "e.value").agg(F.count("*").alias("n")),
)
register(
    "rel6_recent",
    "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM query_log WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY) WHERE n <= 10",
    lambda s, d: SE.recent(W.query_log(s, d), F.lit(table(s, d, "events").agg(F.max("ts")).first()[0]) - F.make_dt_interval(F.lit(5))).select("event_id", "user_id"),
)
register(
    "rel8_settings_history",
    "SELECT event_id AS change_id, s_name AS key, c_name AS user_name, ts AS changed_at FROM events JOIN supplier ON s_suppkey = user_id LEFT JOIN customer ON c_custkey = event_id % 3000 ORDER BY ts DESC, event_id DESC LIMIT 100",
    lambda s, d: SE.settings_history(
        table(s, d, "events").select(F.col("event_id").alias("change_id"), F.col("user_id").alias("setting_id"), (F.col("event_id") % 3000).alias("user_id"), F.col("ts").alias("changed_at")),
        table(s, d, "supplier").select(F.col("s_suppkey").alias("setting_id"), F.col("s_name").alias("key")), table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name")),
    ),
)
_SPREAD = lambda view, value: f"SELECT collection, string_agg(v || '=' || n, ',' ORDER BY v) AS x FROM (SELECT collection, {value} AS v, count(*) AS n FROM {view} WHERE {value} IS NOT NULL GROUP BY 1, 2) GROUP BY 1"
register(
    "ana3_collection_stats",
    f"""WITH q AS (SELECT 'src' || (user_id % 30) AS collection, query_type, status, processing_time AS seconds FROM query_log), typed AS (SELECT *, CASE doc_id % 6 WHEN 3 THEN 'markdown' WHEN 4 THEN 'json' WHEN 5 THEN 'text' ELSE 'code' END AS type FROM corpus)
    SELECT d.collection, d.n AS documents, t.x AS by_type, l.x AS by_language, coalesce(c.n, 0) AS chunks, c.a AS avg_lines, coalesce(a.n, 0) AS queries, coalesce(a.ok, 0) AS successful, a.s AS avg_seconds, k.x AS query_types
    FROM (SELECT collection, count(*) AS n FROM corpus GROUP BY 1) d LEFT JOIN ({_SPREAD('typed', 'type')}) t USING (collection) LEFT JOIN ({_SPREAD('typed', 'lang')}) l USING (collection)
    LEFT JOIN (SELECT collection, count(*) AS n, round(avg(end_line - start_line + 1), 6) AS a FROM chunks GROUP BY 1) c USING (collection)
    LEFT JOIN (SELECT collection, count(*) AS n, count(*) FILTER (status = 'completed') AS ok, round(avg(seconds), 6) AS s FROM q GROUP BY 1) a USING (collection) LEFT JOIN ({_SPREAD('q', 'query_type')}) k USING (collection)""",
    lambda s, d: SE.collection_stats(
        W.corpus(s, d).select("collection", P.document_type(F.col("path")).alias("type"), "lang"), W.chunks(s, d).select("collection", (F.col("end_line") - F.col("start_line") + 1).alias("lines")),
        W.query_log(s, d).select(F.concat(F.lit("src"), (F.col("user_id") % 30).cast("string")).alias("collection"), "query_type", "status", F.col("processing_time").alias("seconds")),
    ),
)
register(
    "ana19_suggestions",
    r"""WITH log AS (SELECT collection, user_id, left(query, 12) AS query, turn AS said FROM query_table),
    p AS (SELECT collection, query, row_number() OVER (PARTITION BY collection ORDER BY count(*) DESC, query) AS k FROM log GROUP BY 1, 2 QUALIFY k <= 3),
    t AS (SELECT collection, term, row_number() OVER (PARTITION BY collection ORDER BY count(*) DESC, term) AS k FROM (SELECT source AS collection, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents) GROUP BY 1, 2 QUALIFY k <= 3),
    u AS (SELECT DISTINCT collection, user_id FROM log),
    o AS (SELECT collection, user_id, query, row_number() OVER (PARTITION BY collection, user_id ORDER BY max(said) DESC, query) AS k FROM log GROUP BY 1, 2, 3 QUALIFY k <= 3),
    e AS (SELECT collection, user_id, query AS suggestion, 1 AS f, k FROM u JOIN p USING (collection) UNION ALL SELECT collection, user_id, query, 2, k FROM o UNION ALL SELECT collection, user_id, term, 3, k FROM u JOIN t USING (collection)),
    g AS (SELECT collection, user_id, suggestion, min(f * 100 + k) AS z FROM e WHERE contains(lower(suggestion), 'e') GROUP BY 1, 2, 3)
    SELECT collection, user_id, suggestion, row_number() OVER (PARTITION BY collection, user_id ORDER BY z, suggestion) AS place FROM g QUALIFY place <= 9""",
    lambda s, d: SE.query_suggestions(
        W.query_table(s, d).select("collection", "user_id", F.left("query", F.lit(12)).alias("query"), F.col("turn").alias("at")),
        table(s, d, "documents").select(F.col("source").alias("collection"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({P.WORD})"), 1)).alias("term")).groupBy("collection", "term").agg(F.count("*").alias("n")),
        prefix="E",
    ),
)
register(
    "ana24_lockout",
    """WITH RECURSIVE o AS (SELECT event_id, user_id, ts, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    r AS (SELECT user_id, 0::BIGINT AS k, 0 AS failures, NULL::TIMESTAMP AS until, NULL::BIGINT AS event_id, false AS ignored FROM o WHERE k = 1
        UNION ALL SELECT o.user_id, o.k, CASE WHEN r.until > o.ts THEN r.failures WHEN o.ok THEN 0 ELSE r.failures + 1 END,
        CASE WHEN r.until > o.ts THEN r.until WHEN o.ok THEN NULL WHEN r.failures + 1 >= 2 THEN o.ts + INTERVAL 1440 MINUTE ELSE r.until END, o.event_id, coalesce(r.until > o.ts, false) FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
    SELECT event_id, user_id, failures, ignored, until AS locked_until FROM r WHERE k > 0""",
    lambda s, d: L.lockout_replay(table(s, d, "events").select("event_id", "user_id", "ts", (F.col("event_type") != "error").alias("ok")), 2, 1440),
)


register(
    "qlt13_circular_dependencies",
    """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS g, l_partkey % 9 AS a, l_suppkey % 9 AS b FROM lineitem), r(g, a, b) AS (SELECT g, a, b FROM e UNION SELECT r.g, r.a, e.b FROM r JOIN e ON e.g = r.g AND e.a = r.b)
    SELECT DISTINCT g AS "group" FROM r WHERE a = b""",
    lambda s, d: SE.circular_dependencies(table(s, d, "lineitem").select(F.col("l_orderkey").alias("group"), (F.col("l_partkey") % 9).alias("src"), (F.col("l_suppkey") % 9).alias("dst"))),
)

# views with repeats and with bad rows, for operators whose own views have none
register(
    "ded5_query_dedup_repeats",
    "SELECT left(sha256(lower(trim(left(query, 2))) || ':' || (user_id % 10) || ':' || collection), 16) AS hash, count(*) AS n FROM query_table GROUP BY 1 HAVING count(*) > 1",
    lambda s, d: D.repeated(W.query_table(s, d).select(P.query_hash(F.left("query", F.lit(2)), F.col("user_id") % 10, F.col("collection")).alias("hash")), "hash"),
)
register(
    "vec8_validate_by_label",
    """WITH v AS (SELECT vec_id, label, CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 13 = 0 THEN [] WHEN vec_id % 7 = 0 THEN embedding[1:32] ELSE embedding END AS e FROM embeddings)
    SELECT vec_id, coalesce(len(e), -1) AS dimension, CASE WHEN coalesce(len(e), -1) < 1 THEN 'empty vector' ELSE 'other dimension' END AS error FROM v WHERE coalesce(len(e), -1) <> 64""",
    lambda s, d: V.validate_vectors(
        table(s, d, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 11 == 0, None).when(F.col("vec_id") % 13 == 0, F.slice("embedding", 1, 0)).when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))), "label"
    ),
)
