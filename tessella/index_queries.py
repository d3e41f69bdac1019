"""Registered queries of embedding, persisted indexes and a user's own functions, each with SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import access as A
from .operators import ann as N
from .operators import embedding as E
from .operators import extensions as X
from .operators import quality as QL
from .operators import search as SE
from .operators.vectors import vector_topk
from .plans import views as W
from .registry import QUERIES, register
from .sources.tables import new_folder, settled, table


def as_numbers(vector: str = "embedding"):
    """A vector's components in millionths: whole numbers compare alike everywhere."""
    return F.transform(vector, lambda x: F.round(x * 1e6).cast("long")).alias("embedding")


def embedded(texts: str, key: str, text: str, model: str, name: str) -> str:
    """SQL of ``embed``: CTEs ``{name}`` (key, e) of the texts of a relation by the counts of ``{model}_n`` and ``{model}_docs``; null vectors are left out."""
    return f"""
    {name}_t AS (SELECT {key} AS k, unnest(regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM {texts}),
    {name}_b AS (SELECT k, ('0x' || substr(md5(w), 1, 8))::BIGINT % 65536 AS b, CAST(sum(CASE WHEN substr(md5(w), 9, 1) >= '8' THEN 1 ELSE -1 END) AS BIGINT) AS c FROM {name}_t GROUP BY 1, 2),
    {name}_w AS (SELECT k, c * (ln(({model}_docs.d + 1.0) / (coalesce(n, 0) + 1.0)) + 1.0) AS x, list_transform([0, 1], lambda i: ('0x' || substr(md5('7:' || b || ':' || i), 1, 8))::BIGINT) AS s FROM {name}_b LEFT JOIN {model}_n USING (b), {model}_docs),
    {name}_v AS (SELECT k, j, sum(CASE WHEN (s[1 + j // 32] >> (j % 32)) & 1 = 1 THEN x ELSE -x END) AS v FROM {name}_w, range(64) r(j) GROUP BY 1, 2),
    {name} AS (SELECT k, list(round(v / norm, 6) ORDER BY j) AS e FROM {name}_v JOIN (SELECT k, sqrt(sum(v * v)) AS norm FROM {name}_v GROUP BY k) USING (k) WHERE norm > 1e-9 GROUP BY k)"""


def fitted(texts: str, key: str, text: str, name: str) -> str:
    return f"""{name}_docs AS (SELECT count(*) AS d FROM {texts}),
    {name}_n AS (SELECT ('0x' || substr(md5(w), 1, 8))::BIGINT % 65536 AS b, count(*) AS n FROM (SELECT DISTINCT {key}, unnest(regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM {texts}) GROUP BY 1)"""


_NEAREST = """SELECT query_id, {0}, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {1}) AS rank
    FROM (SELECT q.k AS query_id, {2}, round(list_cosine_similarity(q.e, v.e), 12) AS score FROM q, v)) WHERE rank <= 5"""
_POINTS = """points AS (SELECT doc_id, CAST(b AS BIGINT) AS chunk_index, doc_id || '_chunk_' || b AS id, array_to_string(ls[b * 50 + 1 : b * 50 + 50], chr(10)) AS content
    FROM (SELECT *, unnest(range(0, CAST(ceil(len(ls) / 50.0) AS BIGINT))) AS b FROM (SELECT *, string_split(text, chr(10)) AS ls FROM corpus)))"""


def document_vectors(s, d):
    docs = table(s, d, "documents")
    model = settled(E.fit_embedder(docs))
    return E.embed(docs, model), model


def text_search(s, d):
    vectors, model = document_vectors(s, d)
    asked = E.embed(table(s, d, "benchmark"), model, "item_id").where("embedding is not null").withColumnRenamed("item_id", "query_id")
    hits = vector_topk(asked, vectors.where("embedding is not null").withColumnRenamed("doc_id", "vec_id"), 5)
    return hits.select("query_id", F.col("vec_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


def point_search(s, d):
    points, model = SE.index_texts(W.corpus(s, d))
    asked = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return SE.search_points(asked, points, model, 5).withColumn("score", F.round("score", 6))


# vectors from text
register(
    "vec9_embed", f"WITH {fitted('documents', 'doc_id', 'text', 'm')}, {embedded('documents', 'doc_id', 'text', 'm', 'v')} SELECT doc_id, list_transform(e, lambda x: CAST(round(x * 1e6) AS BIGINT)) AS embedding FROM documents LEFT JOIN v ON k = doc_id",
    lambda s, d: document_vectors(s, d)[0].select("doc_id", as_numbers()),
)
register(
    "vec9_text_search",
    f"WITH {fitted('documents', 'doc_id', 'text', 'm')}, {embedded('documents', 'doc_id', 'text', 'm', 'v')}, {embedded('benchmark', 'item_id', 'text', 'm', 'q')} {_NEAREST.format('doc_id', 'doc_id', 'v.k AS doc_id')}",
    text_search,
)
register(
    "src7_index_vectors", f"WITH {_POINTS}, {fitted('points', 'id', 'content', 'm')}, {embedded('points', 'id', 'content', 'm', 'v')} SELECT id, doc_id, list_transform(e, lambda x: CAST(round(x * 1e6) AS BIGINT)) AS embedding FROM points LEFT JOIN v ON k = id",
    lambda s, d: SE.index_texts(W.corpus(s, d))[0].select("id", "doc_id", as_numbers()),
)
register(
    "src7_text_hits",
    f"WITH {_POINTS}, {fitted('points', 'id', 'content', 'm')}, {embedded('points', 'id', 'content', 'm', 'p')}, v AS (SELECT p.*, points.* FROM p JOIN points ON k = id), {embedded('benchmark', 'item_id', 'text', 'm', 'q')} {_NEAREST.format('id', 'doc_id, chunk_index', 'v.id, v.doc_id, v.chunk_index')}",
    point_search,
)


# a user's own functions
def parsed(s, d):
    X.register_parser(s, "line_records", X.LineRecords, ("web", "news"))
    X.register_parser(s, "plain_chunks", X.WordChunks, ("forum",))
    return X.parse_documents(table(s, d, "documents").select("doc_id", F.element_at(F.array(F.lit("web"), F.lit("news"), F.lit("forum")), (F.col("doc_id") % 3 + 1).cast("int")).alias("type"), "text"), {"fields": ",", "size": "40"})


def chunked(s, d):
    X.register_function(s, "word_chunks", X.WordChunks)
    table(s, d, "documents").createOrReplaceTempView("documents_to_chunk")
    return s.sql("SELECT d.doc_id, c.* FROM documents_to_chunk d, LATERAL word_chunks(d.text, map('size', '50', 'overlap', '10', 'digest', 'yes')) c")


_PLAIN = r"regexp_extract_all(coalesce({}, ''), '[^ \t\n\r\f\v]+')"
register(
    "ext2_parsers",
    f"""WITH t AS (SELECT doc_id, (['web', 'news', 'forum'])[CAST(doc_id % 3 + 1 AS INT)] AS type, text FROM documents),
    l AS (SELECT doc_id, type, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM t WHERE type <> 'forum'),
    c AS (SELECT doc_id, type, ws, unnest(range(0, len(ws), 40)) AS pos FROM (SELECT *, {_PLAIN.format('text')} AS ws FROM t WHERE type = 'forum') WHERE len(ws) > 0)
    SELECT doc_id, type, CAST(k AS INT) AS line_no, CAST(len({_PLAIN.format('line')}) AS INT) AS words, line, CAST(1 + length(line) - length(replace(line, ',', '')) AS INT) AS fields, 'line_records' AS parser,
        CAST(NULL AS INT) AS chunk_no, CAST(NULL AS INT) AS first_word, CAST(NULL AS INT) AS n_words, CAST(NULL AS VARCHAR) AS content FROM l WHERE len({_PLAIN.format('line')}) > 0
    UNION ALL SELECT doc_id, type, NULL, NULL, NULL, NULL, 'plain_chunks', CAST(pos // 40 AS INT), CAST(pos AS INT), CAST(least(40, len(ws) - pos) AS INT), array_to_string(ws[pos + 1 : pos + 40], ' ') FROM c""",
    parsed,
)
register(
    "ext3_word_chunks",
    f"""SELECT doc_id, CAST(pos // 40 AS INT) AS chunk_no, CAST(pos AS INT) AS first_word, CAST(least(50, len(ws) - pos) AS INT) AS n_words, array_to_string(ws[pos + 1 : pos + 50], ' ') AS content, md5(array_to_string(ws[pos + 1 : pos + 50], ' ')) AS digest
    FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 10, 1), 40)) AS pos FROM (SELECT doc_id, {_PLAIN.format('text')} AS ws FROM documents) WHERE len(ws) > 0)""",
    chunked,
)


# an approximate search has no SQL of its own: a test measures its recall
def approximate(s, d):
    vectors = table(s, d, "embeddings")
    index = N.build_ann_index(vectors, new_folder(s, "ann"))
    return N.search_ann(index, vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5).withColumn("score", F.round("score", 6))


QUERIES["vec6_ann_topk"] = approximate


# circles among chunks that depend on the next one (by name, and a function and a method may share theirs), and in every third document the last on the first
def chained_chunks(s, d):
    by_place = Window.partitionBy("doc_id").orderBy("chunk_no")
    after, begin = F.lead("name").over(by_place), F.first("name").over(by_place)
    own = F.when(after.isNotNull(), F.array(after)).when(F.col("doc_id") % 3 == 0, F.array(begin)).otherwise(F.array().cast("array<string>"))
    return W.pattern_chunks(s, d).withColumn("dependencies", own)


def dependency_scores(s, d):
    chunks = chained_chunks(s, d)
    circles = SE.circular_dependencies(QL.dependency_edges(chunks)).withColumnRenamed("group", "doc_id")
    scores = QL.assess(chunks, W.code_view(s, d), cyclic=circles).select("doc_id", "dependency")
    return scores.join(circles.withColumn("circle", F.lit(True)), "doc_id", "left").fillna(False, ["circle"])


register(
    "qlt5_with_circles",
    """WITH c AS (SELECT *, lead(name) OVER w AS after, first_value(name) OVER w AS begin FROM pattern_chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_no)),
    k AS (SELECT doc_id, chunk_no, name, content, CASE WHEN after IS NOT NULL THEN [after] WHEN doc_id % 3 = 0 THEN [begin] ELSE [] END AS deps, coalesce(after = name, doc_id % 3 = 0) AS closes FROM c),
    m AS (SELECT a.doc_id, least(5, count(*)) AS n FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.chunk_no <> b.chunk_no AND contains(a.content, b.name) AND NOT list_contains(a.deps, b.name) GROUP BY 1),
    g AS (SELECT doc_id, max(len(deps) > 0) AS deps, max(closes) AS circle FROM k GROUP BY doc_id)
    SELECT doc_id, coalesce(circle, false) AS circle, round(greatest(0.0, least(1.0, 0.8 + CASE WHEN deps THEN 0.1 ELSE 0 END - CASE WHEN circle THEN 0.3 ELSE 0 END - 0.1 * coalesce(n, 0))), 6)::DOUBLE AS dependency
    FROM code_view LEFT JOIN g USING (doc_id) LEFT JOIN m USING (doc_id)""",
    dependency_scores,
)


# requests, deletions and usage
def asked_access(s, d):
    requests = table(s, d, "events").select("event_id", "user_id", (F.col("event_id") % 100 + 1).alias("collection_id"))
    users = table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("workspace_id"))
    return A.check_requests(requests, W.collections(s, d), W.members(s, d), users)


register(
    "acl1_requests",
    """SELECT event_id, e.user_id, collection_id, coalesce(c.workspace_id = u.c_nationkey AND (c.visibility IN ('public', 'internal') OR c.owner_id = e.user_id
        OR EXISTS (SELECT 1 FROM members m WHERE m.collection_id = e.collection_id AND m.user_id = e.user_id AND m.is_active)), false) AS allowed
    FROM (SELECT event_id, user_id, event_id % 100 + 1 AS collection_id FROM events) e LEFT JOIN collections c USING (collection_id) LEFT JOIN customer u ON u.c_custkey = e.user_id""",
    asked_access,
)


def deleted(s, d):
    tables = {n: table(s, d, n) for n in ("customer", "orders", "lineitem")}
    references = [A.Reference("customer", "c_custkey", "orders", "o_custkey"), A.Reference("orders", "o_orderkey", "lineitem", "l_orderkey")]
    left = A.hard_delete(tables, references, "customer", tables["customer"].where("c_acctbal < 0").select("c_custkey"))
    return left["lineitem"].select("l_orderkey", "l_linenumber")


register("rel4_hard_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0)", deleted)


def usage(s, d):
    docs = table(s, d, "documents").select(F.col("source").alias("collection"), F.col("lang").alias("type"), F.octet_length("text").cast("long").alias("bytes"), ((F.col("doc_id") % 101) / 100).alias("quality"))
    points = table(s, d, "embeddings").join(table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("collection")), "vec_id")
    queries = table(s, d, "events").join(table(s, d, "documents").select(F.col("doc_id").alias("event_id"), F.col("source").alias("collection")), "event_id")
    return SE.collection_usage(docs, points, queries.select("collection", F.concat("event_type", F.lit(" "), (F.col("user_id") % 7).cast("string")).alias("query"), "ts"))


_BY = "(SELECT collection, string_agg({v} || '=' || n, ',' ORDER BY {v}) AS {name} FROM (SELECT collection, {v}, {n} AS n FROM {of} WHERE {v} IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"
register(
    "ana3_collection_usage",
    f"""WITH o AS (SELECT source AS collection, lang AS type, strlen(text) AS bytes, printf('%.2f', least(floor((doc_id % 101) / 100.0 * 10), 9) / 10.0) AS bin FROM documents),
    e AS (SELECT source AS collection, event_type || ' ' || (user_id % 7) AS query, strftime(ts, '%Y-%m-%d') AS day FROM events JOIN documents ON doc_id = event_id),
    p AS (SELECT collection, query, count(*) AS n, row_number() OVER (PARTITION BY collection ORDER BY count(*) DESC, query) AS k FROM e GROUP BY 1, 2)
    SELECT collection, storage, storage_by_type, quality_histogram, coalesce(vectors, 0) AS vectors, daily_queries, popular_queries
    FROM (SELECT collection, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS storage FROM o GROUP BY 1)
    LEFT JOIN {_BY.format(v='type', n='CAST(sum(bytes) AS BIGINT)', of='o', name='storage_by_type')} USING (collection) LEFT JOIN {_BY.format(v='bin', n='count(*)', of='o', name='quality_histogram')} USING (collection)
    LEFT JOIN (SELECT source AS collection, count(*) AS vectors FROM embeddings JOIN documents ON doc_id = vec_id GROUP BY 1) USING (collection)
    LEFT JOIN {_BY.format(v='day', n='count(*)', of='e', name='daily_queries')} USING (collection)
    LEFT JOIN (SELECT collection, string_agg(n || ' ' || query, ' | ' ORDER BY k) AS popular_queries FROM p WHERE k <= 5 GROUP BY 1) USING (collection)""",
    usage,
)
