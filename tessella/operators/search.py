"""Searches that join vectors, keywords and tenants, and indexing from texts to points (RET, ACL, SRC)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settled
from .chunks import chunk_by_lines
from .embedding import embed, fit_embedder
from .retrieval import keyword_score, rrf_fuse, simple_fuse, weighted_fuse
from .vectors import Match, metadata_filter, vector_topk

#: The least keyword score of a keyword hit, and how far its vector threshold lies below the search's.
LEAST_KEYWORDS, RELAXED, LEAST_VECTOR = 0.1, 0.2, 0.1


def nearest(queries: DataFrame, vectors: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """The best 2k vectors of each query, written once: what the searches below choose from, so that vectors are scanned once for all of them."""
    return settled(vector_topk(queries.select("query_id", "embedding"), vectors, 2 * k, where=where))


def keyword_search(queries: DataFrame, vectors: DataFrame, docs: DataFrame, k: int, min_score: float = 0.0, where: Column | None = None, near: DataFrame | None = None) -> DataFrame:
    """RET2: (query_id, doc_id, score, vector_score, rank): of the best 2k vectors of each (query_id, embedding, keywords) those that hold keywords, the best ``k`` by their share.

    Ties keep the vectors' order. Queries without keywords have no hits; vectors are those of the documents of the same id. ``near``
    is what ``nearest`` gave for these queries, or for more.
    """
    asked = queries.where(F.size("keywords") > 0)
    least = max(LEAST_VECTOR, min_score - RELAXED)
    near = vector_topk(asked.select("query_id", "embedding"), vectors, 2 * k, least, where) if near is None else near.where(F.col("score") >= least)
    found = near.join(asked.select("query_id", "keywords"), "query_id").join(docs.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    scored = found.select("query_id", F.col("vec_id").alias("doc_id"), keyword_score(F.col("keywords"), F.col("text")).alias("score"), F.col("score").alias("vector_score"), F.col("rank").alias("_r"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "_r")
    return scored.where(F.col("score") >= LEAST_KEYWORDS).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_r")


def vector_search(queries: DataFrame, vectors: DataFrame, k: int, min_score: float | None = None, where: Column | None = None, near: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the best ``k`` documents by their vectors."""
    if near is None:
        hits = vector_topk(queries.select("query_id", "embedding"), vectors, k, min_score, where)
    else:
        hits = near.where(F.col("rank") <= k).join(queries.select("query_id"), "query_id", "left_semi")
        hits = hits if min_score is None else hits.where(F.col("score") >= min_score)
    return hits.withColumnRenamed("vec_id", "doc_id")


def hybrid_search(queries: DataFrame, vectors: DataFrame, docs: DataFrame, k: int, min_score: float = 0.0, method: str = "rrf", where: Column | None = None, near: DataFrame | None = None) -> DataFrame:
    """RET7: (query_id, doc_id, score, rank): vector and keyword hits fused by rrf, weighted or simple, the best ``k``; ties by id."""
    base = nearest(queries, vectors, k, where) if near is None else near
    close, words = vector_search(queries, vectors, k, min_score, where, base), keyword_search(queries, vectors, docs, k, min_score, where, base)
    if method == "rrf":
        both = close.select("query_id", "doc_id", "rank").unionByName(words.select("query_id", "doc_id", "rank"))
        fused = rrf_fuse(both).select("query_id", "doc_id", "score")
    else:
        fused = {"weighted": weighted_fuse, "simple": simple_fuse}[method](close, words)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def adaptive_search(queries: DataFrame, vectors: DataFrame, docs: DataFrame, k: int, min_score: float = 0.0, method: str = "rrf") -> DataFrame:
    """RET7: queries with type and complexity go each to the search that suits them: keyword ones to keywords, simple ones that are no code to vectors, the others to both.

    The vectors are scanned once, for all queries.
    """
    route = F.when(F.col("type") == "code", "hybrid").when(F.col("type") == "keyword", "keyword").when(F.col("complexity") == "simple", "vector").otherwise("hybrid")
    routed, near = queries.withColumn("_route", route), nearest(queries, vectors, k)
    ways: dict[str, Callable[[DataFrame], DataFrame]] = {
        "hybrid": lambda q: hybrid_search(q, vectors, docs, k, min_score, method, near=near),
        "keyword": lambda q: keyword_search(q, vectors, docs, k, min_score, near=near),
        "vector": lambda q: vector_search(q, vectors, k, min_score, near=near),
    }
    out = None
    for name, way in ways.items():
        part = way(routed.where(F.col("_route") == name)).select("query_id", "doc_id", "score", "rank", F.lit(name).alias("strategy"))
        out = part if out is None else out.unionByName(part)
    return out


def tenant_collection(workspace: Column, name: Column) -> Column:
    """ACL7: ws_{the workspace's id without hyphens, 16 characters at most}_{name in lower case, hyphens as underscores}."""
    return F.concat(F.lit("ws_"), F.left(F.replace(workspace.cast("string"), F.lit("-"), F.lit("")), F.lit(16)), F.lit("_"), F.lower(F.replace(name, F.lit("-"), F.lit("_"))))


def tenant_tag(points: DataFrame, workspace: Column, collection: Column, creator: Column) -> DataFrame:
    """ACL7: ``points`` with what every point of a tenant carries; columns of these names are replaced, so an old collection migrates by it."""
    return points.withColumns({"workspace_id": workspace, "tenant_id": F.concat(F.lit("ws_"), workspace.cast("string")), "created_by": creator, "tenant_collection": tenant_collection(workspace, collection)})


def tenant_search(queries: DataFrame, points: DataFrame, k: int, include_private: bool = False, extra: dict | None = None) -> DataFrame:
    """ACL8: (query_id, vec_id, score, rank) of (query_id, embedding, workspace_id, user_id): the best ``k`` points of the own workspace and tenant that are public, internal or the user's own.

    The points carry the columns of ``tenant_tag`` and visibility; ``extra`` is a further filter. All queries are answered in one
    scan, each with its own view of the points.
    """
    open_to_all = F.coalesce(F.col("visibility").isin("public", "internal"), F.lit(False)).alias("_open")
    seen = points.where(F.col("tenant_id") == F.concat(F.lit("ws_"), F.col("workspace_id").cast("string"))).where(metadata_filter(extra or {}))
    test = (lambda q, v: q[0] == v[0]) if include_private else (lambda q, v: (q[0] == v[0]) & ((v[1] == True) | (q[1] == v[2])))  # noqa: E712
    own = Match(("workspace_id", "user_id"), ("workspace_id", "_open", "created_by"), test)
    return vector_topk(queries, seen.select("vec_id", "embedding", "workspace_id", open_to_all, "created_by"), k, match=own)


def user_collections(collections: DataFrame, members: DataFrame, role: str | None = None) -> DataFrame:
    """ACL6: (user_id, collection_id, name, role) of active members, of one role if it is named."""
    active = members.where("is_active") if role is None else members.where(F.col("is_active") & (F.col("role") == role))
    return active.join(collections.select("collection_id", "name"), "collection_id").select("user_id", "collection_id", "name", "role")


def public_collections(collections: DataFrame, search: str | None = None, fields: tuple[str, ...] = ("name",)) -> DataFrame:
    """ACL6: public collections, those one of whose fields holds the search text, whatever its case."""
    public = collections.where("visibility = 'public'")
    if search:
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.coalesce(F.col(f).ilike(f"%{search}%"), F.lit(False))
        public = public.where(hit)
    return public


def build_index(docs: DataFrame, vectors: Callable[[DataFrame], DataFrame] | None = None, block: int = 50) -> DataFrame:
    """SRC7: from documents (doc_id, collection, path, text) to points: id {doc}_chunk_{i}, the chunk's place and content, and the document's metadata.

    ``vectors`` adds a vector column to a frame of points, by whatever model (``embed_with`` of a registered one); without it points have none. No shuffle: write them
    with ``partitionBy("collection")``.
    """
    chunks = chunk_by_lines(docs.select("doc_id", "collection", "path", "text"), block)
    points = chunks.select(F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("chunk_no").cast("string")).alias("id"), "collection", "doc_id", F.col("path").alias("source_file"), F.col("chunk_no").alias("chunk_index"), "start_line", "end_line", "content")
    return points if vectors is None else vectors(points)


#: Places of a point's key that hold the chunk's number, which is below 2 to this power.
CHUNK_BITS = 20


def index_texts(docs: DataFrame, block: int = 50, dim: int = 64) -> tuple[DataFrame, DataFrame]:
    """SRC7 with VEC9: (points with embedding, model): the vectors of all chunks by a model of the chunks themselves.

    The model is written once. Points meet their vectors by id, so contents are shuffled once.
    """
    points = build_index(docs, block=block)
    model = settled(fit_embedder(points, dim, text_col="content"))
    return points.join(embed(points, model, "id", "content"), "id"), model


def search_points(queries: DataFrame, points: DataFrame, model: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): for each (query_id, text) the ``k`` points nearest to the text's own vector (VEC9, VEC3); ties by document and chunk.

    Texts without a vector have no hits. The search works on whole numbers, made of document and chunk: a document of 2^20
    chunks is an error.
    """
    wide = F.col("chunk_index") >= (1 << CHUNK_BITS)
    key = F.when(wide, F.raise_error(F.lit("a document has too many chunks")).cast("long")).otherwise(F.shiftleft("doc_id", CHUNK_BITS) + F.col("chunk_index"))
    asked = embed(queries, model, "query_id").where("embedding is not null")
    hits = vector_topk(asked, points.where("embedding is not null").select(key.alias("vec_id"), "embedding"), k)
    name = F.concat(F.shiftright("vec_id", CHUNK_BITS).cast("string"), F.lit("_chunk_"), F.col("vec_id").bitwiseAND(F.lit((1 << CHUNK_BITS) - 1)).cast("string"))
    return hits.select("query_id", name.alias("id"), "score", "rank")


def recent(log: DataFrame, since: Column, by: str = "user_id", n: int = 10) -> DataFrame:
    """REL6: each user's newest ``n`` rows from a time on."""
    order = Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("event_id"))
    return log.where(F.col("ts") >= since).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def query_suggestions(log: DataFrame, terms: DataFrame, limit: int = 9, prefix: str = "") -> DataFrame:
    """ANA19: (collection, user_id, suggestion, place): a third each of a collection's popular queries, the user's recent ones and content terms.

    ``log`` has (collection, user_id, query, at), ``terms`` (collection, term, n). They are asked in that order, filtered by the
    text they have to hold, counted once, and numbered. Every user of a collection gets its popular queries and terms.
    """
    third = limit // 3
    best = lambda df, by, *order: df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= third)
    popular = best(log.groupBy("collection", "query").agg(F.count("*").alias("n")), ["collection"], F.desc("n"), "query").select("collection", F.col("query").alias("suggestion"), F.lit(1).alias("_from"), "_k")
    content = best(terms, ["collection"], F.desc("n"), "term").select("collection", F.col("term").alias("suggestion"), F.lit(3).alias("_from"), "_k")
    users = log.select("collection", "user_id").distinct()
    common = users.join(popular.unionByName(content), "collection")
    own = best(log.groupBy("collection", "user_id", "query").agg(F.max("at").alias("at")), ["collection", "user_id"], F.desc("at"), "query").select("collection", "user_id", F.col("query").alias("suggestion"), F.lit(2).alias("_from"), "_k")
    every = common.unionByName(own)
    if prefix:
        every = every.where(F.contains(F.lower("suggestion"), F.lit(prefix.lower())))
    once = every.groupBy("collection", "user_id", "suggestion").agg(F.min(F.struct("_from", "_k")).alias("at"))
    order = Window.partitionBy("collection", "user_id").orderBy("at", "suggestion")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("collection", "user_id", "suggestion", "place")


def counts_by(df: DataFrame, value: str, name: str, weight: Column | None = None) -> DataFrame:
    """(collection, name): each collection's rows (or their summed weight) by value, as "value=n" joined by commas in order of value."""
    counts = df.where(F.col(value).isNotNull()).groupBy("collection", value).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), "n"))), lambda x: F.concat(x["v"].cast("string"), F.lit("="), x["n"].cast("string")))
    return counts.groupBy("collection").agg(F.array_join(pairs, ",").alias(name))


def collection_usage(docs: DataFrame, points: DataFrame, queries: DataFrame, popular: int = 5, bins: int = 10) -> DataFrame:
    """ANA3: per collection its quality histogram, vectors, queries by day, popular queries, and bytes in all and by type.

    ``docs`` (collection, type, bytes, quality between 0 and 1), ``points`` (collection, embedding), ``queries`` (collection, query,
    ts). The histogram has ``bins`` equal bins, named by their lower bounds, the last one with 1; documents without a quality are in none. A
    collection's ``popular`` most frequent queries are "n query" joined by " | ", ties by the text; counts are taken before
    anything is ranked, so a row holds one entry a value.
    """
    at = F.least(F.floor(F.col("quality") * bins), F.lit(bins - 1)) / bins
    histogram = counts_by(docs.withColumn("_bin", F.when(F.col("quality").isNotNull(), F.format_number(at, 2))), "_bin", "quality_histogram")
    vectors = points.where("embedding is not null").groupBy("collection").agg(F.count("*").alias("vectors"))
    days = counts_by(queries.withColumn("_day", F.date_format("ts", "yyyy-MM-dd")), "_day", "daily_queries")
    asked = queries.where("query is not null").groupBy("collection", "query").agg(F.count("*").alias("n"))
    ranked = asked.withColumn("_k", F.row_number().over(Window.partitionBy("collection").orderBy(F.desc("n"), "query"))).where(F.col("_k") <= popular)
    said = F.transform(F.array_sort(F.collect_list(F.struct("_k", "n", "query"))), lambda x: F.concat_ws(" ", x["n"].cast("string"), x["query"]))
    top = ranked.groupBy("collection").agg(F.array_join(said, " | ").alias("popular_queries"))
    out = docs.groupBy("collection").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("storage"))
    for more in (counts_by(docs, "type", "storage_by_type", F.col("bytes")), histogram, vectors, days, top):
        out = out.join(more, "collection", "left")
    return out.fillna(0, ["vectors"])


def collection_stats(docs: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """ANA3: per collection its documents (by type and language), chunks and their mean lines, and queries, successes, mean time and kinds.

    ``docs`` (collection, type, lang), ``chunks`` (collection, lines), ``queries`` (collection, query_type, status, seconds). Counts by
    value are "value=n" joined by commas in order of value; they are aggregated by value first, so a row holds one entry a value.
    """

    own = docs.groupBy("collection").agg(F.count("*").alias("documents"))
    parts = chunks.groupBy("collection").agg(F.count("*").alias("chunks"), F.round(F.avg("lines"), 6).alias("avg_lines"))
    asked = queries.groupBy("collection").agg(F.count("*").alias("queries"), F.count_if(F.col("status") == "completed").alias("successful"), F.round(F.avg("seconds"), 6).alias("avg_seconds"))
    out = own
    for more in (counts_by(docs, "type", "by_type"), counts_by(docs, "lang", "by_language"), parts, asked, counts_by(queries, "query_type", "query_types")):
        out = out.join(more, "collection", "left")
    return out.fillna(0, ["chunks", "queries", "successful"])


def settings_history(changes: DataFrame, settings: DataFrame, users: DataFrame, n: int = 100) -> DataFrame:
    """REL8: the newest ``n`` changes with the setting's key (changes of unknown settings are left out) and who made them, if known."""
    known = changes.join(settings.select("setting_id", "key"), "setting_id").join(users, "user_id", "left")
    return known.orderBy(F.desc("changed_at"), F.desc("change_id")).limit(n).select("change_id", "key", "user_name", "changed_at")


def circular_dependencies(edges: DataFrame, rounds: list | None = None) -> DataFrame:
    """QLT13: (group): the groups whose (group, src, dst) edges hold a directed circle, a chunk that depends on itself included.

    A round takes edges away that leave a node without predecessors or enter one without successors, and then draws every
    node with one predecessor into the first of its chain that has none or several: chains are followed by pointer doubling, so
    a path is gone in one round, in as many joins as its length has bits. A chain without such a first node is a circle, as
    is an edge from a node to itself. When a round changes nothing every node left has a predecessor: the rest are circles too.
    Each round's edges are checkpointed. ``rounds``, if given, gets how many edges each round has left.
    """
    rest = settled(edges.where("src is not null and dst is not null").select("group", "src", "dst").distinct())
    n, circles = rest.count(), []
    while n:
        loops = rest.where("src = dst").select("group").distinct()
        fed = rest.select("group", F.col("dst").alias("src")).distinct()
        feeding = rest.select("group", F.col("src").alias("dst")).distinct()
        inner = rest.join(loops, "group", "left_anti").join(fed, ["group", "src"], "left_semi").join(feeding, ["group", "dst"], "left_semi")
        inner = settled(inner.select("group", "src", "dst"))
        heads, endless = _heads(inner)
        circles += [settled(loops), endless]
        drawn = inner.join(endless, "group", "left_anti").join(heads.select("group", F.col("node").alias("dst")), ["group", "dst"], "left_anti")
        drawn = drawn.join(heads.select("group", F.col("node").alias("src"), "head"), ["group", "src"], "left")
        rest = settled(drawn.select("group", F.coalesce("head", "src").alias("src"), "dst").distinct())
        left = rest.count()
        if rounds is not None:
            rounds.append(left)
        if left == n:
            circles.append(rest.select("group"))
            break
        n = left
    return reduce(DataFrame.unionByName, circles).distinct() if circles else rest.select("group").limit(0)


def _heads(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(group, node, head) of the nodes with one predecessor, where their chain begins; and the groups with chains that begin nowhere."""
    one = edges.groupBy("group", F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("up")).where("n = 1")
    now = settled(one.select("group", "node", "up"))
    chained = now.select("group", F.col("node").alias("up"), F.col("up").alias("next"))
    before = None
    while True:
        both = now.join(chained, ["group", "up"], "left")
        open_ = both.where("next is not null").count()
        if open_ == before or not open_:
            break
        before = open_
        now = settled(both.select("group", "node", F.coalesce("next", "up").alias("up")))
        chained = now.select("group", F.col("node").alias("up"), F.col("up").alias("next"))
    endless = settled(both.where("next is not null").select("group").distinct())
    return now.select("group", "node", F.col("up").alias("head")), endless
