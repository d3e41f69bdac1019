"""Query expansion and re-ranking of hits by features of query and content (QRY, RET)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.profile import WORD
from .quality import _any

#: What each feature weighs; one that isn't listed weighs OTHER_WEIGHT.
FEATURE_WEIGHTS = {"semantic_similarity": 0.4, "keyword_match": 0.2, "content_quality": 0.15, "freshness": 0.1, "source_authority": 0.1}
OTHER_WEIGHT = 0.1
#: Signs of code, of an answer, and lengths that suit a kind of query.
CODE_SIGNS = (r"def\s+\w+", r"class\s+\w+", r"import\s+\w+", r"\w+\.\w+\(", r"if\s+\w+", r"for\s+\w+", r"return\s+")
ANSWER_SIGNS = (
    "because", "since", "due to", "as a result", "therefore", "thus", "hence", "consequently", "the reason", "this is", "it works", "you can", "to do this", "the solution", "the answer",
)
NAMED_CODE = {"function": (r"def\s+\w+", 0.3), "class": (r"class\s+\w+", 0.3), "import": (r"import\s+\w+", 0.2)}
ANSWERS_TO = {"how": ("step", "method"), "what": ("definition", "means"), "why": ("reason", "because")}
LENGTHS = {"semantic": (100, 1000), "code": (50, 500), "question": (100, 800), "summary": (200, 1500), "keyword": (50, 800)}
#: Words of code with others of the same meaning, and words that begin a question.
SYNONYMS = {
    "function": ("method", "def", "func"), "class": ("object", "type"), "variable": ("var", "field", "attribute"), "import": ("include", "require", "using"), "return": ("returns", "output"),
    "parameter": ("param", "argument", "arg"), "error": ("exception", "bug", "issue"), "test": ("testing", "unittest", "spec"),
}
QUESTION_START = r"^(?:what|how|why|when|where|who|which|can|could|would|should|is|are|does|do|did)\s+"


def _points(*tests: tuple[Column, float]) -> Column:
    return sum((F.when(test, x).otherwise(0.0) for test, x in tests), F.lit(0.0))


def expand(query: Column, kind: Column, most: int = 5) -> Column:
    """QRY6: the first 5 distinct of: beginnings, runs of 2 words or more, synonyms of code words, and questions as statements.

    Beginnings and runs have more than 3 characters and aren't the query itself. A null query has none.
    """
    words = F.filter(F.split(query, r"\s+", -1), lambda w: w != "")
    n = F.size(words)
    join = lambda i, k: F.array_join(F.slice(words, i, k), " ")
    none = F.array().cast("array<string>")
    first = F.when(n > 1, F.transform(F.sequence(F.lit(1), n), lambda k: join(F.lit(1), k))).otherwise(none)
    runs = F.when(n > 2, F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(F.lit(2), n - i + 1), lambda k: join(i, k))))).otherwise(none)
    usual = F.filter(F.concat(first, runs), lambda v: (v != query) & (F.length(v) > 3))
    low = F.lower(query)
    code = F.filter(F.array(*[F.when(F.contains(low, F.lit(w)), F.replace(low, F.lit(w), F.lit(s))) for w, ss in SYNONYMS.items() for s in ss]), lambda v: v.isNotNull() & (v != low))
    statement = F.trim(F.regexp_replace(F.regexp_replace(low, QUESTION_START, ""), r"\?+$", ""))
    asked = F.filter(F.array(F.when(statement != low, statement), F.when(F.startswith(low, F.lit("how to")), F.trim(F.replace(low, F.lit("how to"), F.lit(""))))), lambda v: v.isNotNull() & (v != ""))
    return F.slice(F.array_distinct(F.concat(usual, F.when(kind == "code", code).when(kind == "question", asked).otherwise(none))), 1, most)


def word_set(text: Column) -> Column:
    """The distinct words of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1))


def keyword_match(asked: Column, words: Column, inside: Column) -> Column:
    """RET9: of the query's ``asked`` words the share that are words of the content, and half the share found inside its lower-case text; at most 1."""
    return F.when(asked > 0, F.least(F.lit(1.0), words / asked + inside / asked * 0.5)).otherwise(F.lit(0.0))


def content_quality(content: Column) -> Column:
    """RET9: the mean of length, structure, completeness and language scores."""
    n = F.length(content)
    length = F.when(n.between(200, 800), 1.0).when(n < 200, n / 200).otherwise(800 / n)
    structure = F.least(F.lit(1.0), 0.5 + _points((F.contains(content, F.lit("\n")), 0.2), (_any(content, ("def ", "class ", "function ", "import ")), 0.2), (_any(content, ("# ", "* ", "- ")), 0.1)))
    complete = F.when(F.endswith(content, F.lit("...")), 0.8).otherwise(1.0)
    sentences, words = F.split(content, r"\. ", -1), F.filter(F.split(content, r"\s+", -1), lambda w: w != "")
    mean = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)) / F.greatest(F.size(words), F.lit(1))
    language = 0.5 + F.size(F.filter(sentences, lambda s: s.rlike(r"^\p{Lu}"))) / F.size(sentences) * 0.3 + _points(((F.size(words) > 0) & mean.between(3, 8), 0.2))
    return (length + structure + complete + F.least(F.lit(1.0), language)) / 4


def code_relevance(signs: Column, named: dict[str, Column]) -> Column:
    """RET9: ``signs`` (0.1 for each sign of code) and more for those that the query names and the content has."""
    return F.least(F.lit(1.0), signs + _points(*[(named[w], x) for w, (_, x) in NAMED_CODE.items()]))


def answer_likelihood(signs: Column, fits: dict[str, Column]) -> Column:
    """RET9: ``signs`` (0.1 for each sign of an answer) and 0.2 where the content fits a question word of the query."""
    return F.least(F.lit(1.0), signs + _points(*[(fits[w], 0.2) for w in ANSWERS_TO]))


def source_authority(path: Column, kind: Column) -> Column:
    """RET9: higher for documentation and main files, lower for tests; between 0 and 1."""
    low = F.coalesce(F.lower(path), F.lit(""))
    score = 0.5 + _points((_any(low, ("readme", "doc", "guide", "tutorial")), 0.3), (_any(low, ("test", "spec", "mock")), -0.2), (_any(low, ("main", "core", "index", "app")), 0.2), (kind.isin("markdown", "documentation"), 0.2), (kind == "code", 0.1))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def length_fit(n: Column, kind: Column) -> Column:
    """RET9: 1 within the lengths that suit the kind of query, else the share of the nearer bound, of a content of ``n`` characters."""
    bound = lambda i: F.coalesce(*[F.when(kind == k, F.lit(v[i])) for k, v in LENGTHS.items()], F.lit(LENGTHS["semantic"][i]))
    return F.when(n < bound(0), n / bound(0)).when(n > bound(1), bound(1) / n).otherwise(F.lit(1.0))


def prepare_contents(docs: DataFrame, path: Column, document_type: Column, dated: Column, text_col: str = "text") -> DataFrame:
    """RET9: what depends on a document alone, worked out where it is read, in place of its text: numbers, and ``_words``, its
    distinct words in one string. A null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lower(text)
    return docs.select(
        "doc_id", F.array_join(word_set(text), "\n").alias("_words"), F.length(text).alias("_n"), content_quality(text).alias("_quality"),
        _points(*[(text.rlike(f"(?i){p}"), 0.1) for p in CODE_SIGNS]).alias("_code"), _points(*[(F.contains(low, F.lit(a)), 0.1) for a in ANSWER_SIGNS]).alias("_answer"),
        *[text.rlike(p).alias(f"_named_{w}") for w, (p, _) in NAMED_CODE.items()], *[_any(low, marks).alias(f"_fits_{w}") for w, marks in ANSWERS_TO.items()],
        F.when(dated, 0.7).otherwise(0.5).alias("_freshness"), source_authority(path, document_type).alias("_authority"),
    )


#: Rows that become Python values at a time.
ROWS = 1_000


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (doc_id, query_id, score, said, _doc, _query), a document's words before its hits: each hit with its document's ``_doc``, its asked
    words that are the document's, and those inside one of them."""
    doc, words, text, inside, last = None, frozenset(), "", {}, None
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part, row, of, n_whole, n_inside = batch.slice(lo, ROWS), [], [], [], []
            last = pa.nulls(1, part.column(4).type) if last is None else last
            own, at = pa.concat_arrays([last, part.column(4)]), 0
            for i, (d, q, said) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist())):
                if q is None:
                    doc, words, text, inside, at = d, frozenset(said.split("\n")), said, {}, i + 1
                elif d == doc:
                    asked = said.split("\n") if said else []
                    for w in asked:
                        if w not in inside:
                            inside[w] = w in words or w in text
                    row.append(i)
                    of.append(at)
                    n_whole.append(sum(w in words for w in asked))
                    n_inside.append(sum(map(inside.__getitem__, asked)))
            if row:
                q, d, score, query = (part.column(k).take(pa.array(row)) for k in (1, 0, 2, 5))
                yield pa.RecordBatch.from_arrays([q, d, score, pa.array(n_whole, pa.int32()), pa.array(n_inside, pa.int32()), own.take(pa.array(of)), query], names=["query_id", "doc_id", "score", "whole", "inside", "_doc", "_query"])
            last = own.take(pa.array([at]))


def count_words(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, score, whole, inside, _doc, _query) of hits (query_id, doc_id, score, asked, _query): how many of the ``asked`` words are words of the
    document (doc_id, _words, _doc), and how many stand inside its text, which is inside one of its words as both hold the same characters.

    Documents and hits are sorted together by document, so a document's words are read once and not copied to its hits. A query has a
    document once, so one document has at most as many hits as there are queries. What else is known of both sides goes along, so that hits are not
    shuffled again to meet it.
    """
    kinds = {"_doc": docs.schema["_doc"].dataType.simpleString(), "_query": hits.schema["_query"].dataType.simpleString()}
    none = lambda name: F.lit(None).cast(kinds[name]).alias(name)
    told = docs.select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("double").alias("score"), F.col("_words").alias("said"), "_doc", none("_query"))
    rows = hits.where(F.col("query_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("query_id").cast("long"), F.col("score").cast("double"), F.coalesce(F.array_join("asked", "\n"), F.lit("")).alias("said"), none("_doc"), "_query")
    together = told.unionByName(rows).repartition("doc_id").sortWithinPartitions("doc_id", "query_id")
    return together.mapInArrow(_count_words, "query_id long, doc_id long, score double, whole int, inside int, " + ", ".join(f"{n} {k}" for n, k in kinds.items()))


def rerank_features(hits: DataFrame, asked: DataFrame, docs: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """RET9: hits (query_id, doc_id, score) with what their features read, and the features.

    ``asked`` has (query_id, query, kind, asked), the last being the query's word set, ``docs`` the rows of ``prepare_contents``. Texts are not shuffled, and only
    numbers are joined to hits; hits meet their queries by one shuffle and documents by another, each read once. code_relevance and
    answer_likelihood are null for other kinds of query.
    """
    asks = [F.contains(F.lower("query"), F.lit(w)).alias(f"_asks_{w}") for w in (*NAMED_CODE, *ANSWERS_TO)]
    said = asked.select("query_id", "asked", F.struct(F.col("kind"), F.size("asked").alias("asked"), *asks).alias("_query"))
    own = docs.select("doc_id", "_words", F.struct(*[c for c in docs.columns if c not in ("doc_id", "_words")]).alias("_doc"))
    found = count_words(hits.join(said, "query_id"), own).select("query_id", "doc_id", "score", "whole", "inside", "_doc.*", "_query.*")
    kind = F.col("kind")
    told = lambda words, what: {w: F.col(f"_asks_{w}") & F.col(f"_{what}_{w}") for w in words}
    return found, {
        "semantic_similarity": F.col("score"), "keyword_match": keyword_match(F.col("asked"), F.col("whole"), F.col("inside")), "content_quality": F.col("_quality"),
        "code_relevance": F.when(kind == "code", code_relevance(F.col("_code"), told(NAMED_CODE, "named"))),
        "answer_likelihood": F.when(kind == "question", answer_likelihood(F.col("_answer"), told(ANSWERS_TO, "fits"))),
        "freshness": F.col("_freshness"), "source_authority": F.col("_authority"), "length_score": length_fit(F.col("_n"), kind),
    }


def rerank(hits: DataFrame, features: dict[str, Column], candidates: int = 50, k: int = 10) -> DataFrame:
    """RET10: of each query's best ``candidates`` hits the ``k`` best by the weighted mean of the features that are there; ties by id.

    ``hits`` has (query_id, doc_id, score) and the columns that the features read. Features and their mean are worked out where hits and documents meet, so
    what is shuffled and sorted by query is a row of four numbers.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    weight = {n: FEATURE_WEIGHTS.get(n, OTHER_WEIGHT) for n in features}
    total = sum((F.coalesce(c * weight[n], F.lit(0.0)) for n, c in features.items()), F.lit(0.0))
    there = sum((F.when(c.isNotNull(), weight[n]).otherwise(0.0) for n, c in features.items()), F.lit(0.0))
    scored = hits.select("query_id", "doc_id", "score", F.round(total / there, 6).alias("_mean"))
    taken = scored.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= candidates)
    out = taken.select("query_id", "doc_id", F.col("_mean").alias("score"))
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


#: Fixed value: the most characters of a content by which hits are told apart.
PREFIX = 200


def _beginning(hits: DataFrame, prefix: int) -> DataFrame:
    """``hits`` with a digest of the content's first characters in place of the content, so that no text is shuffled by query."""
    begins = F.unhex(F.sha2(F.left(F.coalesce("content", F.lit("")), F.lit(prefix)), 256))
    return hits.select("query_id", "doc_id", "collection", "score", "rank", begins.alias("_begins"))


def multi_collection_search(hits: DataFrame, limit: int = 10, prefix: int = PREFIX) -> DataFrame:
    """ACL9: hits (query_id, collection, rank, score, content, doc_id) of each collection; equal first 200 characters count once, as they
    arrived (by collection, then rank), and only then the best ``limit`` by score are ranked. Null contents count as empty."""
    arrival = Window.partitionBy("query_id", "_begins").orderBy("collection", "rank", "doc_id")
    once = _beginning(hits, prefix).withColumn("_n", F.row_number().over(arrival)).where("_n = 1")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "collection", "rank", "doc_id")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("query_id", "doc_id", "collection", "score", F.col("place").alias("rank"))


def cross_workspace_search(hits: DataFrame, limit: int = 10, prefix: int = 100) -> DataFrame:
    """ACL10: the hits of all workspaces by score first; then equal first 100 characters in one collection count once."""
    key = Window.partitionBy("query_id", "_begins", "collection").orderBy(F.desc("score"), "rank", "doc_id")
    once = _beginning(hits, prefix).withColumn("_n", F.row_number().over(key)).where("_n = 1")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "collection", "rank", "doc_id")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("query_id", "doc_id", "collection", "score", F.col("place").alias("rank"))
