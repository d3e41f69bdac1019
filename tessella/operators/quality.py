"""How good a chunking is, in eight dimensions per document and as a whole (QLT)."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

#: Lines that suit a purpose, and what the dimensions weigh; an unknown purpose counts as general.
SIZES = {"code_review": (50, 200), "documentation": (100, 300), "bug_detection": (30, 150), "general": (50, 150)}
DIMENSIONS = ("coherence", "context", "completeness", "granularity", "dependency", "readability", "maintainability", "performance")
WEIGHTS = {
    "code_review": (1.5, 1.0, 0.8, 1.0, 0.8, 1.3, 1.2, 0.5),
    "documentation": (1.0, 1.3, 1.5, 1.0, 0.8, 1.2, 0.7, 0.5),
    "general": (1.0,) * 8,
}
#: Constructs that have to be in some chunk, and signs that a chunk stands alone.
IMPORTANT = ("class ", "def ", "function ", "import ", "from ")
ALONE = ("import ", "from ", "require(", "include ", "def ", "class ", "function ", "var ", "let ", "const ")


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _any(content: Column, marks: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for m in marks:
        hit = hit | F.contains(content, F.lit(m))
    return hit


def chunk_scores(chunks: DataFrame) -> DataFrame:
    """QLT1, 2, 6, 10 per chunk (type, name, content, complexity, dependencies, lines): coherence, context, readability and its own score."""
    content, name, size = F.coalesce("content", F.lit("")), F.coalesce("name", F.lit("")), F.col("end_line") - F.col("start_line") + 1
    count = lambda sign: F.length(content) - F.length(F.replace(content, F.lit(sign), F.lit("")))
    named = F.regexp_extract_all(content, F.lit(r"(?m)(?:^|\s)(?:def|function)[ \t]+([^\s(]+|\()"), 1)
    prefixes = F.array_distinct(F.transform(F.filter(named, lambda n: F.contains(n, F.lit("_"))), lambda n: F.substring_index(n, "_", 1)))
    related = (F.size(named) >= 2) & (F.size(prefixes) < F.size(named))
    coherence = 0.8 + F.when(F.col("type").isin("function", "class", "method"), 0.1).otherwise(0.0) - F.when(count("{") != count("}"), 0.2).otherwise(0.0) + F.when(related, 0.1).otherwise(0.0)
    context = 0.7 + F.when(_any(content, ALONE), 0.2).otherwise(0.0) + F.when(F.size("dependencies") > 0, 0.1).otherwise(0.0)
    generic = F.startswith(name, F.lit("chunk_"))
    easy = F.when((F.col("complexity") > 0) & (F.col("complexity") <= 5), 0.1).when(F.col("complexity") > 8, -0.1).otherwise(0.0)
    own = 0.7 + F.when(size.between(20, 150), 0.1).otherwise(0.0) + F.when(F.col("type") != "unknown", 0.1).otherwise(0.0) + F.when((name != "") & ~generic, 0.1).otherwise(0.0)
    return chunks.select(
        "*", size.alias("lines"), _unit(coherence).alias("coherence"), _unit(context).alias("context"), _unit(0.7 + F.when((F.length(name) > 3) & ~generic, 0.2).otherwise(0.0) + easy).alias("readability"), _unit(own).alias("own")
    )


def missing_dependencies(chunks: DataFrame, most: int = 5) -> DataFrame:
    """QLT12: per document the first ``most`` "A -> B" where B's name is in A's content and not among A's dependencies, by A's place, then B's.

    A document's names come first and make one automaton, past which its chunks then stream in their order: the work is that of
    the text and of what is found, a task holds one document's names and one chunk, and no pairs are emitted. An empty name is in every
    content; a null name, content, place or list of dependencies, or a list that holds a null, makes no pair unless it is not needed.
    """
    part = "doc_id", "chunk_no", "name"
    names = chunks.select(*part, F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("array<string>").alias("dependencies"))
    texts = chunks.select(*part, F.lit(1).alias("_kind"), "content", "dependencies")
    rows = names.unionByName(texts).repartition("doc_id").sortWithinPartitions("doc_id", "_kind", "chunk_no", "name", "content", "dependencies")
    kind = chunks.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, held, automaton, found, begun = None, [], None, [], False
        for batch in batches:
            ids, out = [], []
            for who, place, name, sort, content, own in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or who != doc:
                    if begun:
                        ids.append(doc)
                        out.append(found)
                    doc, held, automaton, found, begun = who, [], None, [], True
                if sort == 0:
                    if name is not None and place is not None:
                        held.append((place, name))
                    continue
                if len(found) >= most or content is None or own is None or place is None or name is None:
                    continue
                automaton = automaton or _automaton([n for _, n in held])
                inside = set(automaton.find(content))
                for at, other in held if inside else ():
                    if len(found) < most and at != place and other in inside and other not in own and None not in own:
                        found.append(f"{name} -> {other}")
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(out, pa.list_(pa.string()))], names=["doc_id", "missing"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([doc], batch.schema.field(0).type), pa.array([found], pa.list_(pa.string()))], names=["doc_id", "missing"])

    return rows.select("doc_id", "chunk_no", "name", "_kind", "content", "dependencies").mapInArrow(run, StructType().add("doc_id", kind).add("missing", ArrayType(StringType())))


class _automaton:
    """Which of some names a text holds, whatever lies over each other."""

    def __init__(self, names: list[str]) -> None:
        self.empty = "" in names
        self.held = ahocorasick.Automaton()
        for name in names:
            if name:
                self.held.add_word(name, name)
        self.held.make_automaton()

    def find(self, text: str) -> Iterator[str]:
        if self.empty:
            yield ""
        if len(self.held):
            for _, name in self.held.iter(text):
                yield name


def dependency_edges(chunks: DataFrame) -> DataFrame:
    """(group, src, dst): of each document (group) which chunk depends on which, by name; names that no chunk of the document has are left out."""
    each = chunks.select(F.col("doc_id").alias("group"), F.col("name").alias("src"), F.explode("dependencies").alias("dst"))
    return each.join(chunks.select(F.col("doc_id").alias("group"), F.col("name").alias("dst")).distinct(), ["group", "dst"], "left_semi").select("group", "src", "dst")


def assess(chunks: DataFrame, docs: DataFrame, purpose: str = "general", seconds: Column | None = None, cyclic: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """QLT1-9: per document the eight scores and their weighted mean, ``overall``.

    ``seconds`` is the time the chunking took (a column of ``docs``; unknown: 0); ``cyclic`` has the doc_ids whose chunks depend on
    each other in a circle. A document without chunks has 0 for the means over chunks, and its null text counts as empty.
    """
    low, high = SIZES.get(purpose, SIZES["general"])
    before = F.lag("type").over(Window.partitionBy("doc_id").orderBy("chunk_no"))
    scored = chunk_scores(chunks).withColumn("_change", (F.col("type") != before).cast("int"))
    fits = F.when(F.col("lines").between(low, high), 1.0).when(F.col("lines") < low, 0.6).otherwise(0.7)
    per = scored.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.avg("coherence").alias("coherence"), F.avg("context").alias("context"), F.avg("readability").alias("readability"), F.sum("lines").alias("_covered"), F.avg(fits).alias("_fit"),
        F.var_samp("lines").alias("_var"), F.coalesce(F.sum("_change"), F.lit(0)).alias("_changes"), F.max(F.size("dependencies") > 0).alias("_deps"), *[F.max(F.contains("content", F.lit(p))).alias(f"_p{i}") for i, p in enumerate(IMPORTANT)],
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    marks = [F.contains(text, F.lit(p)).alias(f"_t{i}") for i, p in enumerate(IMPORTANT)]
    known = docs.select("doc_id", F.size(F.split(text, "\n", -1)).alias("_total"), (F.lit(0.0) if seconds is None else seconds).alias("_seconds"), *marks)
    if cyclic is None:
        known = known.withColumn("_cyclic", F.lit(False))
    else:
        known = known.join(cyclic.select("doc_id", F.lit(True).alias("_cyclic")).distinct(), "doc_id", "left").fillna(False, ["_cyclic"])
    all_ = known.join(per, "doc_id", "left").join(missing_dependencies(chunks), "doc_id", "left").fillna(0, ["n", "_changes", "_covered", "coherence", "context", "readability", "_fit"])
    lost = sum((F.when(F.col(f"_t{i}") & ~F.coalesce(f"_p{i}", F.lit(False)), 0.1).otherwise(0.0) for i in range(len(IMPORTANT))), F.lit(0.0))
    n = F.col("n")
    grain = (F.col("_fit") + F.when(n.between(3, 20), 1.0).when(n < 3, 0.6).otherwise(0.7)) / 2
    clear = 0.8 + F.when(F.col("_deps"), 0.1).otherwise(0.0) - F.when(F.col("_cyclic"), 0.3).otherwise(0.0) - 0.1 * F.greatest(F.size(F.coalesce("missing", F.array().cast("array<string>"))), F.lit(0))
    even = F.when(n == 1, 0.1).when(F.col("_var") < 100, 0.1).when(F.col("_var") > 500, -0.1).otherwise(0.0)
    keep = 0.8 + F.when(F.col("_changes") < n - 1, 0.1).otherwise(0.0) + even
    quick = 0.8 + F.when(F.col("_seconds") < 1, 0.2).when(F.col("_seconds") > 10, -0.2).otherwise(0.0) + F.when(n.between(5, 15), 0.1).when(n > 50, -0.1).otherwise(0.0)
    out = {"coherence": F.col("coherence"), "context": F.col("context"), "completeness": F.col("_covered") / F.col("_total") - lost, "granularity": grain, "dependency": clear, "readability": F.col("readability"), "maintainability": keep, "performance": quick}
    weights = WEIGHTS.get(purpose, WEIGHTS["general"])
    scores = all_.select("doc_id", *[_unit(c).alias(k) for k, c in out.items()])
    overall = sum((F.col(k) * w for k, w in zip(DIMENSIONS, weights)), F.lit(0.0)) / sum(weights)
    return scores.select("doc_id", *[F.round(k, 6).alias(k) for k in DIMENSIONS], F.round(overall, 6).alias("overall"))


def feedback_by_chunk(feedback: DataFrame, kinds: tuple[str, ...], last: int = 5) -> DataFrame:
    """QLT14: (chunk_id, feedback_id, kind, rating, comment) per chunk: count, mean rating without nulls (0 if there is none), one count per kind, and what the last 5 say."""
    recent = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("feedback_id")))
    said = F.array_sort(F.collect_list(F.when((F.col("_k") <= last) & (F.col("comment") != ""), F.struct("feedback_id", "comment"))))
    return feedback.withColumn("_k", recent).groupBy("chunk_id").agg(
        F.count("*").alias("n"), F.round(F.coalesce(F.avg("rating"), F.lit(0.0)), 6).alias("average_rating"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds], F.array_join(F.transform(said, lambda x: x["comment"]), "|").alias("recent")
    )


def top_suggestions(feedback: DataFrame, k: int = 10) -> DataFrame:
    """QLT15: the ``k`` most frequent of the suggestions arrays, ties by the text."""
    return feedback.select(F.explode("suggestions").alias("suggestion")).groupBy("suggestion").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "suggestion").limit(k)


def purpose_average(*scores: Column, fallback: float = 0.6) -> Column:
    """QLT16: the mean of the scores that are there, 0.6 if none is."""
    there = F.filter(F.array(*scores), lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there)).otherwise(F.lit(fallback))
