"""Chunking by lines, characters and rules (CHK)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that open a branch or a loop.
CONTROL = ("if", "else", "elif", "for", "while", "try", "except", "catch", "switch", "case")


def chunk_by_lines(docs: DataFrame, block: int = 50, text_col: str = "text") -> DataFrame:
    """CHK2: blocks of ``block`` lines named block_{k}, with 1-based inclusive line numbers. A null text has none."""
    lines = F.split(text_col, "\n", -1)
    numbered = docs.withColumn("_lines", lines).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.ceil(F.size("_lines") / block).cast("int") - 1)))
    begin = F.col("chunk_no") * block
    return numbered.select(
        *[c for c in docs.columns if c != text_col], "chunk_no", F.concat(F.lit("block_"), F.col("chunk_no").cast("string")).alias("name"), (begin + 1).alias("start_line"),
        F.least(begin + block, F.size("_lines")).alias("end_line"), F.array_join(F.slice("_lines", begin + 1, F.lit(block)), "\n").alias("content"),
    )


def even_split_groups(docs: DataFrame, n: int, text_col: str = "text") -> DataFrame:
    """CHK8: ``n`` line ranges 1 + i*L div n .. min(start + L div n, L); neighbours share a line."""
    total = F.size(F.split(text_col, "\n", -1))
    step = F.floor(total / n).cast("int")
    start = 1 + F.col("part") * step
    return docs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("doc_id", "part", start.alias("start_line"), F.least(start + step, total).alias("end_line"))


def fixed_char_window(docs: DataFrame, size: int = 1000, overlap: int = 200, text_col: str = "text") -> DataFrame:
    """CHK9: windows of ``size`` characters, each ``size - overlap`` after the one before, until the text is covered."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text_col) - overlap) / step), F.lit(1)).cast("int") - 1
    return docs.where(F.length(text_col) > 0).withColumn("part", F.explode(F.sequence(F.lit(0), last))).select("doc_id", "part", F.substr(text_col, F.col("part") * step + 1, F.lit(size)).alias("content"))


def rule_split_large(chunks: DataFrame, max_lines: int) -> DataFrame:
    """CHK10: chunks of more than ``max_lines`` lines in ceil(n / max) near-equal parts, suffix _i, the last takes the rest."""
    n = F.col("end_line") - F.col("start_line") + 1
    parts = F.greatest(F.ceil(n / max_lines), F.lit(1)).cast("int")
    out = chunks.withColumn("_parts", parts).withColumn("_step", F.floor(n / F.col("_parts")).cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(1), parts)))
    start = F.col("start_line") + (F.col("_i") - 1) * F.col("_step")
    end = F.when(F.col("_i") == F.col("_parts"), F.col("end_line")).otherwise(start + F.col("_step") - 1)
    name = F.when(F.col("_parts") > 1, F.concat("name", F.lit("_"), F.col("_i").cast("string"))).otherwise(F.col("name"))
    return out.select("doc_id", name.alias("name"), start.alias("start_line"), end.alias("end_line"))


def rule_merge_small(chunks: DataFrame, min_lines: int) -> DataFrame:
    """CHK11: in one pass from the left, a chunk of fewer than ``min_lines`` lines takes in its next neighbour.

    A fold over the document's ordered chunks, so it stays in the JVM; a document's chunks are bounded by its text.
    """
    ordered = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_line", "end_line", "name"))).alias("c"))
    zero = F.expr("struct(cast(array() as array<struct<start_line:int,end_line:int,name:string>>) as done, false as open)")
    step = lambda s, x: F.when(
        s["open"], F.struct(F.concat(F.slice(s["done"], 1, F.size(s["done"]) - 1), F.array(F.struct(F.element_at(s["done"], -1)["start_line"].alias("start_line"), x["end_line"].alias("end_line"), F.element_at(s["done"], -1)["name"].alias("name")))).alias("done"), F.lit(False).alias("open")),
    ).otherwise(F.struct(F.concat(s["done"], F.array(x)).alias("done"), (x["end_line"] - x["start_line"] + 1 < min_lines).alias("open")))
    return ordered.select("doc_id", F.explode(F.aggregate("c", zero, step, lambda s: s["done"])).alias("x")).select("doc_id", "x.start_line", "x.end_line", "x.name")


def chunk_rollup(chunks: DataFrame) -> DataFrame:
    """CHK19: per document the number of chunks, their mean size and all lines."""
    size = F.col("end_line") - F.col("start_line") + 1
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.round(F.avg(size), 6).alias("avg_size"), F.sum(size).cast("long").alias("lines"))


def chunk_overlaps(chunks: DataFrame) -> DataFrame:
    """CHK20: chunks that begin before the one before them has ended."""
    before = F.lag("end_line").over(Window.partitionBy("doc_id").orderBy("start_line", "end_line"))
    return chunks.withColumn("before", before).where(F.col("start_line") <= F.col("before")).select("doc_id", "start_line", "end_line", "before")


def validate_chunks(chunks: DataFrame) -> DataFrame:
    """CHK18: the rules that each chunk breaks, as an array."""
    rules = F.array(
        F.when(F.col("content").isNull() | (F.trim("content") == ""), "empty content"), F.when(F.col("start_line") < 1, "start below 1"),
        F.when(F.col("end_line") < F.col("start_line"), "end before start"), F.when(F.col("name").isNull() | (F.col("name") == ""), "no name"),
    )
    return chunks.withColumn("errors", F.filter(rules, lambda x: x.isNotNull()))


def control_flow_complexity(text: Column, cap: int = 20) -> Column:
    """CHK21: 1 and the number of whole control words, at most ``cap``."""
    return F.least(F.regexp_count(text, F.lit(r"\b(" + "|".join(CONTROL) + r")\b")) + 1, F.lit(cap))


def run_stats(runs: DataFrame, range_size: int = 100_000) -> DataFrame:
    """CHK22: (run_id, strategy, duration, quality) with the running averages of its strategy in the order of runs.

    Runs are summed per range of ``range_size`` ids first, and a run adds its own range to those before: no window over runs holds
    more than a strategy's range.
    """
    rows = runs.withColumn("_range", F.floor(F.col("run_id") / range_size))
    sums = [f(c).alias(f"_{n}_{c}") for c in ("duration", "quality") for n, f in (("s", F.sum), ("n", F.count))]
    ranges = rows.groupBy("strategy", "_range").agg(F.count("*").alias("_n"), *sums)
    names = [c for c in ranges.columns if c not in ("strategy", "_range")]
    before = Window.partitionBy("strategy").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("strategy", "_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in names])
    so_far = Window.partitionBy("strategy", "_range").orderBy("run_id").rowsBetween(Window.unboundedPreceding, 0)
    mean = lambda c: F.round((F.col(f"_s_{c}") + F.coalesce(F.sum(c).over(so_far), F.lit(0))) / F.nullif(F.col(f"_n_{c}") + F.count(c).over(so_far), F.lit(0)), 6)
    return rows.join(ranges, ["strategy", "_range"]).select("run_id", "strategy", mean("duration").alias("avg_duration"), mean("quality").alias("avg_quality"), (F.col("_n") + F.count("*").over(so_far)).alias("runs"))
