"""Chunks of source code by line patterns, and rules over named chunks (CHK); all inside one row per document, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import chunk_by_lines

#: The lines that begin a chunk of Python code, in the order in which one line's hits count.
PYTHON_PATTERNS = {"function": r"def\s+\w+\s*\([^)]*\):", "class": r"class\s+\w+(?:\([^)]*\))?:", "method": r"^\s+def\s+\w+\s*\([^)]*\):"}
#: Chunk types of patterns whose own name is none.
PATTERN_TYPES = {"struct": "class", "impl": "class"}
#: Words before a name, and words that count as control flow.
NAME_AFTER = r"(?:^|\s)(?:function|class|def|func|struct|impl)\s+(\w*)"
BRANCHES = r"(?i)\b(?:if|for|while|try|catch|switch|match|loop)\b"
#: Chunk types, and other words for them.
CHUNK_TYPES = (
    "function", "class", "method", "module", "import", "comment", "semantic_block", "class_definition", "function_definition", "method_definition",
    "imports", "variable", "constant", "interface",
)
TYPE_ALIASES = {
    "func": "function", "fn": "function", "def": "function", "cls": "class", "klass": "class", "meth": "method", "mod": "module", "imp": "import",
    "block": "semantic_block", "code_block": "semantic_block", "semantic": "semantic_block",
}
#: How much a purpose matters when a strategy is chosen, and words that make text count as complex.
CRITICALITY = {"code_review": 0.9, "bug_detection": 0.8, "documentation": 0.6, "general": 0.5}
COMPLEX_WORDS = ("class", "def", "if", "for", "while", "try", "except", "with")


def branch_complexity(content: Column) -> Column:
    """1 and the number of control words, at most 20."""
    return F.least(F.regexp_count(content, F.lit(BRANCHES)) + 1, F.lit(20))


def chunk_by_patterns(docs: DataFrame, patterns: dict[str, str] = PYTHON_PATTERNS, text_col: str = "text") -> DataFrame:
    """CHK1: each line that a pattern hits begins a chunk, which ends before the next hit; a line with two hits gives an empty first chunk.

    Columns doc_id, chunk_no, type, name, start_line, end_line, content, complexity. Lines before the first hit are in no chunk;
    a null or empty text, and one without hits, has no rows.
    """
    kinds = lambda x, i: F.filter(
        F.array(*[F.when(x.rlike(f"(?i){p}"), F.struct((i + 1).alias("line"), F.lit(PATTERN_TYPES.get(n, n)).alias("type"), F.lit(n).alias("pattern"))) for n, p in patterns.items()]), lambda h: h.isNotNull()
    )
    hits = docs.select("doc_id", F.split(text_col, "\n", -1).alias("_lines")).withColumn("_hits", F.flatten(F.transform("_lines", kinds)))
    each = hits.select("doc_id", "_lines", "_hits", F.posexplode("_hits").alias("chunk_no", "h"))
    end = F.coalesce(F.get("_hits", F.col("chunk_no") + 1)["line"] - 1, F.size("_lines"))
    line = F.trim(F.element_at("_lines", F.col("h.line")))
    name = F.when(line.rlike(NAME_AFTER), F.regexp_extract(line, NAME_AFTER, 1)).otherwise(F.concat("h.pattern", F.lit("_unknown")))
    content = F.array_join(F.slice("_lines", F.col("h.line"), F.greatest(end - F.col("h.line") + 1, F.lit(0))), "\n")
    out = each.select("doc_id", "chunk_no", F.col("h.type").alias("type"), name.alias("name"), F.col("h.line").alias("start_line"), end.alias("end_line"), content.alias("content"))
    return out.withColumn("complexity", branch_complexity(F.col("content")))


def chunk_with_fallback(docs: DataFrame, patterns: dict[str, str] = PYTHON_PATTERNS, block: int = 50, text_col: str = "text") -> DataFrame:
    """CHK3: pattern chunks, and for documents without any hit blocks of lines named block_{k} from 1."""
    hit = F.exists(F.split(text_col, "\n", -1), lambda x: F.coalesce(*[F.when(x.rlike(f"(?i){p}"), True) for p in patterns.values()], F.lit(False)))
    rest = chunk_by_lines(docs.where(~hit).select("doc_id", text_col), block, text_col)
    blocks = rest.select("doc_id", "chunk_no", F.lit("semantic_block").alias("type"), F.concat(F.lit("block_"), (F.col("chunk_no") + 1).cast("string")).alias("name"), "start_line", "end_line", "content", F.lit(1).alias("complexity"))
    return chunk_by_patterns(docs, patterns, text_col).unionByName(blocks)


def indent_block_ends(docs: DataFrame, begins: str, text_col: str = "text") -> DataFrame:
    """CHK5: (doc_id, start_line, end_line) of each line that ``begins`` hits: up to the line before the next one that isn't blank and is indented no deeper.

    Each start scans only its own document's lines, so no lines are joined with lines.
    """
    lines = F.transform(F.split(text_col, "\n", -1), lambda x, i: F.struct((i + 1).alias("n"), F.when(F.trim(x) != "", F.length(x) - F.length(F.ltrim(x))).alias("indent"), x.rlike(begins).alias("begins")))
    starts = docs.select("doc_id", lines.alias("_lines")).select("doc_id", "_lines", F.explode(F.filter("_lines", lambda x: x["begins"])).alias("s"))
    after = F.filter("_lines", lambda x: (x["n"] > F.col("s.n")) & (x["indent"] <= F.col("s.indent")))
    return starts.select("doc_id", F.col("s.n").alias("start_line"), F.coalesce(F.get(after, F.lit(0))["n"] - 1, F.size("_lines")).alias("end_line"))


def rule_semantic_group(chunks: DataFrame, value: str, starts: bool = False) -> DataFrame:
    """CHK13: a document's chunks whose name holds (or begins with) ``value`` become one, {value}_group, from the first line to the last with complexities summed; a single one stays as it is."""
    hit = F.coalesce(F.startswith("name", F.lit(value)) if starts else F.contains("name", F.lit(value)), F.lit(False))
    grouped = chunks.where(hit).groupBy("doc_id").agg(
        F.count("*").alias("_n"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.min("name").alias("_name"), F.min("type").alias("_type"), F.sum("complexity").cast("long").alias("complexity")
    )
    many = F.col("_n") > 1
    merged = grouped.select("doc_id", F.when(many, f"{value}_group").otherwise(F.col("_name")).alias("name"), F.when(many, "semantic_group").otherwise(F.col("_type")).alias("type"), "start_line", "end_line", "complexity")
    return chunks.where(~hit).select("doc_id", "name", "type", "start_line", "end_line", F.col("complexity").cast("long").alias("complexity")).unionByName(merged)


def content_complexity(text: Column) -> Column:
    """CHK16: the mean of three shares, each at most 1: lines of 200, mean line length of 80, complex words of 20."""
    n = F.size(F.split(text, "\n", -1))
    words = sum(((F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w) for w in COMPLEX_WORDS), F.lit(0.0))
    return (F.least(n / 200, F.lit(1.0)) + F.least((F.length(text) - n + 1) / n / 80, F.lit(1.0)) + F.least(words / 20, F.lit(1.0))) / 3


def agentic_score(text: Column, purpose: Column, threshold: Column) -> Column:
    """CHK16: a document's need of the costlier strategy, which is chosen above 0.5 where more than 10 seconds are given."""
    critical = F.coalesce(*[F.when(purpose == k, v) for k, v in CRITICALITY.items()], F.lit(0.5))
    return content_complexity(text) * 0.4 + critical * 0.3 + F.least(F.size(F.split(text, "\n", -1)) / 1000, F.lit(1.0)) * 0.2 + (threshold - 0.5) * 0.1


def normalize_chunk_type(name: Column) -> Column:
    """CHK17: the chunk type meant by a free word, unknown if none (or null) is."""
    low = F.translate(F.lower(name), " -", "__")
    known = F.create_map(*[F.lit(x) for pair in TYPE_ALIASES.items() for x in pair])
    return F.when(low.isin(*CHUNK_TYPES), low).otherwise(F.coalesce(F.try_element_at(known, low), F.lit("unknown")))


def coverage_score(chunks: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """QLT11: per document 0.7 of the covered share of lines and 0.3 of the chunks out of 10; 0 without chunks."""
    per = chunks.groupBy("doc_id").agg(F.count("*").alias("_n"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("_covered"))
    lines = docs.select("doc_id", F.size(F.split(text_col, "\n", -1)).alias("_total"))
    score = F.least(F.col("_covered") / F.col("_total"), F.lit(1.0)) * 0.7 + F.least(F.col("_n") / 10, F.lit(1.0)) * 0.3
    return lines.join(per, "doc_id", "left").select("doc_id", F.round(F.coalesce(score, F.lit(0.0)), 6).alias("score"))
