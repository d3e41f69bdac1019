"""Chunk boundaries of code, and rules that split, merge, mark and drop chunks (CHK); a document's lines stay in its row."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .code import rule_semantic_group
from .parsing import lines_of, occurrences, strip

#: By language the lines that begin functions, classes and imports, and the words that count as complexity.
LANGUAGES = {
    "python": {
        "function": (r"def\s+(\w+)\s*\(", r"async\s+def\s+(\w+)\s*\("), "class": (r"class\s+(\w+)(?:\([^)]*\))?:",), "import": (r"import\s+(\w+)", r"from\s+(\w+)\s+import"),
        "words": ("if", "elif", "else", "for", "while", "try", "except", "with", "async", "await"),
    },
    "javascript": {
        "function": (r"function\s+(\w+)\s*\(", r"(\w+)\s*=\s*function", r"(\w+)\s*=\s*\([^)]*\)\s*=>", r"async\s+function\s+(\w+)"), "class": (r"class\s+(\w+)(?:\s+extends\s+\w+)?",),
        "import": (r"import\s+.*\s+from\s+['\"]([^'\"]+)['\"]", r"require\s*\(\s*['\"]([^'\"]+)['\"]"), "words": ("if", "else", "for", "while", "switch", "case", "try", "catch", "async", "await"),
    },
    "go": {
        "function": (r"func\s+(?:\([^)]*\)\s+)?(\w+)\s*\(",), "class": (r"type\s+(\w+)\s+struct",), "import": (r"import\s+[\"']([^\"']+)[\"']", r"import\s+(\w+)\s+[\"']"),
        "words": ("if", "else", "for", "range", "switch", "case", "select", "go", "defer"),
    },
    "typescript": {
        "function": (r"function\s+(\w+)\s*\(", r"(\w+)\s*=\s*\([^)]*\)\s*:\s*\w+\s*=>", r"async\s+function\s+(\w+)"),
        "class": (r"class\s+(\w+)(?:\s+extends\s+\w+)?(?:\s+implements\s+[\w,\s]+)?",),
        "import": (r"import\s+.*\s+from\s+['\"]([^'\"]+)['\"]", r"import\s+['\"]([^'\"]+)['\"]"),
        "words": ("if", "else", "for", "while", "switch", "case", "try", "catch", "async", "await", "interface", "type"),
    },
    "java": {
        "function": (r"(?:public|private|protected|static|\s)+[\w<>\[\]]+\s+(\w+)\s*\(",), "class": (r"(?:public|private|protected)?\s*(?:abstract|final)?\s*class\s+(\w+)",), "import": (r"import\s+(?:static\s+)?([^;]+);",),
        "words": ("if", "else", "for", "while", "switch", "case", "try", "catch", "synchronized", "volatile"),
    },
    "csharp": {
        "function": (r"(?:public|private|protected|internal|static|\s)+[\w<>\[\]]+\s+(\w+)\s*\(",),
        "class": (r"(?:public|private|protected|internal)?\s*(?:abstract|sealed|static)?\s*class\s+(\w+)",), "import": (r"using\s+([^;]+);",),
        "words": ("if", "else", "for", "foreach", "while", "switch", "case", "try", "catch", "async", "await"),
    },
    "rust": {
        "function": (r"fn\s+(\w+)\s*\(", r"async\s+fn\s+(\w+)\s*\("), "class": (r"struct\s+(\w+)", r"enum\s+(\w+)", r"trait\s+(\w+)"), "import": (r"use\s+([^;]+);",),
        "words": ("if", "else", "for", "while", "loop", "match", "async", "await", "unsafe"),
    },
}
#: Of the marks that stand in one of these patterns, its every match holds the first.
MARKS = ("=>", "function", "class", "struct", "enum", "trait", "import", "require", "using", "def", "func", "fn", "use")
#: Lines that begin a method, by which a class is split.
METHOD = r"^\s*(def|function|public|private|protected)\s+\w+"


def _indents(lines: Column) -> Column:
    """Of each line its indent, -1 if it is blank."""
    return F.transform(lines, lambda x: F.when(x.rlike(r"^\s*$"), -1).otherwise(F.length(F.regexp_extract(x, r"^\s*", 0))))


def _occurrences(lines: pa.Array, marks: Iterable[str]) -> np.ndarray:
    """How often each line has the marks, each without overlaps."""
    return sum((pc.count_substring(lines, m).to_numpy().astype(np.int64) for m in marks), np.zeros(len(lines), np.int64))


class Lines(NamedTuple):
    """Lines of many documents behind each other: indents (-1 of a blank line), opened less closed braces, and words that count; and how many lines the longest document has."""

    indent: np.ndarray
    braces: np.ndarray
    words: np.ndarray
    longest: int


def _brace_ends(lines: Lines, at: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each line ``at`` the first later one at whose end as many braces are closed as opened since; ``last``, the document's last one, if there is none."""
    depth = np.cumsum(lines.braces)
    level, n = depth - depth.min(initial=0), len(depth)
    key = np.sort(level * n + np.arange(n))
    before = level[at] - lines.braces[at]
    place = np.searchsorted(key, before * n + at, "right")
    found = key[np.minimum(place, n - 1)]
    ok = (place < n) & (found // n == before) & (found % n <= last)
    return np.where(ok, found % n, last)


def _indent_ends(lines: Lines, at: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each line ``at`` the one before the next that isn't blank and is indented no deeper, told by the least indents of 1, 2, 4 and so on lines; a blank start counts as not indented."""
    own = np.maximum(lines.indent[at], 0)
    least = [np.where(lines.indent < 0, np.iinfo(np.int32).max, lines.indent).astype(np.int32)]
    while 2 ** len(least) <= lines.longest:
        half = 2 ** (len(least) - 1)
        least.append(np.minimum(least[-1][:-half], least[-1][half:]))
    after = at + 1
    for k in range(len(least) - 1, -1, -1):
        deeper = after + 2**k <= last + 1
        deeper[deeper] = least[k][after[deeper]] > own[deeper]
        after = after + deeper * 2**k
    return after - 1


def _blocks(docs: DataFrame, text: Column, hits: Column, indented: bool = False, words: Iterable[str] = ()) -> DataFrame:
    """(doc_id, type, name, start_line, end_line, words) of the ``hits`` (type, name, n, last) of each document's lines: up to ``last``, or where that is null to the end of the block; ``words`` are counted whatever their case.

    A task takes the lines of many documents at once. Blocks end and add up by running sums, so work grows with lines and hits, not
    with lines times hits.
    """
    words = tuple(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, text, hits, *indent = batch.columns
            size, line = pc.list_value_length(text).to_numpy(), text.flatten()
            first = np.r_[0, np.cumsum(size)]
            braces = _occurrences(line, "{") - _occurrences(line, "}")
            lines = Lines(indent[0].flatten().to_numpy() if indent else braces, braces, _occurrences(line, words), int(size.max(initial=0)))
            own, hit = pc.list_parent_indices(hits).to_numpy(), hits.flatten()
            kind, name, n, last = (pc.struct_field(hit, k) for k in range(4))
            at, fixed = n.to_numpy().astype(np.int64) - 1 + first[own], pc.fill_null(last, 0).to_numpy()
            end = np.where(fixed > 0, fixed - 1 + first[own], (_indent_ends if indented else _brace_ends)(lines, at, first[own + 1] - 1))
            so_far = np.r_[0, np.cumsum(lines.words)]
            columns = [doc.take(pa.array(own)), kind, name, n, pa.array(end - first[own] + 1, pa.int32()), pa.array(so_far[end + 1] - so_far[at], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "type", "name", "start_line", "end_line", "words"])

    key = docs.schema["doc_id"].dataType.simpleString()
    # what goes to the task has no filter above it, which would work out the hits twice
    rows = docs.select("doc_id", lines_of(F.lower(text)).alias("_low"), hits.alias("_hits"), *([_indents(F.col("_l")).alias("_indent")] if indented else []))
    return rows.mapInArrow(run, f"doc_id {key}, type string, name string, start_line int, end_line int, words long")


def _hit(line: Column, pattern: str) -> Column:
    """Whether a line has a match of one of LANGUAGES' patterns, which is looked for only where its mark stands."""
    mark = next((m for m in MARKS if m in pattern), None)
    return F.contains(line, F.lit(mark)) & line.rlike(pattern) if mark else line.rlike(pattern)


def brace_block_ends(docs: DataFrame, begins: str, text_col: str = "text") -> DataFrame:
    """CHK6: (doc_id, start_line, end_line) of each line that ``begins`` hits, up to where its braces are closed, else the last line."""
    rows = docs.where(F.col(text_col).isNotNull()).select("doc_id", F.col(text_col).alias("_text"), lines_of(F.col(text_col)).alias("_l"))
    hit = lambda x, i: F.when(x.rlike(begins), F.struct(F.lit("").alias("type"), F.lit("").alias("name"), (i + 1).alias("n"), F.lit(None).cast("int").alias("last")))
    found = _blocks(rows, F.col("_text"), F.filter(F.transform("_l", hit), lambda s: s.isNotNull()))
    return found.select("doc_id", "start_line", "end_line")


def language_boundaries(docs: DataFrame, language: str, text_col: str = "text") -> DataFrame:
    """CHK4: (doc_id, type, name, start_line, end_line, complexity): all imports as one range, then functions and classes to the ends of their blocks.

    A line that two patterns of a kind hit gives two rows. Complexity is one and the language's words in the block's
    text, parts of other words too, at most 10; 1 for imports. No word goes over a line, so a line's words are counted once.
    """
    own = LANGUAGES[language]
    rows = docs.where(F.col(text_col).isNotNull()).select("doc_id", F.col(text_col).alias("_text"), lines_of(F.col(text_col)).alias("_l"))

    def hit(kind: str, p: str) -> Column:
        found = F.transform("_l", lambda x, i: F.when(_hit(x, p), F.struct(F.lit(kind).alias("type"), F.regexp_extract(x, p, 1).alias("name"), (i + 1).alias("n"), F.lit(None).cast("int").alias("last"))))
        return F.filter(found, lambda s: s.isNotNull())

    hits = lambda kind: [hit(kind, p) for p in own[kind]]
    at = F.transform(F.concat(*hits("import")), lambda h: h["n"])
    imports = F.when(F.size(at) > 0, F.array(F.struct(F.lit("imports").alias("type"), F.lit("imports").alias("name"), F.array_min(at).alias("n"), F.array_max(at).alias("last"))))
    every = F.concat(F.coalesce(imports, F.array().cast("array<struct<type:string,name:string,n:int,last:int>>")), *hits("function"), *hits("class"))
    found = _blocks(rows, F.col("_text"), every, language == "python", own["words"])
    complexity = F.when(F.col("type") == "imports", 1).otherwise(F.least(F.col("words") + 1, F.lit(10))).cast("int")
    return found.select("doc_id", "type", "name", "start_line", "end_line", complexity.alias("complexity"))


def heuristic_chunks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """CHK7: (doc_id, type, name, start_line, end_line, complexity) of chunks that end before a definition, a long comment or a blank line.

    A boundary counts after 5 lines (a blank one after 10), and 50 lines are the most but for the last. A fold over each
    document's lines; an empty or null text has no chunk.
    """
    lines = F.transform(lines_of(F.col(text_col)), lambda x, i: F.struct((i + 1).alias("n"), strip(x).alias("x")))
    starts = lambda x, *marks: sum((F.startswith(x, F.lit(m)).cast("int") for m in marks), F.lit(0)) > 0

    def step(s: Column, line: Column) -> Column:
        n, x = s["n"] + 1, line["x"]
        edge = starts(x, "def ", "class ", "async def ") | (starts(x, "#") & (F.length(x) > 10)) | ((x == "") & (n > 10))
        chunk = F.struct(s["start"].alias("s"), F.when(edge, line["n"] - 1).otherwise(line["n"]).alias("e"), F.least(F.floor(n / 10) + 1, F.lit(10)).cast("int").alias("k"))
        cut = F.struct(F.when(edge, line["n"]).otherwise(line["n"] + 1).alias("start"), F.when(edge, 1).otherwise(0).alias("n"), F.concat(s["out"], F.array(chunk)).alias("out"))
        return F.when((edge & (n > 5)) | (n > 50), cut).otherwise(F.struct(s["start"].alias("start"), n.alias("n"), s["out"].alias("out")))

    zero = F.expr("struct(1 as start, 0 as n, cast(array() as array<struct<s:int,e:int,k:int>>) as out)")
    last = lambda s: F.when(s["n"] > 0, F.concat(s["out"], F.array(F.struct(s["start"].alias("s"), (s["start"] + s["n"] - 1).alias("e"), F.least(F.floor(s["n"] / 10) + 1, F.lit(10)).cast("int").alias("k"))))).otherwise(s["out"])
    rows = docs.where(F.col(text_col) != "").select("doc_id", lines_of(F.col(text_col)).alias("_lines"), F.explode(F.aggregate(lines, zero, step, last)).alias("c"))
    own = F.slice("_lines", F.col("c.s"), F.greatest(F.col("c.e") - F.col("c.s") + 1, F.lit(0)))
    content = F.array_join(own, "\n")
    has = lambda *marks: sum((F.contains(content, F.lit(m)).cast("int") for m in marks), F.lit(0)) > 0
    kind = F.when(has("class "), "class").when(has("def "), "function").when(has("import ", "from "), "import").otherwise("code_block")
    first = F.get(F.filter(F.transform(own, strip), lambda x: starts(x, "class ", "def ", "async def ")), F.lit(0))
    head = F.substring_index(first, "(", 1)
    named = F.when(F.startswith(first, F.lit("class ")), strip(F.replace(head, F.lit("class "), F.lit("")))).otherwise(strip(F.replace(F.replace(head, F.lit("def "), F.lit("")), F.lit("async "), F.lit(""))))
    plain = F.when(kind == "import", "imports").when(kind == "class", "class_definition").when(kind == "function", "function_definition").otherwise("code_block")
    return rows.select("doc_id", kind.alias("type"), F.coalesce(named, plain).alias("name"), F.col("c.s").alias("start_line"), F.col("c.e").alias("end_line"), F.col("c.k").alias("complexity"))


CHUNK = ("doc_id", "type", "name", "start_line", "end_line", "complexity")


def with_content(chunks: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``chunks`` with the lines of their documents that they span."""
    lines = docs.select("doc_id", lines_of(F.col(text_col)).alias("_lines"))
    return chunks.join(lines, "doc_id").withColumn("content", F.array_join(F.slice("_lines", F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n")).drop("_lines")


def matches(content: Column, condition: str, value) -> Column:
    """CHK12: contains, starts_with, ends_with (of the stripped text), regex_match, line_count and char_count (at least); any other is never met."""
    tests = {
        "contains": lambda: F.contains(content, F.lit(str(value))), "starts_with": lambda: F.startswith(strip(content), F.lit(str(value))), "ends_with": lambda: F.endswith(strip(content), F.lit(str(value))),
        "regex_match": lambda: content.rlike(str(value)), "line_count": lambda: F.size(lines_of(content)) >= value, "char_count": lambda: F.length(content) >= value,
    }
    return tests[condition]() if condition in tests else F.lit(False)


def rule_pattern(chunks: DataFrame, condition: str, value, action: str, mark: str = "special") -> DataFrame:
    """CHK12: chunks (with content) that meet the condition are split at the lines that ``value`` hits, marked as custom_type, or dropped; others stay."""
    met = F.coalesce(matches(F.col("content"), condition, value), F.lit(False))
    if action == "skip":
        return chunks.where(~met)
    if action == "mark":
        return chunks.withColumn("custom_type", F.when(met, mark))
    if action != "split":
        return chunks
    at = F.filter(F.transform(lines_of(F.col("content")), lambda x, i: F.when(x.rlike(str(value)) & (i > 0), F.col("start_line") + i)), lambda n: n.isNotNull())
    starts = F.when(met, F.concat(F.array("start_line"), at)).otherwise(F.array("start_line"))
    parts = chunks.withColumn("_starts", starts).select("*", F.posexplode("_starts").alias("_i", "_from"))
    parts = parts.withColumn("_to", F.coalesce(F.get("_starts", F.col("_i") + 1) - 1, F.col("end_line")))
    content = F.array_join(F.slice(lines_of(F.col("content")), F.col("_from") - F.col("start_line") + 1, F.greatest(F.col("_to") - F.col("_from") + 1, F.lit(0))), "\n")
    return parts.withColumn("content", content).withColumn("start_line", F.col("_from")).withColumn("end_line", F.col("_to")).drop("_starts", "_i", "_from", "_to")


def rule_class_by_methods(chunks: DataFrame, most: int) -> DataFrame:
    """CHK14: classes (with content) whose last line is over ``most`` after the first become their methods, {name}_method_{i}, if there are two; lines before the first are left out."""
    at = F.filter(F.transform(lines_of(F.col("content")), lambda x, i: F.when(x.rlike(METHOD), F.col("start_line") + i)), lambda n: n.isNotNull())
    split = (F.col("type") == "class") & (F.col("end_line") - F.col("start_line") > most) & (F.size(at) > 1)
    parts = chunks.withColumn("_split", F.coalesce(split, F.lit(False))).withColumn("_starts", F.when(F.col("_split"), at).otherwise(F.array("start_line")))
    parts = parts.select("*", F.posexplode("_starts").alias("_i", "_from")).withColumn("_to", F.coalesce(F.get("_starts", F.col("_i") + 1) - 1, F.col("end_line")))
    content = F.array_join(F.slice(lines_of(F.col("content")), F.col("_from") - F.col("start_line") + 1, F.greatest(F.col("_to") - F.col("_from") + 1, F.lit(0))), "\n")
    name = F.when(F.col("_split"), F.concat("name", F.lit("_method_"), (F.col("_i") + 1).cast("string"))).otherwise(F.col("name"))
    return (
        parts.withColumn("content", content).withColumn("name", name).withColumn("type", F.when(F.col("_split"), "method").otherwise(F.col("type")))
        .withColumn("start_line", F.col("_from")).withColumn("end_line", F.col("_to")).drop("_split", "_starts", "_i", "_from", "_to")
    )


def _split_large(chunks: DataFrame, most: int) -> DataFrame:
    """As CHK10, with type and complexity kept."""
    n = F.col("end_line") - F.col("start_line") + 1
    parts = F.greatest(F.ceil(n / most), F.lit(1)).cast("int")
    out = chunks.withColumn("_parts", parts).withColumn("_step", F.floor(n / F.col("_parts")).cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(1), parts)))
    start = F.col("start_line") + (F.col("_i") - 1) * F.col("_step")
    end = F.when(F.col("_i") == F.col("_parts"), F.col("end_line")).otherwise(start + F.col("_step") - 1)
    name = F.when(F.col("_parts") > 1, F.concat("name", F.lit("_"), F.col("_i").cast("string"))).otherwise(F.col("name"))
    return out.select("doc_id", "type", name.alias("name"), start.alias("start_line"), end.alias("end_line"), "complexity")


def _merge_small(chunks: DataFrame, least: int) -> DataFrame:
    """In one pass from the left a chunk of fewer than ``least`` lines takes in its next neighbour: type merged, both names, the greater complexity."""
    rows = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_line", "end_line", "name", "type", "complexity"))).alias("c"))
    zero = F.expr("struct(cast(array() as array<struct<start_line:int,end_line:int,name:string,type:string,complexity:int>>) as done, false as open)")

    def step(s: Column, x: Column) -> Column:
        head = F.element_at(s["done"], -1)
        both = F.struct(head["start_line"].alias("start_line"), x["end_line"].alias("end_line"), F.concat(head["name"], F.lit("+"), x["name"]).alias("name"), F.lit("merged").alias("type"), F.greatest(head["complexity"], x["complexity"]).alias("complexity"))
        taken = F.struct(F.concat(F.slice(s["done"], 1, F.size(s["done"]) - 1), F.array(both)).alias("done"), F.lit(False).alias("open"))
        return F.when(s["open"], taken).otherwise(F.struct(F.concat(s["done"], F.array(x)).alias("done"), (x["end_line"] - x["start_line"] + 1 < least).alias("open")))

    return rows.select("doc_id", F.explode(F.aggregate("c", zero, step, lambda s: s["done"])).alias("x")).select("doc_id", "x.type", "x.name", "x.start_line", "x.end_line", "x.complexity")


class Rule(NamedTuple):
    """One step of a chunking strategy: kind is size, pattern, semantic or class."""

    kind: str
    condition: str
    value: str | int | float
    action: str
    priority: int = 1
    enabled: bool = True
    mark: str = "special"


#: The strategy used where none is named: small chunks merge before large ones are split.
DEFAULT_STRATEGY = (Rule("size", "line_count", 10, "merge", 2), Rule("size", "line_count", 200, "split", 1))


def apply_strategy(chunks: DataFrame, docs: DataFrame, rules: Iterable[Rule] = DEFAULT_STRATEGY, text_col: str = "text") -> DataFrame:
    """CHK15: the enabled rules over chunks (columns ``CHUNK``), those of higher priority first; rules of an unknown kind or action change nothing."""
    chunks = chunks.select(*CHUNK)
    marks: list[str] = []
    for rule in sorted((r for r in rules if r.enabled), key=lambda r: -r.priority):
        if rule.kind == "size" and rule.condition == "line_count" and rule.action in ("split", "merge"):
            chunks = (_split_large if rule.action == "split" else _merge_small)(chunks, int(rule.value))
        elif rule.kind == "pattern":
            chunks = rule_pattern(with_content(chunks, docs, text_col), rule.condition, rule.value, rule.action, rule.mark)
            if rule.action == "mark":
                chunks = chunks.withColumn("type", F.coalesce("custom_type", "type"))
            chunks = chunks.select(*CHUNK)
        elif rule.kind == "semantic" and rule.condition in ("contains", "starts_with"):
            chunks = rule_semantic_group(chunks, str(rule.value), rule.condition == "starts_with").select(*[F.col(c).cast("int").alias(c) if c == "complexity" else c for c in CHUNK])
        elif rule.kind == "class" and rule.condition == "line_count" and rule.action == "split":
            chunks = rule_class_by_methods(with_content(chunks, docs, text_col), int(rule.value)).select(*CHUNK)
    return with_content(chunks, docs, text_col)


def strategy_to_json(rules: Iterable[Rule]) -> str:
    """EXT1: a strategy as JSON text."""
    return json.dumps([r._asdict() for r in rules])


def strategy_from_json(text: str) -> list[Rule]:
    """EXT1: the strategy of ``strategy_to_json``; fields that a rule lacks have their defaults, unknown ones are passed over."""
    return [Rule(**{k: v for k, v in r.items() if k in Rule._fields}) for r in json.loads(text)]
