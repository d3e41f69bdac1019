"""Document classification and profiles as columns (DOC), content hashes, and query understanding (QRY)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What extensions stand for.
DOCUMENT_TYPES = {".py": "code", ".js": "code", ".ts": "code", ".go": "code", ".java": "code", ".rs": "code", ".md": "markdown", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".xml": "xml", ".csv": "csv", ".txt": "text", ".html": "html", ".pdf": "pdf", ".docx": "docx"}
LANGUAGES = {".py": "python", ".js": "javascript", ".ts": "typescript", ".go": "go", ".java": "java", ".rs": "rust", ".c": "c", ".cpp": "cpp", ".cs": "csharp"}
WORD = r"[\p{L}\p{N}_]+"
#: Words that say nothing about a query's subject.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "will", "with",
    "this", "but", "they", "have", "had", "what", "said", "each", "which", "their", "time", "if",
)
#: Signs of code in a query, whatever their case.
CODE_PATTERNS = (r"def\s+\w+\s*\(", r"function\s+\w+\s*\(", r"class\s+\w+", r"\w+\.\w+\(", r"import\s+\w+", r"from\s+\w+\s+import", r"#include\s*<", r"public\s+class", r"private\s+\w+", r"async\s+def", r"await\s+\w+")
#: A question's first word (or its beginning), and words that ask for a summary.
QUESTION = r"^(what|how|why|when|where|who|which|can|could|would|should|is|are|does|do|did)|\?$"
SUMMARY = "summary|summarize|overview|explain|describe"
#: Words that tell what a query is after; the first action that has one counts.
ACTIONS = {
    "find": "find|search|locate|get", "explain": "explain|describe|what is|how does", "compare": "compare|difference|vs|versus",
    "implement": "implement|create|build|make", "debug": "debug|fix|error|problem|issue", "optimize": "optimize|improve|performance|faster",
}
#: Words of programming languages in a query that looks like code; the first language that has one counts.
QUERY_LANGUAGES = {
    "python": r"\b(def|import|from|class|self)\b", "javascript": r"\b(function|var|let|const|console\.log)\b", "java": r"\b(public|private|class|static|void)\b",
    "cpp": r"\b(#include|std::|namespace|template)\b", "go": r"\b(func|package|import|var|type)\b", "rust": r"\b(fn|let|mut|use|struct)\b",
}


#: What is named in a query, by patterns, and by whole words that hold a pattern; whatever their case.
ENTITIES = {
    "file_extension": r"(?i)(\.\w{2,4})\b", "function_name": r"(?i)\b(\w+\(\))", "class_name": r"(?i)\bclass\s+(\w+)", "number": r"\b(\d+\.?\d*)\b", "url": r"(?i)(https?://[^\s]+)",
    "email": r"(?i)\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,})\b",
}
TOKEN_ENTITIES = {"variable_name": r"^[A-Za-z_]", "constant": r"^[A-Za-z_][A-Za-z0-9_]*$"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*values.items())]), key), F.lit("unknown"))


def document_type(path: Column) -> Column:
    """DOC1"""
    return _lookup(DOCUMENT_TYPES, extension(path))


def programming_language(path: Column) -> Column:
    """DOC2"""
    return _lookup(LANGUAGES, extension(path))


def detect_language(path: Column, content: Column) -> Column:
    """DOC3: by extension, else by the first family of marks that the content holds; that order makes later families hard to reach."""
    has = lambda *marks: F.coalesce(sum((F.contains(content, F.lit(m)).cast("int") for m in marks), F.lit(0)) > 0, F.lit(False))
    by_content = F.when(has("def ", "import ", "from ", "class "), "python").when(has("function ", "const ", "let ", "=>"), "javascript").when(has("public ", "private "), "java").when(has("namespace ", "using "), "csharp").when(has("func ", "package "), "go").when(has("fn ", "impl "), "rust").otherwise("unknown")
    known = programming_language(path)
    return F.when(known != "unknown", known).otherwise(by_content)


def text_profile(text: Column) -> dict[str, Column]:
    """DOC6: line, character, word and paragraph counts, mean line and word length."""
    lines = F.split(text, "\n", -1)
    words = F.filter(F.split(text, r"\s+", -1), lambda w: w != "")
    total = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    paragraphs = F.filter(F.split(text, "\n\n", -1), lambda p: F.regexp_replace(p, r"\s", "") != "")
    return {
        "lines": F.size(lines), "chars": F.length(text), "words": F.size(words), "paragraphs": F.size(paragraphs),
        "avg_line": F.round((F.length(text) - F.size(lines) + 1) / F.size(lines), 6), "avg_word": F.round(total / F.greatest(F.size(words), F.lit(1)), 6),
    }


def markdown_profile(text: Column) -> dict[str, Column]:
    """DOC7: counts of headers, links, images, fenced blocks, inline code and list items."""
    n = lambda pattern: F.regexp_count(text, F.lit(pattern))
    out = {"headers": n(r"(?m)^#{1,6} .+$")} | {f"h{k}": n(rf"(?m)^#{{{k}}} .+$") for k in (1, 2, 3)}
    return out | {"links": n(r"\[[^\]]+\]\([^)]+\)"), "fences": n(r"(?m)^```"), "bullets": n(r"(?m)^[-*+] "), "numbered": n(r"(?m)^[0-9]+\. ")}


def content_hash(text: Column) -> Column:
    """DOC17: SHA-256 of the content."""
    return F.sha2(text, 256)


def chunk_id(path: Column, start: Column, end: Column) -> Column:
    """DOC17: the first 12 digits of MD5 over path:start:end."""
    return F.left(F.md5(F.concat_ws(":", path, start.cast("string"), end.cast("string"))), F.lit(12))


def query_hash(query: Column, user: Column, collection: Column) -> Column:
    """DOC17: the first 16 digits of SHA-256 over the trimmed lower-case query, user and, if any, collection."""
    return F.left(F.sha2(F.concat_ws(":", F.lower(F.trim(query)), user.cast("string"), collection), 256), F.lit(16))


def sanitize_filename(name: Column) -> Column:
    """DOC18"""
    return F.left(F.regexp_replace(name, r"[^A-Za-z0-9_\-.]", "_"), F.lit(255))


def looks_like_code(query: Column) -> Column:
    """QRY2"""
    hit = F.lit(False)
    for pattern in CODE_PATTERNS:
        hit = hit | query.rlike(f"(?i){pattern}")
    return hit


def clean_query(query: Column) -> Column:
    """QRY1: white space made single; of what isn't code, signs other than words, hyphens and dots go (also the question mark)."""
    single = F.trim(F.regexp_replace(query, r"\s+", " "))
    return F.when(looks_like_code(query), single).otherwise(F.regexp_replace(single, r"[^\p{L}\p{N}_\s\-.]", ""))


def query_type(query: Column) -> Column:
    """QRY3: question (by its beginning, no word boundary, or a question mark at the end), code, summary, else semantic."""
    low = F.lower(query)
    return F.when(low.rlike(QUESTION), "question").when(looks_like_code(query), "code").when(low.rlike(SUMMARY), "summary").otherwise("semantic")


def keywords(query: Column) -> Column:
    """QRY4: the words that are no stop words, in lower case and in order, each once."""
    found = F.regexp_extract_all(F.lower(query), F.lit(f"({WORD})"), 1)
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*STOP_WORDS)))


def entities(query: Column) -> Column:
    """QRY5: an array of (type, value): every hit of every kind, the kinds one after the other; a word may be of several."""
    of = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))
    holding = lambda pattern: F.filter(F.regexp_extract_all(query, F.lit(f"({WORD})"), 1), lambda w: w.rlike(pattern))
    return F.concat(*[of(k, F.regexp_extract_all(query, F.lit(p), 1)) for k, p in ENTITIES.items()], *[of(k, holding(p)) for k, p in TOKEN_ENTITIES.items()])


def vector_query(query: Column, context: Column) -> Column:
    """QRY7: the query after its context, if it has one."""
    return F.when(context != "", F.concat_ws(" ", context, query)).otherwise(query)


def keyword_query(query: Column) -> Column:
    """QRY7: the keywords, or the query itself where there are none."""
    found = keywords(query)
    return F.when(F.size(found) > 0, F.array_join(found, " ")).otherwise(query)


def word_count(query: Column) -> Column:
    return F.size(F.filter(F.split(query, r"\s+", -1), lambda w: w != ""))


def specificity(query: Column) -> Column:
    """QRY8: specific beyond 5 words or with a bracket, dot or arrow; broad up to 2 words; else general."""
    n = word_count(query)
    return F.when((n > 5) | query.rlike(r"[().]|->"), "specific").when(n <= 2, "broad").otherwise("general")


def action(query: Column) -> Column:
    """QRY8: the first action one of whose words the query holds, else search."""
    found = F
    for name, words in ACTIONS.items():
        found = found.when(F.lower(query).rlike(words), name)
    return found.otherwise("search")


def query_language(query: Column) -> Column:
    """QRY10: natural unless the query looks like code; then the first language with a word in it, else unknown."""
    found = F.when(~looks_like_code(query), "natural")
    for name, words in QUERY_LANGUAGES.items():
        found = found.when(query.rlike(f"(?i){words}"), name)
    return found.otherwise("unknown")


def query_complexity(query: Column) -> Column:
    """QRY9: up to 2 words simple, up to 5 medium, else complex."""
    n = word_count(query)
    return F.when(n <= 2, "simple").when(n <= 5, "medium").otherwise("complex")


def choose_strategy(kind: Column, complexity: Column) -> Column:
    """QRY11: adaptive choice among vector, keyword and hybrid."""
    return F.when(kind == "code", "keyword").when((kind == "question") | (complexity == "complex"), "hybrid").otherwise("vector")
