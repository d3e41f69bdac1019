"""Profiles and sections of text, code and structured documents (DOC); columns and in-row arrays, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.profile import extension

#: Signs of Markdown, two of which make a text Markdown.
MARKDOWN_SIGNS = (r"(?m)^#{1,6}\s+", r"(?m)^\*\s+", r"(?m)^\d+\.\s+", r"\[.*\]\(.*\)", "```", r"\*\*.*\*\*", r"\*.*\*")
#: What extensions say about structured data.
STRUCTURED_TYPES = {".json": "json", ".yaml": "yaml", ".yml": "yaml", ".xml": "xml", ".csv": "csv"}
#: Comments of each language.
_SLASHES = (r"//.*$", r"/\*[\s\S]*?\*/")
COMMENTS = {
    "python": (r"#.*$", r'"""[\s\S]*?"""', r"'''[\s\S]*?'''"),
    "javascript": _SLASHES, "typescript": _SLASHES, "java": _SLASHES, "cpp": _SLASHES, "c": _SLASHES, "csharp": _SLASHES, "go": _SLASHES, "rust": _SLASHES,
    "php": (*_SLASHES, r"#.*$"), "ruby": (r"#.*$", r"=begin[\s\S]*?=end"), "bash": (r"#.*$",), "sql": (r"--.*$", r"/\*[\s\S]*?\*/"),
}
#: Lines that begin a structure, by language; the first group, if any, is its name.
STRUCTURES = {
    "python": {"function": r"^\s*def\s+(\w+)\s*\(", "class": r"^\s*class\s+(\w+)\s*[:\(]", "import": r"^\s*(?:from\s+\S+\s+)?import\s+"},
    "javascript": {"function": r"^\s*(?:function\s+(\w+)|(\w+)\s*[:=]\s*(?:function|\([^)]*\)\s*=>))", "class": r"^\s*class\s+(\w+)", "import": r"^\s*(?:import|export)"},
    "java": {"function": r"^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:\w+\s+)*(\w+)\s*\(", "class": r"^\s*(?:public\s+)?class\s+(\w+)", "import": r"^\s*import\s+"},
    "go": {"function": r"^\s*func\s+(?:\([^)]*\)\s+)?(\w+)\s*\(", "struct": r"^\s*type\s+(\w+)\s+struct", "import": r"^\s*import\s+"},
}
#: What counts as a branch in a code profile, anywhere in the text.
BRANCH_MARKS = ("if", "elif", "else", "for", "while", "try", "except", "catch", "switch", "case", "default", "&&", "||", "?")
#: Files whose metadata record counts code, and marks of functions, classes and imports in it.
CODE_FILES = (".py", ".js", ".ts", ".java", ".cpp", ".c", ".h")
FUNCTION_MARKS = ("def ", "function", "func")
IMPORT_MARKS = ("import ", "from ", "#include", "using ", "require(")
#: The parser of each document type.
PARSERS = {"text": "text", "markdown": "text", "html": "text", "code": "code", "pdf": "pdf", "json": "structured", "yaml": "structured", "xml": "structured", "csv": "structured"}


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def occurrences(text: Column, mark: str) -> Column:
    """How often ``mark`` stands in the text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)).cast("int")


def preview(text: Column, size: int, of: Column | None = None) -> Column:
    """The first ``size`` characters, with dots where ``of`` (the text itself) is longer."""
    return F.when(F.length(text if of is None else of) > size, F.concat(F.left(text, F.lit(size)), F.lit("..."))).otherwise(text)


def detect_markdown(path: Column, text: Column) -> Column:
    """DOC4: markdown by extension, or by at least two of the signs; else text. A null text has no signs."""
    signs = sum((F.coalesce(text.rlike(p).cast("int"), F.lit(0)) for p in MARKDOWN_SIGNS), F.lit(0))
    return F.when(extension(path).isin(".md", ".markdown") | (signs >= 2), "markdown").otherwise("text")


def detect_structured_type(path: Column, text: Column) -> Column:
    """DOC5: by extension; else JSON (brackets, and it parses), XML, YAML (a colon), CSV (a comma and lines), and JSON for want of better."""
    by_path = F.coalesce(*[F.when(extension(path) == e, t) for e, t in STRUCTURED_TYPES.items()])
    bare = strip(text)
    bracketed = (bare.startswith("{") & bare.endswith("}")) | (bare.startswith("[") & bare.endswith("]"))
    tagged = bare.startswith("<")
    by_text = (
        F.when(bracketed & F.try_parse_json(text).isNotNull(), "json")
        .when(tagged & bare.endswith(">"), "xml")
        .when(F.contains(text, F.lit(":")) & ~tagged, "yaml")
        .when(F.contains(text, F.lit(",")) & F.contains(text, F.lit("\n")), "csv")
        .otherwise("json")
    )
    return F.coalesce(by_path, by_text)


def text_sections(docs: DataFrame, kind: Column, text_col: str = "text") -> DataFrame:
    """DOC8: (doc_id, type, no, level, content): headers of Markdown by line number, else paragraphs by index with a 100-character preview."""
    header = r"^(#{1,6})\s+(.+)$"
    headers = F.filter(F.transform(lines_of(F.col(text_col)), lambda x, i: F.struct((i + 1).alias("no"), x.alias("x"))), lambda s: s["x"].rlike(header))
    headers = F.transform(headers, lambda s: F.struct(F.lit("header").alias("type"), s["no"].alias("no"), F.length(F.regexp_extract(s["x"], header, 1)).alias("level"), strip(F.regexp_extract(s["x"], header, 2)).alias("content")))
    parts = F.filter(F.transform(F.split(text_col, "\n\n", -1), lambda x, i: F.struct(i.alias("no"), x.alias("x"))), lambda s: strip(s["x"]) != "")
    parts = F.transform(parts, lambda s: F.struct(F.lit("paragraph").alias("type"), s["no"].alias("no"), F.lit(None).cast("int").alias("level"), preview(strip(s["x"]), 100, s["x"]).alias("content")))
    return docs.select("doc_id", F.explode(F.when(kind == "markdown", headers).otherwise(parts)).alias("s")).select("doc_id", "s.type", "s.no", "s.level", "s.content")


def _by_language(language: Column, values: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(language == name, value) for name, value in values.items()])


def code_profile(text: Column, language: Column) -> dict[str, Column]:
    """DOC9: lines, comments, imports and structures by the language's patterns, and a count of branches.

    A comment pattern counts the lines it spans, so a line that two patterns hit counts twice. What needs the language is null for
    a language without patterns.
    """
    lines = lines_of(text)
    spans = lambda p: F.aggregate(F.regexp_extract_all(text, F.lit(f"(?m){p}"), F.lit(0)), F.lit(0), lambda n, m: n + occurrences(m, "\n") + 1)
    hits = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p)))
    comments = F.when(language.isNotNull(), F.coalesce(_by_language(language, {k: sum((spans(p) for p in ps), F.lit(0)) for k, ps in COMMENTS.items()}), F.lit(0)))
    filled = F.size(F.filter(lines, lambda x: strip(x) != ""))
    stripped = lambda p: F.filter(F.transform(lines, strip), lambda x: x.rlike(p))
    imports = _by_language(language, {k: stripped(ps["import"]) for k, ps in STRUCTURES.items()})
    count = lambda name: _by_language(language, {k: hits(ps[name]) for k, ps in STRUCTURES.items() if name in ps})
    return {
        "lines": F.size(lines), "chars": F.length(text), "non_empty": filled, "comment_lines": comments, "code_lines": filled - comments, "imports": F.array_join(imports, "|"), "import_count": F.when(imports.isNotNull(), F.size(imports)),
        "functions": count("function"), "classes": count("class"), "structs": count("struct"), "complexity": sum((occurrences(text, m) for m in BRANCH_MARKS), F.lit(1)),
    }


def code_sections(docs: DataFrame, language: Column, text_col: str = "text") -> DataFrame:
    """DOC10: (doc_id, type, name, line_number, content) of each line and structure pattern that hits it; none for other languages."""
    lines = F.transform(lines_of(F.col(text_col)), lambda x, i: F.struct((i + 1).alias("n"), x.alias("x")))

    def found(kind: str, p: str) -> Column:
        name = lambda x: F.nullif(F.regexp_extract(x, p, 1), F.lit("")) if "(\\w+)" in p else F.lit("unnamed")
        hits = F.filter(lines, lambda s: s["x"].rlike(p))
        return F.transform(hits, lambda s: F.struct(F.lit(kind).alias("type"), name(s["x"]).alias("name"), s["n"].alias("line_number"), strip(s["x"]).alias("content")))

    each = _by_language(language, {k: F.concat(*[found(*each) for each in ps.items()]) for k, ps in STRUCTURES.items()})
    return docs.select("doc_id", F.explode(each).alias("s")).select("doc_id", "s.type", "s.name", "s.line_number", "s.content")


def json_depth(text: Column) -> Column:
    """How deep objects and arrays are nested; an empty one adds nothing. Read off the brackets outside strings."""
    plain = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', "0"), r"\{\s*\}|\[\s*\]", "0")
    marks = F.split(F.regexp_replace(plain, r"[^\[\]{}]", ""), "")
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("most"))
    step = lambda s, c: F.when(c.isin("[", "{"), s["at"] + 1).when(c.isin("]", "}"), s["at"] - 1).otherwise(s["at"])
    return F.aggregate(marks, zero, lambda s, c: F.struct(step(s, c).alias("at"), F.greatest(s["most"], step(s, c)).alias("most")), lambda s: s["most"])


def json_profile(text: Column) -> dict[str, Column]:
    """DOC11: object, array or other; keys or items; the first ten keys; the depth of nesting. Null where the text is no JSON."""
    keys, items = F.json_object_keys(text), F.json_array_length(text)
    kind = F.when(keys.isNotNull(), "object").when(items.isNotNull(), "array").when(F.try_parse_json(text).isNotNull(), "other")
    return {"kind": kind, "n": F.when(keys.isNotNull(), F.size(keys)).otherwise(items), "keys": F.array_join(F.slice(keys, 1, 10), ","), "depth": F.when(kind.isin("object", "array"), json_depth(text))}


def csv_profile(text: Column) -> dict[str, Column]:
    """DOC12: rows below the header, blank lines not counted, and the header's columns (none without a row); fields in quotes are not told apart."""
    rows = F.filter(F.transform(lines_of(text), lambda x: F.regexp_replace(x, "\r$", "")), lambda x: x != "")
    n = F.greatest(F.size(rows) - 1, F.lit(0))
    header = F.when(n > 0, F.split(F.get(rows, F.lit(0)), ",", -1)).otherwise(F.array().cast("array<string>"))
    return {"row_count": n, "column_count": F.size(header), "columns": F.array_join(header, ",")}


def xml_profile(text: Column) -> dict[str, Column]:
    """DOC13: root, elements, attributes and distinct tags (the first 20 by name) of well-formed XML."""
    plain = F.regexp_replace(text, r"<!--[\s\S]*?-->|<!\[CDATA\[[\s\S]*?\]\]>|<\?[\s\S]*?\?>", "")
    tags = F.regexp_extract_all(plain, F.lit(r"<([A-Za-z_][\w.\-:]*)"), 1)
    attributes = F.regexp_extract_all(plain, F.lit(r"(<[A-Za-z_][^<>]*>)"), 1)
    count = F.aggregate(attributes, F.lit(0), lambda n, t: n + F.size(F.regexp_extract_all(t, F.lit(r"""(\s[\w.\-:]+\s*=\s*(?:"[^"]*"|'[^']*'))"""), 1)))
    unique = F.array_sort(F.array_distinct(tags))
    return {"root_tag": F.get(tags, F.lit(0)), "element_count": F.size(tags), "attribute_count": count, "unique_tags": F.array_join(F.slice(unique, 1, 20), ","), "tag_count": F.size(unique)}


def structured_sections(docs: DataFrame, kind: Column, text_col: str = "text") -> DataFrame:
    """DOC14: (doc_id, type, no, label, content): a JSON object's keys with a 100-character preview of the value, a CSV's first ten rows."""
    own = F.from_json(text_col, "map<string,string>")
    keys = F.transform(F.map_entries(own), lambda e, i: F.struct(F.lit("json_key").alias("type"), i.alias("no"), e["key"].alias("label"), preview(e["value"], 100).alias("content")))
    rows = F.filter(F.transform(lines_of(F.col(text_col)), lambda x: F.regexp_replace(x, "\r$", "")), lambda x: x != "")
    rows = F.transform(F.slice(rows, 2, 10), lambda x, i: F.struct(F.lit("csv_row").alias("type"), i.alias("no"), F.lit(None).cast("string").alias("label"), x.alias("content")))
    each = F.when((kind == "json") & F.json_object_keys(text_col).isNotNull(), keys).when(kind == "csv", rows)
    return docs.select("doc_id", F.explode(each).alias("s")).select("doc_id", "s.type", "s.no", "s.label", "s.content")


def page_sections(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """DOC15: what follows each page mark, numbered from 1, with a 200-character preview and its length; blank pages are left out."""
    parts = F.split(text_col, "--- Page ", -1)
    pages = F.filter(F.transform(F.slice(parts, 2, F.size(parts)), lambda x, i: F.struct((i + 1).alias("no"), x.alias("x"))), lambda s: strip(s["x"]) != "")
    return docs.select("doc_id", F.explode(pages).alias("s")).select("doc_id", F.col("s.no").alias("page_number"), preview(F.col("s.x"), 200).alias("content"), F.length("s.x").alias("char_count"))


def metadata_record(path: Column, text: Column) -> dict[str, Column]:
    """DOC16: words, characters and lines (0 of an empty or null text), and for code files counts of lines by loose marks."""
    text = F.coalesce(text, F.lit(""))
    lines = F.transform(lines_of(text), strip)
    has = lambda x, marks: sum((F.contains(x, F.lit(m)).cast("int") for m in marks), F.lit(0)) > 0
    starts = lambda x, marks: sum((F.startswith(x, F.lit(m)).cast("int") for m in marks), F.lit(0)) > 0
    is_code = path.rlike("(" + "|".join(e.replace(".", r"\.") for e in CODE_FILES) + ")$")
    # a line counts as a function only with one of the marks that need no blank after them
    function = lambda x: has(x, ("def ", "function ", "func ", "public ", "private ")) & has(x, FUNCTION_MARKS)
    count = lambda test: F.when(is_code, F.when(text == "", 0).otherwise(F.size(F.filter(lines, test))))
    return {
        "word_count": F.size(F.filter(F.split(text, r"\s+", -1), lambda w: w != "")), "character_count": F.length(text), "line_count": F.when(text == "", 0).otherwise(F.size(lines)),
        "functions_count": count(function), "classes_count": count(lambda x: F.contains(x, F.lit("class "))), "imports_count": count(lambda x: starts(x, IMPORT_MARKS)),
    }


def route_parser(kind: Column) -> Column:
    """DOC19: which parser a document type goes to; null for none."""
    return F.coalesce(*[F.when(kind == k, p) for k, p in PARSERS.items()])


def parser_stats(requests: DataFrame) -> DataFrame:
    """DOC20: of (parser, ok, seconds) rows the requests, success rate and mean time of each parser, and of all (a null parser)."""
    return requests.rollup("parser").agg(F.count("*").alias("requests"), F.round(F.count_if("ok") / F.count("*"), 6).alias("success_rate"), F.round(F.avg("seconds"), 6).alias("avg_time"))
