"""Registered queries over documents and their parts: profiles, sections, boundaries and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import profile as P
from .operators import boundaries as B
from .operators import parsing as PA
from .plans import views as W
from .registry import register
from .sources.tables import table


def columns(df: DataFrame, *keys: str, **found) -> DataFrame:
    """``df`` with its keys and the named columns of a profile."""
    return df.select(*keys, *[c.alias(n) for n, c in found.items()])


def _code(s: SparkSession, d: str) -> DataFrame:
    """code_view with its language and an import, a comment and a block comment before it."""
    head = F.concat(F.lit("import m"), (F.col("doc_id") % 7).cast("string"), F.lit('\n# note\n"""a\nb"""\n// x /* y\n*/\n'))
    return W.code_view(s, d).select("doc_id", "path", F.concat(head, F.col("text")).alias("text"), F.nullif(P.programming_language(F.col("path")), F.lit("unknown")).alias("language"))


_HEAD = "'import m' || (doc_id % 7) || chr(10) || '# note' || chr(10) || '\"\"\"a' || chr(10) || 'b\"\"\"' || chr(10) || '// x /* y' || chr(10) || '*/' || chr(10)"
_CODE = f"coded AS (SELECT doc_id, path, {_HEAD} || text AS text, CASE doc_id % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'go' END AS language FROM code_view)"
_LINES = "string_split({0}, chr(10))"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _count(text: str, mark: str) -> str:
    return f"(length({text}) - length(replace({text}, {_q(mark)}, ''))) // {len(mark)}"


def _per_language(values: dict[str, str], other: str = "NULL") -> str:
    return "CASE language " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


# DOC4 over text that is Markdown by its path, its signs, or not at all
_SIGNS = " + ".join(f"CAST(regexp_matches(t, {_q(p)}) AS INT)" for p in PA.MARKDOWN_SIGNS)
register(
    "doc4_detect_markdown",
    f"SELECT doc_id, CASE WHEN doc_id % 6 = 3 OR {_SIGNS} >= 2 THEN 'markdown' ELSE 'text' END AS type FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text WHEN doc_id % 4 = 1 THEN '# ' || text ELSE md END AS t FROM md_view)",
    lambda s, d: W.md_view(s, d).select("doc_id", PA.detect_markdown(F.col("path"), F.when(F.col("doc_id") % 4 == 0, F.col("text")).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("# "), F.col("text"))).otherwise(F.col("md"))).alias("type")),
)

_KIND = "CASE event_id % 8 WHEN 0 THEN 'json' WHEN 1 THEN 'json' WHEN 2 THEN 'json' WHEN 3 THEN 'xml' WHEN 4 THEN 'yaml' WHEN 5 THEN 'csv' WHEN 6 THEN 'json' ELSE 'csv' END"
register(
    "doc5_structured_type",
    f"SELECT event_id, {_KIND} AS type FROM structured",
    lambda s, d: W.structured(s, d).select("event_id", PA.detect_structured_type(F.col("path"), F.col("text")).alias("type")),
)
register(
    "doc8_text_sections",
    rf"""WITH m AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS n FROM (SELECT doc_id, {_LINES.format('md')} AS ls FROM md_view WHERE doc_id % 2 = 0)),
    p AS (SELECT doc_id, unnest(ps) AS x, generate_subscripts(ps, 1) - 1 AS n FROM (SELECT doc_id, string_split(md, chr(10) || chr(10)) AS ps FROM md_view WHERE doc_id % 2 = 1))
    SELECT doc_id, 'header' AS type, CAST(n AS INT) AS no, length(regexp_extract(x, '^(#{{1,6}})\s+(.+)$', 1)) AS level, {_STRIP.format(r"regexp_extract(x, '^(#{1,6})\s+(.+)$', 2)")} AS content FROM m WHERE regexp_matches(x, '^(#{{1,6}})\s+(.+)$')
    UNION ALL SELECT doc_id, 'paragraph', CAST(n AS INT), NULL, CASE WHEN length(x) > 100 AND length({_STRIP.format('x')}) > 100 THEN left({_STRIP.format('x')}, 100) || '...' WHEN length(x) > 100 THEN {_STRIP.format('x')} || '...' ELSE {_STRIP.format('x')} END FROM p WHERE {_STRIP.format('x')} <> ''""",
    lambda s, d: PA.text_sections(W.md_view(s, d).select("doc_id", F.col("md").alias("text")), F.when(F.col("doc_id") % 2 == 0, "markdown").otherwise("text")),
)

_SPANS = {k: " + ".join(f"coalesce(list_sum(list_transform(regexp_extract_all(text, {_q('(?m)' + p)}), lambda m: {_count('m', chr(10))} + 1)), 0)" for p in ps) for k, ps in PA.COMMENTS.items()}
_HITS = lambda p, x=_LINES.format("text"): f"len(list_filter({x}, lambda x: regexp_matches(x, {_q(p)})))"
_STRIPPED = f"list_transform({_LINES.format('text')}, lambda x: {_STRIP.format('x')})"
_IMPORTS = {k: f"list_filter({_STRIPPED}, lambda x: regexp_matches(x, {_q(ps['import'])}))" for k, ps in PA.STRUCTURES.items()}
_COUNTS = ", ".join(f"CAST({_per_language({k: _HITS(ps[c]) for k, ps in PA.STRUCTURES.items() if c in ps})} AS INT) AS {n}" for c, n in (("function", "functions"), ("class", "classes"), ("struct", "structs")))
register(
    "doc9_code_profile",
    f"""WITH {_CODE}, c AS (SELECT *, len(list_filter({_LINES.format('text')}, lambda x: {_STRIP.format('x')} <> '')) AS non_empty, CASE WHEN language IS NOT NULL THEN {_per_language(_SPANS, '0')} END AS comment_lines, {_per_language(_IMPORTS)} AS i FROM coded)
    SELECT doc_id, CAST(len({_LINES.format('text')}) AS INT) AS lines, CAST(length(text) AS INT) AS chars, CAST(non_empty AS INT) AS non_empty, CAST(comment_lines AS INT) AS comment_lines, CAST(non_empty - comment_lines AS INT) AS code_lines,
    array_to_string(i, '|') AS imports, CAST(len(i) AS INT) AS import_count, {_COUNTS}, CAST(1 + {' + '.join(_count('text', m) for m in PA.BRANCH_MARKS)} AS INT) AS complexity FROM c""",
    lambda s, d: columns(_code(s, d), "doc_id", **PA.code_profile(F.col("text"), F.col("language"))),
)
_SECTION = " UNION ALL ".join(
    f"SELECT doc_id, '{t}' AS type, {f'nullif(regexp_extract(x, {_q(p)}, 1), {_q(str())})' if '(\\w+)' in p else _q('unnamed')} AS name, CAST(n AS INT) AS line_number, {_STRIP.format('x')} AS content FROM l WHERE language = '{k}' AND regexp_matches(x, {_q(p)})"
    for k, ps in PA.STRUCTURES.items() for t, p in ps.items()
)
register(
    "doc10_code_sections",
    f"WITH {_CODE}, l AS (SELECT doc_id, language, unnest(ls) AS x, generate_subscripts(ls, 1) AS n FROM (SELECT doc_id, language, {_LINES.format('text')} AS ls FROM coded)) {_SECTION}",
    lambda s, d: PA.code_sections(_code(s, d), F.col("language")),
)

_BARE = r"""regexp_replace(regexp_replace(regexp_replace(text, '"(?:[^"\\]|\\.)*"', '0', 'g'), '\{\s*\}|\[\s*\]', '0', 'g'), '[^\[\]{}]', '', 'g')"""
register(
    "doc11_json_profile",
    rf"""SELECT event_id, CASE json_type(text) WHEN 'OBJECT' THEN 'object' ELSE 'array' END AS kind, CAST(CASE json_type(text) WHEN 'OBJECT' THEN len(json_keys(text)) ELSE json_array_length(text) END AS INT) AS n,
    CASE json_type(text) WHEN 'OBJECT' THEN array_to_string(json_keys(text)[:10], ',') END AS keys,
    CAST(list_max(list_transform(range(0, length({_BARE}) + 1), lambda i: 2 * length(regexp_replace(left({_BARE}, i), '[\]}}]', '', 'g')) - i)) AS INT) AS depth FROM structured WHERE event_id % 8 < 3""",
    lambda s, d: columns(W.structured(s, d).where(PA.detect_structured_type(F.col("path"), F.col("text")) == "json"), "event_id", **PA.json_profile(F.col("text"))).where("kind is not null"),
)
_ROWS = f"list_filter({_LINES.format('text')}, lambda x: x <> '')"
register(
    "doc12_csv_profile",
    f"SELECT event_id, CAST(len({_ROWS}) - 1 AS INT) AS row_count, CAST(len(string_split({_ROWS}[1], ',')) AS INT) AS column_count, {_ROWS}[1] AS columns FROM structured WHERE {_KIND} = 'csv'",
    lambda s, d: columns(W.structured(s, d).where(PA.detect_structured_type(F.col("path"), F.col("text")) == "csv"), "event_id", **PA.csv_profile(F.col("text"))),
)
register(
    "doc13_xml_profile",
    "SELECT event_id, 'r' AS root_tag, 3 AS element_count, 2 AS attribute_count, 'j,k,r' AS unique_tags, 3 AS tag_count FROM structured WHERE event_id % 8 = 3",
    lambda s, d: columns(W.structured(s, d).where(PA.detect_structured_type(F.col("path"), F.col("text")) == "xml"), "event_id", **PA.xml_profile(F.col("text"))),
)
register(
    "doc14_structured_sections",
    f"""SELECT event_id AS doc_id, 'json_key' AS type, CAST(i - 1 AS INT) AS no, k AS label, CASE WHEN length(json_extract_string(text, '$.' || k)) > 100 THEN left(json_extract_string(text, '$.' || k), 100) || '...' ELSE json_extract_string(text, '$.' || k) END AS content
        FROM (SELECT *, unnest(json_keys(text)) AS k, generate_subscripts(json_keys(text), 1) AS i FROM structured WHERE event_id % 8 < 2)
    UNION ALL SELECT event_id, 'csv_row', CAST(i - 1 AS INT), NULL, x FROM (SELECT event_id, unnest(r[2:11]) AS x, generate_subscripts(r[2:11], 1) AS i FROM (SELECT event_id, {_ROWS} AS r FROM structured WHERE {_KIND} = 'csv'))""",
    lambda s, d: PA.structured_sections(W.structured(s, d).withColumnRenamed("event_id", "doc_id"), PA.detect_structured_type(F.col("path"), F.col("text"))),
)
register(
    "doc15_page_sections",
    f"SELECT doc_id, CAST(n AS INT) AS page_number, CASE WHEN length(x) > 200 THEN left(x, 200) || '...' ELSE x END AS content, CAST(length(x) AS INT) AS char_count FROM (SELECT doc_id, unnest(ps[2:]) AS x, generate_subscripts(ps[2:], 1) AS n FROM (SELECT doc_id, string_split(md, '--- Page ') AS ps FROM md_view)) WHERE {_STRIP.format('x')} <> ''",
    lambda s, d: PA.page_sections(W.md_view(s, d).select("doc_id", F.col("md").alias("text"))),
)
_ANY = lambda x, marks: "(" + " OR ".join(f"contains({x}, '{m}')" for m in marks) + ")"
_LOOSE = lambda test: f"CAST(CASE WHEN doc_id % 6 < 2 THEN len(list_filter({_STRIPPED}, lambda x: {test})) END AS INT)"
register(
    "doc16_metadata_record",
    rf"""WITH {_CODE} SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS INT) AS word_count, CAST(length(text) AS INT) AS character_count, CAST(len({_LINES.format('text')}) AS INT) AS line_count,
    {_LOOSE(_ANY('x', ('def ', 'function ', 'func ', 'public ', 'private ')) + ' AND ' + _ANY('x', PA.FUNCTION_MARKS))} AS functions_count, {_LOOSE("contains(x, 'class ')")} AS classes_count,
    {_LOOSE('(' + ' OR '.join(f"starts_with(x, '{m}')" for m in PA.IMPORT_MARKS) + ')')} AS imports_count FROM coded""",
    lambda s, d: columns(_code(s, d), "doc_id", **PA.metadata_record(F.col("path"), F.col("text"))),
)
register(
    "doc19_route_parser",
    "SELECT doc_id AS id, CASE doc_id % 6 WHEN 3 THEN 'text' WHEN 4 THEN 'structured' WHEN 5 THEN 'text' ELSE 'code' END AS parser FROM documents UNION ALL SELECT page_id, 'text' FROM pages",
    lambda s, d: W.corpus(s, d).select(F.col("doc_id").alias("id"), PA.route_parser(P.document_type(F.col("path"))).alias("parser")).unionByName(table(s, d, "pages").select(F.col("page_id").alias("id"), PA.route_parser(F.lit("html")).alias("parser"))),
)
register(
    "doc20_parser_stats",
    "SELECT event_type AS parser, count(*) AS requests, round(count(*) FILTER (event_id % 3 > 0) / count(*), 6) AS success_rate, round(avg(value), 6) AS avg_time FROM events GROUP BY ROLLUP (event_type)",
    lambda s, d: PA.parser_stats(table(s, d, "events").select(F.col("event_type").alias("parser"), (F.col("event_id") % 3 > 0).alias("ok"), F.col("value").alias("seconds"))),
)

# boundaries
_NUMBERED = lambda view: f"l AS (SELECT doc_id, ls, unnest(ls) AS x, generate_subscripts(ls, 1) AS n, len(ls) AS total FROM (SELECT doc_id, {_LINES.format('text')} AS ls FROM {view}))"
_BRACES = f"b AS (SELECT *, sum({_count('x', '{')} - ({_count('x', '}')})) OVER (PARTITION BY doc_id ORDER BY n) AS depth, {_count('x', '{')} - ({_count('x', '}')}) AS own FROM l)"


def _boundaries(language: str, view: str) -> str:
    own = B.LANGUAGES[language]
    rows = ", ".join(f"({k}, '{kind}', {_q(p)})" for k, (kind, p) in enumerate((kind, p) for kind in ("import", "function", "class") for p in own[kind]))
    hit = f"h AS (SELECT l.*, k, type, regexp_extract(x, p, 1) AS name FROM l JOIN (VALUES {rows}) t(k, type, p) ON regexp_matches(x, p))"
    indent = r"length(regexp_extract({0}.x, '^\s*'))"
    if language == "python":
        end = rf"SELECT h.doc_id, h.ls, h.n, h.k, h.type, h.name, coalesce(min(o.n) - 1, h.total) AS e FROM h LEFT JOIN l o ON o.doc_id = h.doc_id AND o.n > h.n AND NOT regexp_matches(o.x, '^\s*$') AND {indent.format('o')} <= {indent.format('h')} WHERE h.type <> 'import' GROUP BY h.doc_id, h.ls, h.n, h.k, h.type, h.name, h.total"
    else:
        end = f"SELECT h.doc_id, h.ls, h.n, h.k, h.type, h.name, coalesce(min(o.n), h.total) AS e FROM h JOIN b s ON s.doc_id = h.doc_id AND s.n = h.n LEFT JOIN b o ON o.doc_id = h.doc_id AND o.n > h.n AND o.depth - s.depth + s.own = 0 WHERE h.type <> 'import' GROUP BY h.doc_id, h.ls, h.n, h.k, h.type, h.name, h.total"
    words = " + ".join(_count("c", w) for w in own["words"])
    return f"""WITH {_NUMBERED(view)}, {_BRACES}, {hit}, e AS ({end})
        SELECT doc_id, type, name, CAST(n AS INT) AS start_line, CAST(e AS INT) AS end_line, CAST(least(1 + {words}, 10) AS INT) AS complexity FROM (SELECT *, lower(array_to_string(ls[n : e], chr(10))) AS c FROM e)
        UNION ALL SELECT doc_id, 'imports', 'imports', CAST(min(n) AS INT), CAST(max(n) AS INT), 1 FROM h WHERE type = 'import' GROUP BY doc_id"""


register("chk4_python_boundaries", _boundaries("python", "coded").replace("WITH ", f"WITH {_CODE}, ", 1), lambda s, d: B.language_boundaries(_code(s, d), "python"))
register("chk4_go_boundaries", _boundaries("go", "brace_view"), lambda s, d: B.language_boundaries(W.brace_view(s, d), "go"))
#: By language what opens a function in its view of the documents, and what stands before the first line.
OPENERS = {
    "javascript": ("async function f", "import a from 'b'\nconst c = require('d')\nclass K extends L {\n}\n"),
    "typescript": ("function f", "import 'a'\nimport { b } from \"c\"\nclass K extends L implements M, N {\nx = (y): void => {\n}\n}\n"),
    "java": ("public static List<String> f", "import static a.b.C;\nimport d.*;\npublic final class K {\n}\n"),
    "csharp": ("internal int f", "using A.B;\nusing C;\npublic sealed class K {\n}\n"),
    "rust": ("async fn f", "use a::b;\nuse c::{d, e};\nstruct S {\n}\nenum E {\n}\ntrait T {\n}\n"),
}


def _opened(s, d, language: str):
    opener, before = OPENERS[language]
    return W.brace_view(s, d).withColumn("text", F.concat(F.lit(before), F.replace("text", F.lit("func f"), F.lit(opener))))


for _language, (_opener, _before) in OPENERS.items():
    _view = "opened AS (SELECT * REPLACE ({} || replace(text, 'func f', '{}') AS text) FROM brace_view)".format(" || chr(10) || ".join(_q(x) for x in _before.split("\n")), _opener)
    register(f"chk4_{_language}_boundaries", _boundaries(_language, "opened").replace("WITH ", f"WITH {_view}, ", 1), lambda s, d, own=_language: B.language_boundaries(_opened(s, d, own), own))
register(
    "chk6_brace_blocks",
    f"WITH {_NUMBERED('brace_view')}, {_BRACES} SELECT s.doc_id, CAST(s.n AS INT) AS start_line, CAST(coalesce(min(o.n), s.total) AS INT) AS end_line FROM b s LEFT JOIN b o ON o.doc_id = s.doc_id AND o.n > s.n AND o.depth - s.depth + s.own = 0 WHERE starts_with(s.x, 'func ') GROUP BY s.doc_id, s.n, s.total",
    lambda s, d: B.brace_block_ends(W.brace_view(s, d), "^func "),
)
_EDGE = "(starts_with(y, 'def ') OR starts_with(y, 'class ') OR starts_with(y, 'async def ') OR (starts_with(y, '#') AND length(y) > 10) OR (y = '' AND r.n + 1 > 10))"
_FIRST = f"list_filter(list_transform(ls[s:e], lambda x: {_STRIP.format('x')}), lambda x: starts_with(x, 'class ') OR starts_with(x, 'def ') OR starts_with(x, 'async def '))[1]"
register(
    "chk7_heuristic_chunks",
    f"""WITH RECURSIVE {_NUMBERED('code_view')}, m AS (SELECT doc_id, n AS i, {_STRIP.format('x')} AS y FROM l WHERE NOT (total = 1 AND x = '')),
    r AS (SELECT doc_id, 0 AS i, 1 AS start, 0 AS n, NULL::INT AS s, NULL::INT AS e, NULL::INT AS k FROM m WHERE i = 1
        UNION ALL SELECT doc_id, i, CASE WHEN cut AND edge THEN i WHEN cut THEN i + 1 ELSE start END, CASE WHEN cut AND edge THEN 1 WHEN cut THEN 0 ELSE n END, CASE WHEN cut THEN start END, CASE WHEN cut AND edge THEN i - 1 WHEN cut THEN i END, CASE WHEN cut THEN least(n // 10 + 1, 10) END
        FROM (SELECT m.doc_id, CAST(m.i AS INT) AS i, r.start, r.n + 1 AS n, {_EDGE} AS edge, ({_EDGE} AND r.n + 1 > 5) OR r.n + 1 > 50 AS cut FROM r JOIN m ON m.doc_id = r.doc_id AND m.i = r.i + 1)),
    a AS (SELECT doc_id, s, e, k FROM r WHERE s IS NOT NULL UNION ALL SELECT doc_id, start, start + n - 1, least(n // 10 + 1, 10) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS z FROM r) WHERE z = 1 AND n > 0),
    t AS (SELECT a.*, array_to_string(ls[s:e], chr(10)) AS c, {_FIRST} AS f FROM a JOIN (SELECT DISTINCT ON (doc_id) doc_id, ls FROM l) USING (doc_id)),
    u AS (SELECT *, CASE WHEN contains(c, 'class ') THEN 'class' WHEN contains(c, 'def ') THEN 'function' WHEN contains(c, 'import ') OR contains(c, 'from ') THEN 'import' ELSE 'code_block' END AS type FROM t)
    SELECT doc_id, type, CASE WHEN starts_with(f, 'class ') THEN trim(replace(split_part(f, '(', 1), 'class ', '')) WHEN f IS NOT NULL THEN trim(replace(replace(split_part(f, '(', 1), 'def ', ''), 'async ', ''))
        ELSE CASE type WHEN 'import' THEN 'imports' WHEN 'class' THEN 'class_definition' WHEN 'function' THEN 'function_definition' ELSE 'code_block' END END AS name, CAST(s AS INT) AS start_line, CAST(e AS INT) AS end_line, CAST(k AS INT) AS complexity FROM u""",
    lambda s, d: B.heuristic_chunks(W.code_view(s, d)),
)

_SPLIT = r"""p AS (SELECT doc_id, name, content, start_line, end_line, [start_line] || CASE WHEN contains(content, 'e.') THEN list_filter(list_transform(string_split(content, chr(10)), lambda x, i: CASE WHEN i > 1 AND regexp_matches(x, 'e.') THEN start_line + i - 1 END), lambda v: v IS NOT NULL) ELSE [] END AS st FROM chunks)"""
register(
    "chk12_pattern_split",
    f"WITH {_SPLIT} SELECT doc_id, name, CAST(st[i] AS INT) AS start_line, CAST(coalesce(st[i + 1] - 1, end_line) AS INT) AS end_line, array_to_string(string_split(content, chr(10))[st[i] - start_line + 1 : coalesce(st[i + 1] - 1, end_line) - start_line + 1], chr(10)) AS content FROM (SELECT *, unnest(range(1, len(st) + 1)) AS i FROM p)",
    lambda s, d: B.rule_pattern(W.chunks(s, d).select("doc_id", "name", "start_line", "end_line", "content"), "contains", "e.", "split"),
)
register(
    "chk12_pattern_mark_skip",
    rf"SELECT doc_id, chunk_no, CASE WHEN length(content) >= 400 THEN 'long' END AS custom_type FROM chunks WHERE NOT starts_with({_STRIP.format('content')}, 'The') AND NOT ends_with({_STRIP.format('content')}, '!') AND len(string_split(content, chr(10))) < 10",
    lambda s, d: B.rule_pattern(B.rule_pattern(B.rule_pattern(B.rule_pattern(W.chunks(s, d), "starts_with", "The", "skip"), "ends_with", "!", "skip"), "line_count", 10, "skip"), "char_count", 400, "mark", "long").select("doc_id", "chunk_no", "custom_type"),
)


def _classes(s: SparkSession, d: str) -> DataFrame:
    """Each document of code_view as one class, short ones too."""
    return W.code_view(s, d).select("doc_id", F.lit("class").alias("type"), F.lit("C").alias("name"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n", -1)).alias("end_line"), F.lit(2).alias("complexity"), F.col("text").alias("content"))


register(
    "chk14_class_by_methods",
    rf"""WITH c AS (SELECT doc_id, {_LINES.format('text')} AS ls FROM code_view), m AS (SELECT *, list_filter(list_transform(ls, lambda x, i: CASE WHEN regexp_matches(x, {_q(B.METHOD)}) THEN i END), lambda v: v IS NOT NULL) AS st FROM c),
    o AS (SELECT doc_id, len(ls) - 1 > 8 AND len(st) > 1 AS split, CASE WHEN len(ls) - 1 > 8 AND len(st) > 1 THEN st ELSE [1] END AS st, len(ls) AS n FROM m)
    SELECT doc_id, CASE WHEN split THEN 'method' ELSE 'class' END AS type, CASE WHEN split THEN 'C_method_' || i ELSE 'C' END AS name, CAST(st[i] AS INT) AS start_line, CAST(coalesce(st[i + 1] - 1, n) AS INT) AS end_line, 2 AS complexity FROM (SELECT *, unnest(range(1, len(st) + 1)) AS i FROM o)""",
    lambda s, d: B.rule_class_by_methods(_classes(s, d), 8).drop("content"),
)
_RULES = (B.Rule("size", "line_count", 4, "split", 3), B.Rule("size", "line_count", 4, "merge", 2), B.Rule("pattern", "contains", "ing", "skip", 1), B.Rule("pattern", "char_count", 300, "mark", 0), B.Rule("size", "line_count", 1, "split", 9, False))
register(
    "chk15_apply_strategy",
    """WITH RECURSIVE p AS (SELECT doc_id, CASE WHEN k > 1 THEN name || '_' || i ELSE name END AS name, start_line + (i - 1) * (n // k) AS start_line, CASE WHEN i = k THEN end_line ELSE start_line + i * (n // k) - 1 END AS end_line
        FROM (SELECT *, end_line - start_line + 1 AS n, CAST(ceil(n / 4.0) AS INT) AS k, unnest(range(1, CAST(ceil((end_line - start_line + 1) / 4.0) AS INT) + 1)) AS i FROM chunks)),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_line, end_line, name) AS z FROM p),
    r AS (SELECT doc_id, z, z AS head, start_line AS first, end_line, name AS whole, 'x' AS type, end_line - start_line + 1 < 4 AS open FROM o WHERE z = 1
        UNION ALL SELECT o.doc_id, o.z, CASE WHEN r.open THEN r.head ELSE o.z END, CASE WHEN r.open THEN r.first ELSE o.start_line END, o.end_line, CASE WHEN r.open THEN r.whole || '+' || o.name ELSE o.name END, CASE WHEN r.open THEN 'merged' ELSE 'x' END, NOT r.open AND o.end_line - o.start_line + 1 < 4 FROM r JOIN o ON o.doc_id = r.doc_id AND o.z = r.z + 1),
    g AS (SELECT doc_id, first, end_line, whole, type FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, head ORDER BY z DESC) = 1),
    c AS (SELECT g.*, array_to_string(string_split(text, chr(10))[first : end_line], chr(10)) AS content FROM g JOIN documents USING (doc_id))
    SELECT doc_id, CASE WHEN length(content) >= 300 THEN 'special' ELSE type END AS type, whole AS name, CAST(first AS INT) AS start_line, CAST(end_line AS INT) AS end_line, 1 AS complexity, content FROM c WHERE NOT contains(content, 'ing')""",
    lambda s, d: B.apply_strategy(W.chunks(s, d).withColumn("type", F.lit("x")).withColumn("complexity", F.lit(1)), table(s, d, "documents"), B.strategy_from_json(B.strategy_to_json(_RULES))),
)
