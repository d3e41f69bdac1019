"""Profiles, boundaries and rules on literal rows: nulls, empty texts and the traps of each."""

import itertools
import json
import random
import time

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import boundaries as B
from tessella.operators import chunks, parsing


def one(spark, text, **columns):
    return spark.createDataFrame([(text,)], "text string").select(*[c.alias(n) for n, c in columns.items()]).first()


def test_markdown_is_told_by_path_or_two_signs(spark):
    rows = [("a.MD", None, "markdown"), ("a", None, "text"), ("a.txt", "# x", "text"), ("a", "# x\n1. y", "markdown"), ("a", "**b**", "markdown"), ("a", "", "text")]
    frame = spark.createDataFrame(rows, "path string, text string, want string")
    assert frame.where(parsing.detect_markdown(F.col("path"), F.col("text")) != F.col("want")).count() == 0


def test_structured_types_of_odd_texts(spark):
    rows = [("x.yml", "{}", "yaml"), ("x", " [1, 2] ", "json"), ("x", "{a: 1}", "yaml"), ("x", "{a}", "json"), ("x", "<a:b/>", "xml"), ("x", "<a: b", "json"), ("x", "a,b\n1,2", "csv"), ("x", "", "json"), ("x", None, "json")]
    frame = spark.createDataFrame(rows, "path string, text string, want string")
    assert frame.where(parsing.detect_structured_type(F.col("path"), F.col("text")) != F.col("want")).count() == 0


def test_json_depth_against_recursion(spark):
    def depth(x):
        inner = x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()
        return max((1 + depth(y) for y in inner), default=0)

    rnd = random.Random(1)

    def value(n):
        kind = rnd.randrange(5 if n else 3)
        return ["x]}\"[", rnd.randrange(9), None, None, None][kind] if kind < 3 else [value(n - 1) for _ in range(rnd.randrange(3))] if kind == 3 else {f"k{i}{{": value(n - 1) for i in range(rnd.randrange(3))}

    rows = [([value(4)], i) for i in range(60)]
    frame = spark.createDataFrame([(i, json.dumps(x)) for x, i in rows], "i int, text string")
    got = {r.i: r.d for r in frame.select("i", parsing.json_depth(F.col("text")).alias("d")).collect()}
    assert got == {i: depth(x) for x, i in rows}


def test_profiles_of_small_tables(spark):
    csv = one(spark, "name,age,city\r\nA,1,x\r\n\r\nB,2,y\r\n", **parsing.csv_profile(F.col("text")))
    assert (csv.row_count, csv.column_count, csv.columns) == (2, 3, "name,age,city")
    assert tuple(one(spark, "a,b", **parsing.csv_profile(F.col("text")))) == (0, 0, "")
    xml = one(spark, '<?xml version="1.0"?><!-- <no/> --><a x="1" y=\'<2\'><b z="3">t</b><b/></a>', **parsing.xml_profile(F.col("text")))
    assert (xml.root_tag, xml.element_count, xml.unique_tags) == ("a", 3, "a,b")
    plain = one(spark, "not json", **parsing.json_profile(F.col("text")))
    assert plain.kind is None and plain.depth is None


def test_code_profile_and_record_of_a_small_file(spark):
    code = "import os\nfrom a import b\n\nclass A:\n    # note\n    def f(self):\n        if x: pass\n"
    got = one(spark, code, **parsing.code_profile(F.col("text"), F.lit("python")))
    assert (got.lines, got.non_empty, got.comment_lines, got.code_lines, got.import_count, got.functions, got.classes, got.structs) == (8, 6, 1, 5, 2, 1, 1, None)
    assert got.complexity == 1 + code.count("if")
    other = one(spark, code, **parsing.code_profile(F.col("text"), F.lit(None).cast("string")))
    assert (other.comment_lines, other.import_count) == (None, None)
    record = one(spark, code, **parsing.metadata_record(F.lit("x.py"), F.col("text")))
    assert (record.functions_count, record.classes_count, record.imports_count, record.line_count) == (1, 1, 2, 8)
    empty = one(spark, None, **parsing.metadata_record(F.lit("x.py"), F.col("text")))
    assert tuple(empty) == (0, 0, 0, 0, 0, 0)
    assert one(spark, "x", **parsing.metadata_record(F.lit("x.md"), F.col("text"))).functions_count is None


def test_blocks_with_braces_end_where_they_are_closed(spark):
    text = "func a() {\n  if x {\n  }\n}\nfunc b() {}\nfunc c() {\nx"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in B.brace_block_ends(rows, "^func").collect()) == [(1, 1, 4), (1, 5, 7), (1, 6, 7)]
    found = sorted((r.type, r.name, r.start_line, r.end_line) for r in B.language_boundaries(rows, "go").collect())
    assert found == [("function", "a", 1, 4), ("function", "b", 5, 7), ("function", "c", 6, 7)]


def test_python_boundaries_join_imports(spark):
    text = "import os\n\nasync def f(x):\n    if x:\n        pass\n\nfrom a import b\nclass C:\n    pass"
    rows = B.language_boundaries(spark.createDataFrame([(1, text)], "doc_id long, text string"), "python").collect()
    # an asynchronous function is hit by two patterns, and the import of from-lines too
    assert sorted((r.type, r.name, r.start_line, r.end_line) for r in rows) == [("class", "C", 8, 9), ("function", "f", 3, 6), ("function", "f", 3, 6), ("imports", "imports", 1, 7)]


def test_blocks_of_many_lines_against_a_plain_loop(spark):
    rnd = random.Random(11)
    lines = ["def f(x):", "    if a:", "fn g() {", "  }", "", "  } else {", "x", "\tfor y in z: {", "class A:", "import b", "use a::b;"]
    texts = {i: "\n".join(rnd.choice(lines) for _ in range(rnd.randrange(1, 80))) for i in range(60)}
    texts[60] = "\n".join(["fn g() {"] * 8_000)  # block by block that is 32 million lines
    frame = spark.createDataFrame([*texts.items(), (61, None)], "doc_id long, text string").coalesce(1)
    for language, begins, uses in (("python", ("def f", "class A"), "import b"), ("rust", ("fn g",), "use a")):
        want = []
        for i, text in texts.items():
            rows = text.split("\n")
            at = [n for n, x in enumerate(rows) if uses in x]
            want += [(i, at[0] + 1, at[-1] + 1, 1)] if at else []
            count = [sum(x.lower().count(w) for w in B.LANGUAGES[language]["words"]) for x in rows]
            size, depth = [len(x) - len(x.lstrip()) for x in rows], np.cumsum([x.count("{") - x.count("}") for x in rows])
            for n, x in enumerate(rows):
                if x.startswith(begins):
                    before = depth[n - 1] if n else 0
                    if language == "python":
                        end = next((m - 1 for m in range(n + 1, len(rows)) if rows[m].strip() and size[m] <= size[n]), len(rows) - 1)
                    else:
                        end = len(rows) - 1 if i == 60 else next((m for m in range(n + 1, len(rows)) if depth[m] == before), len(rows) - 1)
                    want.append((i, n + 1, end + 1, min(10, 1 + sum(count[n : end + 1]))))
        began = time.time()
        got = sorted((r.doc_id, r.start_line, r.end_line, r.complexity) for r in B.language_boundaries(frame, language).collect())
        assert got == sorted(want) and time.time() - began < 30


def test_heuristic_chunks_against_a_plain_loop(spark):
    rnd = random.Random(5)
    lines = ["def f(x):", "class A(B):", "  async def g():", "# a longer comment", "# short", "", "x = 1", "import os"]
    docs = [(i, "\n".join(rnd.choice(lines + ["y"] * (i % 30)) for _ in range(rnd.randrange(1, 150)))) for i in range(40)]
    want = []
    for i, text in docs:
        start, held = 1, 0
        all_lines = text.split("\n")
        for n, line in enumerate(all_lines, 1):
            held += 1
            s = line.strip()
            edge = s.startswith(("def ", "class ", "async def ")) or (s.startswith("#") and len(s) > 10) or (not s and held > 10)
            if (edge and held > 5) or held > 50:
                want.append((i, start, n - edge, min(held // 10 + 1, 10)))
                start, held = (n, 1) if edge else (n + 1, 0)
        if held and text:
            want.append((i, start, len(all_lines), min(held // 10 + 1, 10)))
    frame = spark.createDataFrame([*docs, (98, ""), (99, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.start_line, r.end_line, r.complexity) for r in B.heuristic_chunks(frame).collect())
    assert got == sorted(want)


def chunk(spark, *rows):
    return spark.createDataFrame(rows, "doc_id long, type string, name string, start_line int, end_line int, complexity int")


def test_rules_split_mark_and_skip(spark):
    docs = spark.createDataFrame([(1, "\n".join(["a", "# b", "c", "# d", "# e"])), (2, "plain")], "doc_id long, text string")
    held = B.with_content(chunk(spark, (1, "file", "x", 1, 5, 1), (2, "file", "y", 1, 1, 1)), docs)
    split = sorted((r.doc_id, r.start_line, r.end_line, r.content) for r in B.rule_pattern(held, "contains", "#", "split").collect())
    assert split == [(1, 1, 1, "a"), (1, 2, 3, "# b\nc"), (1, 4, 4, "# d"), (1, 5, 5, "# e"), (2, 1, 1, "plain")]
    assert [r.doc_id for r in B.rule_pattern(held, "line_count", 5, "skip").collect()] == [2]
    assert B.rule_pattern(held, "unknown", 1, "skip").count() == 2 and B.rule_pattern(held, "contains", "#", "dance").count() == 2
    assert {r.doc_id: r.custom_type for r in B.rule_pattern(held, "starts_with", "pl", "mark").collect()} == {1: None, 2: "special"}


def test_classes_with_one_method_stay_whole(spark):
    docs = spark.createDataFrame([(1, "class A:\n  def f(x):\n    pass"), (2, "class B:\n  x = 1\n  def f(x):\n    pass\n  def g(x):\n    pass")], "doc_id long, text string")
    held = B.with_content(chunk(spark, (1, "class", "A", 1, 3, 1), (2, "class", "B", 1, 6, 1)), docs)
    got = sorted((r.type, r.name, r.start_line, r.end_line) for r in B.rule_class_by_methods(held, 1).collect())
    assert got == [("class", "A", 1, 3), ("method", "B_method_1", 3, 4), ("method", "B_method_2", 5, 6)]


def test_strategies_by_priority_and_as_json(spark):
    docs = spark.createDataFrame([(1, "\n".join(f"l{i}" for i in range(250)))], "doc_id long, text string")
    held = chunk(spark, (1, "function", "a", 1, 5, 2), (1, "function", "b", 6, 230, 7), (1, "class", "c", 231, 250, 1))
    got = sorted((r.start_line, r.end_line, r.name, r.type, r.complexity) for r in B.apply_strategy(held, docs).collect())
    assert got == [(1, 115, "a+b_1", "merged", 7), (116, 230, "a+b_2", "merged", 7), (231, 250, "c", "class", 1)]
    assert B.strategy_from_json(B.strategy_to_json(B.DEFAULT_STRATEGY)) == list(B.DEFAULT_STRATEGY)
    assert B.strategy_from_json('[{"kind": "size", "condition": "line_count", "value": 1, "action": "split", "colour": "red"}]') == [B.Rule("size", "line_count", 1, "split")]
    grouped = B.apply_strategy(held, docs, [B.Rule("semantic", "contains", "b", "merge"), B.Rule("odd", "x", 1, "y"), B.Rule("size", "line_count", 3, "split", 9, False)])
    assert grouped.count() == 3


def test_running_averages_do_not_depend_on_ranges(spark):
    rnd = random.Random(3)
    rows = [(i * 3, f"s{i % 2}", rnd.random(), None if i % 5 == 0 else rnd.random()) for i in range(60)]
    frame = spark.createDataFrame(rows, "run_id long, strategy string, duration double, quality double")
    got = [sorted(map(str, chunks.run_stats(frame, size).collect())) for size in (1, 7, 1000)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 60
    want = {}
    for s in ("s0", "s1"):
        own = [r for r in rows if r[1] == s]
        for k, total in enumerate(itertools.accumulate(r[2] for r in own), 1):
            want[own[k - 1][0]] = round(total / k, 6)
    assert all(abs(want[r.run_id] - r.avg_duration) < 2e-6 for r in chunks.run_stats(frame, 7).collect())


def test_patterns_are_looked_for_where_their_marks_stand(spark):
    lines = {
        "def f(x)": "python", "class C(D):": "python", "from a import b": "python", "f = (a) =>": "javascript", "f = function": "javascript", "require ('x')": "javascript", "func (r T) f(": "go", "type T struct": "go",
        "f = () : T =>": "typescript", "public int f(": "java", "import static a.b;": "java", "static class C": "csharp", "using a.b;": "csharp", "async fn f(": "rust", "enum E": "rust", "trait T": "rust", "use a::b;": "rust",
    }
    for line, language in lines.items():
        found = B.language_boundaries(spark.createDataFrame([(1, f"plain\n{line}\nEnd"), (2, "plain")], "doc_id long, text string"), language)
        assert {(r.doc_id, r.start_line) for r in found.collect()} == {(1, 2)}, line
        assert "Contains" in found._jdf.queryExecution().optimizedPlan().toString()
