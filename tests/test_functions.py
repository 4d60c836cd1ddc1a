"""Text, JSON and hint functions against plain Python, on edge cases."""

import json
import re

import pytest
from pyspark.sql import functions as F

from maieutic.functions import jsons, prompts, quality, text


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def many(spark, values, column, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", column(F.col("x")).alias("y"))
    return [r.y for r in rows.orderBy("i").collect()]


def sanitize(t):
    t = re.sub(r"(?is)<think>.*?</think>", "", (t or "").strip()).replace("<think>", "").replace("</think>", "")
    t = re.sub(r"\n{3,}", "\n\n", re.sub(r"(?s)```.*?```", "", t)).strip()
    ls = [x.strip() for x in t.splitlines() if x.strip()]
    if not ls:
        return text.DEFAULT_HINT
    out = "\n".join(ls[:4]).strip()
    return " ".join(out.split()[:120]) if len(out.split()) > 120 else out


HINTS = [None, "", "  ", "<think>a</think>b", "<think>open", "```x\n```", "a\n\n\n\nb", "1\n2\n3\n4\n5", "w " * 130, "a b", " x ", "<THINK>q</THINK> r", "a```b```c```d"]


def test_sanitized_hint(spark):
    assert many(spark, HINTS, text.sanitized_hint) == [sanitize(h) for h in HINTS]


def test_lines_and_counts(spark):
    values = [None, "", "\n", "a", "a\n", "a\n\n b \r\nc", " \n\t\n"]
    assert many(spark, values, text.filled_line_count) == [len([x for x in (v or "").splitlines() if x.strip()]) for v in values]


def test_combined_program(spark):
    c = lambda b, a: spark.createDataFrame([(b, a)], "b string, a array<string>").select(text.combined_program(F.col("b"), F.col("a")).alias("y")).first().y
    assert c("x = 1\n\n", ["assert x ", " ", "  assert y"]) == "x = 1\n\nassert x\nassert y"
    assert c(None, ["assert x"]) == "assert x"
    assert c("x", None) == "x"
    assert c(None, None) == ""


def test_split_asserts(spark):
    program = "def f():\n    assert x\n    return 1\nassert(f())\nassert f() == 1  \n"
    body, checks = (one(spark, program, lambda c, i=i: text.split_asserts(c)[i]) for i in (0, 1))
    assert body == "def f():\n    return 1\nassert(f())"
    assert checks == ["    assert x", "assert f() == 1"]
    assert one(spark, None, lambda c: text.split_asserts(c)[0]) == ""


def test_topic_key(spark):
    assert many(spark, ["dictionaries_and_sets", " Dictionaries  and\tSets ", None, ""], text.topic_key) == ["dictionaries and sets", "dictionaries and sets", None, ""]


def test_chat_texts(spark):
    kind = "array<struct<role string, content string>>"
    chats = [[("system", "s"), ("user", " u "), ("assistant", "a")], [("assistant", "only ")], [], None, [(None, "x")]]
    assert many(spark, chats, text.user_text, kind) == ["u", "only", "", "", "x"]
    assert many(spark, chats, text.completion_text, kind) == ["s", "only", "", "", "x"]
    assert many(spark, chats[:1], text.rendered_chat, kind) == ["SYSTEM: s\n\nUSER:  u \n\nASSISTANT: a"]
    assert many(spark, chats[4:], text.rendered_chat, kind) == ["USER: x"]


CORRUPT = {
    "fine": [],
    "hi \U0001f600": ["emoji"],
    "汉": ["cjk_script"],
    "a Привет": ["latin_cyrillic_mix"],
    "Привет": [],
    "a سلام": ["latin_arabic_mix"],
    "â€™": ["mojibake:â€™", "mojibake:â€"],
    "�": ["mojibake:�"],
    "Traceback: cannot encode": ["encoding_traceback"],
}


def test_corruption(spark):
    assert many(spark, list(CORRUPT), quality.corruption) == list(CORRUPT.values())
    assert one(spark, None, quality.corruption) == []


def quality_of(spark, hint, program="def total(items):\n    return sum_all(items)", failure="NameError: sum_all", checks=("assert total([1]) == 1",), target="total", status="failed"):
    row = spark.createDataFrame([(hint, program, failure, list(checks), target, status)], "h string, p string, f string, c array<string>, t string, s string")
    return row.select(F.col("h"), quality.hint_context(F.col("p"), F.col("f"), F.col("c"), F.col("t"), F.col("s")).alias("x")).select(quality.hint_quality(F.col("h"), F.col("x")).alias("q")).first().q


def test_hint_quality_rules(spark):
    q = quality_of(spark, "Look at `total`: why does NameError name sum_all?")
    assert q.delta == pytest.approx(0.45 + 0.35 + 0.14 + min(0.55, 0.12 * 2)) and not q.severe and q.reasons == []
    q = quality_of(spark, "Call `made_up()` and `")
    assert q.severe and q.reasons == ["unbalanced_backticks", "hallucinated_identifiers"] and q.foreign == ["made_up"]
    q = quality_of(spark, "What do you expect here?")
    assert q.reasons == ["generic_hint"] and q.delta == pytest.approx(-0.25)
    q = quality_of(spark, "Where is the fault?", status="passed")
    assert q.severe and q.reasons == ["missed_passed_execution"] and q.delta == pytest.approx(-3.0)
    q = quality_of(spark, "The code already passes, does it not?", status="passed")
    assert not q.severe and q.delta == pytest.approx(0.35)
    q = quality_of(spark, "Which colon is missing?", failure="SyntaxError: invalid syntax")
    assert q.reasons == [] and q.delta == pytest.approx(0.45)
    q = quality_of(spark, "Which value is odd?", failure="SyntaxError: invalid syntax")
    assert q.reasons == ["missed_compile_failure"] and q.delta == pytest.approx(-2.4)
    assert quality_of(spark, None).delta == 0.0


def test_prompt_context_reads_what_tutor_text_writes(spark):
    row = spark.createDataFrame([("s", "def area(r): pass", "ValueError: r")], "a string, b string, c string")
    c = row.select(quality.prompt_context(prompts.tutor_text(F.col("a"), F.col("b"), F.col("c"))).alias("c")).first().c
    assert c.error_name == "ValueError" and "area" in c.allowed and "Instruction" not in c.allowed and c.status == "failed"


def test_prompts_without_values(spark):
    n = F.lit(None).cast("string")
    row = spark.range(1).select(prompts.spec_text(n, n).alias("a"), prompts.repair_text("task", n, F.lit(None).cast("array<string>"), n).alias("b"), prompts.training_text(n, F.lit(""), n).alias("c")).first()
    assert "any weakness" in row.a and "unspecified issue" in row.b and "general weakness probing" in row.c and "Plan" not in row.c


JSONS = ['{"a":1}', '```json\n{"a": [1]}\n```', 'so: {"a":1} ok', '[{"a":1}]', '{"a":1} then [2]', "[1] then {", "nothing", "", None, '{"a": NaN}', "{'a': 1}", '{"a":1} x']


def test_salvage_orders(spark):
    load = lambda xs: [None if x is None else json.loads(x) for x in xs]
    o, a = load(many(spark, JSONS, jsons.object_first)), load(many(spark, JSONS, jsons.array_first))
    assert o[:6] == [{"a": 1}, {"a": [1]}, {"a": 1}, [{"a": 1}], {"a": 1}, [1]]
    assert a[:2] == [{"a": 1}, [1]] and a[3:6] == [[{"a": 1}], [2], [1]]
    assert o[6:9] == [None] * 3 and str(o[9]["a"]) == "nan" and o[10] is None and o[11] == {"a": 1}


def test_parsed_spec_and_task(spark):
    spec = lambda p: spark.createDataFrame([(p, "T")], "p string, t string").select(*(c.alias(n) for c, n in zip(jsons.parsed_spec(F.col("p"), F.col("t")), "sr"))).first()
    full = spec('{"target_function": "f", "intended_bug": " b ", "expected_first_failure": "e"}')
    assert full.s.topic == "T" and full.s.intended_bug == "b" and full.r == []
    assert spec('{"topic": "x"}').r == ["missing target_function", "missing intended_bug", "missing expected_first_failure"]
    assert spec("[1]").r == ["non-json response"] and spec(None).r == ["non-json response"]
    task = lambda p: spark.createDataFrame([(p, "T")], "p string, t string").select(*(c.alias(n) for c, n in zip(jsons.parsed_task(F.col("p"), F.col("t")), "tr"))).first()
    t = task('{"buggy_solution": "x = 1\\nassert x == 2", "metadata": {"failure_mode": "m"}}').t
    assert (t.buggy_solution, t.failing_asserts, t.statement, t.failure_mode, t.observed_failure) == ("x = 1", ["assert x == 2"], "Debug this Python task about T.", "m", "AssertionError")
    assert task('{"buggy_solution": "x", "asserts": "assert y"}').t.failing_asserts == ["assert y"]
    assert task('{"buggy_solution": "x", "failing_asserts": [" a ", ""]}').t.failing_asserts == ["a"]
    assert task('{"statement": "s"}').r == ["missing buggy_solution"] and task("nope").r == ["non-json response"]


def test_judge_items(spark):
    values = ['[{"a":1}, 2]', '{"items": [1, 2]}', '{"items": [], "scores": [3, 4]}', '{"results": [5, 6]}', "[1]", '{"x": 1}', None]
    got = many(spark, values, lambda c: jsons.judge_items(c, 2))
    assert got == [['{"a":1}', "2"], ["1", "2"], ["3", "4"], ["5", "6"]] + [["0.0", "0.0"]] * 3


def test_spec_of_metadata(spark):
    values = ['{"red_spec": {"intended_bug": "b"}}', '{"red_spec": {}}', "{}", None]
    got = many(spark, values, lambda c: jsons.spec_of_metadata(c, F.lit("T")))
    assert got[0].topic == "T" and got[0].intended_bug == "b" and got[1:] == [None] * 3
