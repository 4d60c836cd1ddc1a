"""Endings, one by one; hazards and rates on made tables."""

import json

import pytest
from pyspark.sql import functions as F

from maieutic.llm.endings import BLANK, COMPLETE, CUT, DOUBT, ending
from maieutic.llm.truncation import cut_rates, cut_texts, length_hazards, read_endings

J = json.dumps({"topic": "a", "code": "def f():\n    return {1}", "n": [1, 2]})
CASES = [
    (None, BLANK), ("", BLANK), (" \n", BLANK), ("...", BLANK),
    ("All is well.", COMPLETE), ("Is it?", COMPLETE), ("He said \"no.\"", COMPLETE), ("See (the call).", COMPLETE), ("See it. (Start with the call.)", COMPLETE),
    ("All is we", CUT), ("All is well,", CUT), ("All is…", CUT), ("what do-", CUT), ("What is `a_b", CUT), ("See it. (Start with the ca", CUT), ('"All is well. And', CUT), ("It is �", CUT),
    ("It is well.\nEND", COMPLETE), ("It is well.\nDifficulty: medium", COMPLETE), ("It is well.\n-- Holby", DOUBT), ("It is well.\nTotal 29.9", DOUBT), ("It is well.\nTotal 29.", CUT),
    ("It is well. Keywords: loop, copy", COMPLETE), ("It is well.\n2. The", CUT), ("It is well.\n2.", CUT), ("It is well.\nRaise when the value falls below 23.", COMPLETE),
    ("<think>Hm.", CUT), ("<think>Hm.</think>\nIt is.", COMPLETE), ("<think>Hm.</thi", CUT), ("<think>Hm.</think>\nWhat", CUT), ("It is well.\nDiffic", CUT), ("<think>Hm.</think>", COMPLETE),
    ("It is:\n\n```python\nx = 1\n```", COMPLETE), ("It is:\n\n```python\nx = 1", CUT),
    (J, COMPLETE), (J[:-1], CUT), (J[:20], CUT), ("```json\n" + J + "\n```", COMPLETE), ("```json\n" + J, CUT), ("Here it is.\n" + J, COMPLETE), (J + "\n\nTell me whether it suits Holby", DOUBT), (J + "\n\nTell me.", COMPLETE), ("[1, 2]", COMPLETE), ("[1, 2", CUT), ("{'a': 1}", COMPLETE),
]


@pytest.mark.parametrize("text,want", CASES)
def test_ending(text, want):
    assert ending(text)[0] == want


def made(spark, rng, n=1200):
    rows = []
    for i in range(n):
        whole = " ".join(["word"] * rng.randrange(20, 70)) + f" number {rng.randrange(10**6)} ends.\n-- Holby"
        source = rng.choice(["cut", "sound", "sound", None])
        rows.append((i, "f", source, whole[:200] if source == "cut" else whole))
    return spark.createDataFrame(rows, "id long, field string, source string, text string")


def test_limits_are_found_and_used(spark, rng):
    df = made(spark, rng)
    e = read_endings(df, {k: F.col(k) for k in ("field", "source", "id")}, F.col("text")).cache()
    h = length_hazards(e, ["field", "source"])
    found = {(r.source, r.unit, r.length) for r in h.where("significant").collect()}
    assert ("cut", "chars", 200) in found and {f[0] for f in found} == {"cut"}
    got = cut_texts(e, "field", "source")
    texts = {r.id: r for r in df.collect()}
    for r in got.collect():
        if r.source == "cut":
            text = texts[r.id].text
            if len(text) < 200 or text.rstrip().endswith("ends."):
                assert not r.is_cut
            elif not text.rstrip().endswith(("-", "--")):
                assert r.is_cut
            assert r.at_limit == (len(texts[r.id].text) == 200)
        else:
            assert not r.is_cut and not r.at_limit
    rates = {r.source: r for r in cut_rates(got.select(F.lit("f").alias("field_name"), "source", F.col("id").alias("episode_id"), "verdict", "is_cut", "at_limit")).collect()}
    assert rates["unknown"].n_cut == rates["sound"].n_cut == 0 and rates["cut"].cut_rate > 0.3


def test_part_of_a_usual_last_line(spark):
    rows = [(i, "f", "s", f"Text {i} is fine.\nDifficulty: medium") for i in range(60)] + [(90, "f", "s", "Text is fine.\nDifficulty: med"), (91, "f", "s", "Text is fine.\nDifficulty: odd")]
    df = spark.createDataFrame(rows, "id long, field string, source string, text string")
    got = cut_texts(read_endings(df, {k: F.col(k) for k in ("field", "source", "id")}, F.col("text")), "field", "source")
    assert [(r.id, r.evidence) for r in got.where("is_cut").collect()] == [(90, "part")]


def test_empty_and_null(spark):
    df = spark.createDataFrame([], "id long, field string, source string, text string")
    keys = {k: F.col(k) for k in ("field", "source", "id")}
    assert cut_texts(read_endings(df, keys, F.col("text")), "field", "source").count() == 0
    one = spark.createDataFrame([(1, "f", None, None), (2, "f", None, "x" * 300_000)], df.schema)
    assert [(r.id, r.is_cut) for r in cut_texts(read_endings(one, keys, F.col("text")), "field", "source").collect()] == [(2, True)]
