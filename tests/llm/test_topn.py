"""Top N against sorting, with ties, nulls and hot groups."""

from pyspark.sql import functions as F

from maieutic.llm.topn import top_examples, top_n_per_group, topic_key


def test_against_sorting(spark, rng):
    rows = [(rng.choice(["hot"] * 6 + list("abcdef")), rng.choice([0.1, 0.5, 0.5, 1.0, None, float("nan")]), rng.choice([1, 2, None]), f"x{i:04d}") for i in range(2000)] + [(None, 1.0, 1, "y")]
    df = spark.createDataFrame(rows, "g string, s double, t long, i string").repartition(5)
    got = top_n_per_group(df, F.col("g"), F.col("s"), [F.col("t"), F.col("i")], 4, ["g", "t", "i"]).collect()
    want = {}
    for g in {r[0] for r in rows} - {None}:
        ok = [r for r in rows if r[0] == g and r[1] is not None and r[1] == r[1]]
        want[g] = [r[3] for r in sorted(ok, key=lambda r: (-r[1], r[2] is None, r[2] or 0, r[3]))[:4]]
    assert {g: [r.i for r in sorted((r for r in got if r.g == g), key=lambda r: r.rank)] for g in want} == want


def test_small_and_empty_groups(spark):
    df = spark.createDataFrame([("a", 1.0, "x")], "g string, s double, i string")
    assert top_n_per_group(df, F.col("g"), F.col("s"), [F.col("i")], 3, ["g", "i"]).count() == 1
    assert top_n_per_group(df.limit(0), F.col("g"), F.col("s"), [F.col("i")], 3, ["g", "i"]).count() == 0


def test_examples_are_records(spark):
    kind = "example_id string, topic string, reward double, metadata struct<episode_id long>, rank string, score string"
    rows = [("a", "Loop_Bounds", 1.0, (2,), "", ""), ("a", "Loop_Bounds", 1.0, (2,), "", ""), ("b", " loop  bounds ", 1.0, (1,), "", ""), ("c", "LOOP BOUNDS", 1.0, (2,), "", ""), ("d", "loop bounds", 1.0, (3,), "", ""), ("e", None, 1.0, (1,), "", ""), ("f", "x", None, (1,), "", ""), (None, "x", 1.0, (1,), "", "")]
    got = top_examples(spark.createDataFrame(rows, kind)).orderBy("rank").collect()
    assert [(r.topic_key, r.example_id) for r in got] == [("loop bounds", "b"), ("loop bounds", "a"), ("loop bounds", "c")]


def test_topic_key(spark):
    assert spark.createDataFrame([(" A__b\tC ",)], "x string").select(topic_key(F.col("x")).alias("y")).first().y == "a b c"
