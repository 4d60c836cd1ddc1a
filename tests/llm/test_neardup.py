"""Near-duplicates against brute force; sketches against their promises."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from maieutic.llm import shingles
from maieutic.llm.neardup import NearDuplicates, components, pairs_within, similar_tasks


def jaccard(a, b, k):
    runs = lambda t: set(zip(*(shingles.words(t)[i:] for i in range(k))))
    x, y = runs(a), runs(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        i = rng.randrange(len(w))
        rng.choice([lambda: w.pop(i), lambda: w.insert(i, f"new{i}"), lambda: w.__setitem__(i, f"other{i}")])()
    return " ".join(w)


def test_sketch_estimates_and_fills(rng):
    for size in (1, 3, 200, 2000):
        base = [str(rng.random()) for _ in range(size)]
        half = base[: size // 2] + [str(rng.random()) for _ in range(size - size // 2)]
        h = [np.unique(np.array([shingles.xxhash.xxh3_64_intdigest(x) for x in s], dtype=np.uint64)) for s in (base, half)]
        owner = np.repeat([0, 1], [len(h[0]), len(h[1])])
        s = shingles.fast_similarity_sketch(owner, np.concatenate(h), 3, 256)
        empty = shingles.mix(np.array([shingles.EMPTY]))[0]
        assert (s[:2] != empty).all() and (s[2] == empty).all()
        assert (s[0] == s[1]).mean() == pytest.approx(len(set(base) & set(half)) / len(set(base) | set(half)), abs=0.12)


def test_pairs_equal_brute_force(spark, rng):
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(20, 120))) for _ in range(40)]
    texts = base + [edited(rng, rng.choice(base), rng.randrange(0, 12)) for _ in range(80)] + ["", None, "two words", base[0], base[0].upper()]
    df = spark.createDataFrame([(f"t{i:03d}", t, "x") for i, t in enumerate(texts)], "id string, text string, a string")
    got = {(r.a, r.b) for r in NearDuplicates(df, F.col("id"), F.col("text"), 0.5, 3).pairs().collect()}
    want = {(f"t{i:03d}", f"t{j:03d}") for i, j in itertools.combinations(range(len(texts)), 2) if jaccard(texts[i], texts[j], 3) >= 0.5}
    sure = {(f"t{i:03d}", f"t{j:03d}") for i, j in itertools.combinations(range(len(texts)), 2) if jaccard(texts[i], texts[j], 3) >= 0.6}
    assert got <= want and sure <= got and len(want - got) <= 1


def test_classes_hot_group_repeated_rows_and_clashing_columns(spark, rng, say):
    hot = say(60)
    rows = [(i, hot) for i in range(50)] + [(i, hot) for i in range(5)] + [(100, hot + " more words here"), (200, say(80)), (None, hot), (300, None)]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "key long, body string, set_hash string, bands string")
    nd = NearDuplicates(df, F.col("key"), F.col("body"), 0.8, 5)
    got = {r.id: r for r in nd.classes().collect()}
    assert set(got) == {*range(50), 100, 200}
    assert len({got[i].class_id for i in [*range(50), 100]}) == 1 and got[200].class_id != got[0].class_id
    assert got[0].copies == 49 and got[0].links == 1 and got[200].links == 0


def test_empty_table(spark):
    nd = NearDuplicates(spark.createDataFrame([], "id string, text string"), F.col("id"), F.col("text"))
    assert nd.pairs().count() == 0 and nd.classes().count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (200, 202), (201, 202), (7, 3), (5, 5)]
    got = {r.set_hash: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and got[101] == 100 and got[201] == got[202] == 200 and got[200] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tasks_with_nulls(spark):
    kind = "task struct<task_id string, statement string, buggy_solution string>"
    df = spark.createDataFrame([(("a", "one two three four five six", None),), (("b", None, "one two three four five six"),), (("c", None, None),), (None,)], kind)
    assert [tuple(r)[:2] for r in similar_tasks(df).pairs().collect()] == [("a", "b")]


def test_values_of_a_hot_key_are_paired_in_blocks(spark):
    rows = [("hot", v) for v in range(300)] * 2 + [("warm", v) for v in range(0, 40, 2)] + [("cold", 7), (None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "key string, set_hash long").repartition(7)
    got = [tuple(r) for r in pairs_within(df.where("key is not null"), "key", "set_hash", 50).collect()]
    want = list(itertools.combinations(range(300), 2)) + list(itertools.combinations(range(0, 40, 2), 2))
    assert sorted(got) == sorted(want)
    assert pairs_within(df.limit(0), "key", "set_hash").count() == 0


def test_many_near_copies_in_many_partitions(spark, rng, say):
    base = say(80)
    texts = [base + f" tail{i} of copy" for i in range(150)]
    df = spark.createDataFrame([(i * 10 + j, t) for i, t in enumerate(texts) for j in range(3)], "id long, text string").repartition(12)
    got = NearDuplicates(df, F.col("id"), F.col("text"), 0.8, 5)
    assert got.links.count() == 150 * 149 // 2 and got.pairs().count() == 450 * 449 // 2
    assert {r.class_id for r in got.classes().select("class_id").distinct().collect()}.__len__() == 1


def test_an_id_with_two_texts_counts_with_each(spark, say):
    a, b = say(60), say(60)
    df = spark.createDataFrame([(1, a), (1, b), (2, a + " end"), (3, b + " end")], "id long, text string")
    assert {(r.a, r.b) for r in NearDuplicates(df, F.col("id"), F.col("text"), 0.8, 5).pairs().collect()} == {(1, 2), (1, 3)}
