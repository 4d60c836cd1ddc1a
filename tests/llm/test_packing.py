"""Packing: nothing lost, nothing over, little room; buckets against trying all."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from maieutic.llm import packing
from maieutic.llm.packing import best_fit, fill_containers, in_buckets, optimal_buckets


def loads(slots, n):
    room = Counter()
    for s in slots:
        for i in range(s.begin, s.end):
            c = s.first + (i - s.begin + s.shift) // s.each
            assert 0 <= c < n
            room[c] += s.length
    return room


@pytest.mark.parametrize("seed", range(6))
def test_slots_hold_all_items(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 256])
    histogram = Counter(rng.randrange(1, capacity + 1) for _ in range(rng.choice([1, 50, 3000])))
    for pack in (best_fit, in_buckets):
        slots, n, rooms = pack(dict(histogram), capacity)
        got = Counter()
        for s in slots:
            got[s.length] += s.end - s.begin
        assert got == histogram
        room = loads(slots, n)
        assert max(room.values()) <= capacity and len(room) == n
        assert sum(room.values()) == sum(k * v for k, v in histogram.items())
        if pack is best_fit:
            left = {c: r.room for r in rooms for c in range(r.first, r.last)}
            assert left == {c: capacity - x for c, x in room.items() if x < capacity}


def test_best_fit_is_near_the_bound():
    rng = random.Random(3)
    histogram = Counter(min(1000, int(rng.gauss(300, 90)) if rng.random() < 0.9 else rng.randrange(1, 60)) for _ in range(20_000))
    histogram = Counter({max(1, k): v for k, v in histogram.items()})
    _, n, _ = best_fit(dict(histogram), 1024)
    assert n <= 1.02 * sum(k * v for k, v in histogram.items()) / 1024
    assert best_fit({}, 10) == ([], 0, [])


def test_buckets_are_optimal():
    rng = random.Random(4)
    for _ in range(20):
        h = {rng.randrange(1, 60): rng.randrange(1, 9) for _ in range(rng.randrange(1, 9))}
        lengths = sorted(h)
        k = rng.randrange(1, 5)
        got = optimal_buckets(h, k)
        padded = lambda bounds: sum(h[x] * (next(b for a, b in bounds if a <= x <= b) - x) for x in lengths)
        best = min(padded([(c[0], c[-1]) for c in split]) for split in splits(lengths, k))
        assert padded(got) == best and len(got) <= k
    assert optimal_buckets({}, 3) == []


def splits(xs, k):
    for n in range(1, min(k, len(xs)) + 1):
        for cut in itertools.combinations(range(1, len(xs)), n - 1):
            at = [0, *cut, len(xs)]
            yield [xs[a:b] for a, b in zip(at, at[1:])]


@pytest.mark.parametrize("method", ["best_fit", "in_buckets"])
def test_containers(spark, rng, method):
    counts = [(i, rng.choice([7, 7, 7, rng.randrange(1, 200)])) for i in range(500)] + [(1000, 0), (1001, 64), (1002, 128), (1003, 65)]
    df = spark.createDataFrame(counts, "id long, n_tokens long")
    got = fill_containers(df, {"a": 64, "b": 30}, method, salts=3).collect()
    for kind, capacity in (("a", 64), ("b", 30)):
        rows = [r for r in got if r.container_kind == kind]
        load, pieces = Counter(), {}
        for r in rows:
            load[r.container_id] += r.n_tokens
            pieces.setdefault(r.doc_id, []).append(r)
        assert max(load.values()) <= capacity
        for i, n in counts:
            mine = sorted(pieces.get(i, []), key=lambda r: r.piece_no)
            assert sum(r.n_tokens for r in mine) == n
            assert [r.first_token for r in mine] == [sum(x.n_tokens for x in mine[:k]) for k in range(len(mine))]
            assert len(mine) == (1 if 0 < n <= capacity else len(mine))
        if method == "best_fit":
            assert len(load) <= sum(n for _, n in counts) / capacity * 1.1 + 1


def test_pour():
    p = packing.Pour([packing.Rooms(30, 4, 6), packing.Rooms(20, 1, 2), packing.Rooms(3, 0, 1)], 6, 100, 16)
    assert p.pieces(0, 250) == [(0, 30, 4), (30, 30, 5), (60, 20, 1), (80, 100, 6), (180, 70, 7)]
    assert p.pieces(250, 40) == [(0, 30, 7), (30, 10, 8)] and p.pieces(59, 2) == [(0, 1, 5), (1, 1, 1)]


def test_no_containers_and_no_texts(spark):
    df = spark.createDataFrame([], "id long, n_tokens long")
    assert fill_containers(df, {"a": 5}).count() == 0 and fill_containers(df, {}).count() == 0
    with pytest.raises(ValueError):
        fill_containers(df, {"a": 0})


def test_token_counts_and_parts(spark):
    long = "word and other words " * 20_000
    assert "".join(packing.parts_of(long)) == long and len(list(packing.parts_of(long))) > 3
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, long), (5, "x" * 250_000), (6, " ")], "doc_id long, text string")
    got = {r.id: r.n_tokens for r in packing.token_counts(df, F.col("doc_id"), F.col("text")).collect()}
    assert got[1] == 2 and got[2] == 0 and 3 not in got and got[6] == 1 and got[4] == 80_001 and got[5] > 0
