"""Leaked passages against brute force."""

import pytest

from maieutic.llm import leaks, shingles


def brute(docs, items, n):
    known = {}
    for i, *texts in items:
        for t in texts:
            w = shingles.words(t)
            for k in range(len(w) - n + 1):
                known.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = shingles.words(t)
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in known.get(tuple(w[k : k + n]), ())}
    return out


@pytest.mark.parametrize("limit", [60_000, 50])
def test_equals_brute_force(spark, rng, limit):
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(5, 40))), rng.choice([None, "", " ".join(word() for _ in range(30))])) for i in range(12)]
    items += [(50, items[0][1], None), (None, "x " * 20, None)]
    docs = []
    for d in range(150):
        w = [word() for _ in range(rng.choice([3, 12, 13, 60, 800]))]
        if d % 2:
            src = shingles.words(rng.choice([t for i in items[:12] for t in i[1:] if t]))
            n = rng.randrange(9, 16)
            at = rng.randrange(len(src))
            k = rng.randrange(len(w) + 1)
            w[k:k] = src[at : at + n]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w)))
    docs += [(500, None), (501, "  "), (502, docs[1][1]), (502, docs[1][1]), (None, docs[1][1])]
    kind = "item_id long, statement string, reference_hint string, doc_id string"
    got = leaks.leaks(
        spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id long, text string, passage string"),
        spark.createDataFrame([(*i, "c") for i in items], kind),
        passages_a_pass=limit,
    )
    assert got.columns == ["doc_id", "item_id", "n_passages"]
    rows = [(r.doc_id, r.item_id) for r in got.collect()]
    want = {(d, i) for d, i in brute(docs, items, 12) if d is not None and i is not None}
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 20


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    i = spark.createDataFrame([], "item_id long, topic string, statement string, reference_hint string")
    assert leaks.leaks(d, i).count() == 0 and leaks.leaks(d.limit(0), i).count() == 0 and leaks.leak_report(d, i).count() == 0


def test_bands_keep_the_promised_miss():
    for q in (8, 20):
        for u in range(q, q + 4):
            p = (q / u) ** leaks.BAND_ROWS
            assert (1 - p) ** leaks.bands_for(q, u) <= leaks.MISS * 1.0001 or u == q
