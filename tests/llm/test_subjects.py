"""Subjects on a made corpus with known sentences."""

import glob
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from maieutic.llm import subjects as S

LEXICON = {
    "law": "jurors hearings verdicts statutes tribunal bail notaries appeals".split(),
    "sport": "rowers matches goals penalties stadium handicap coaches medals".split(),
    "software": "maintainers releases builds commits repository latency testers branches".split(),
}
FRAMES = ["In the table the {0} are grouped by {1} and the {2} appear with some rows.", "Each of the {0} holds a copy of the same {1} as the other {2}.", "Nobody checks whether the {0} were already seen by the {1} of the {2}."]
CODE = ["Print `total_sum` before and after the call to `run_it` and compare the two values.", "The loop in `run_it` returns too early, because the return sits inside the body."]


def made(rng, n=600):
    docs, truth = [], {}
    for i in range(n):
        counts = {}
        for s in rng.sample(list(LEXICON), rng.choice([0, 1, 1, 2])):
            counts[s] = rng.choice([1, 2, 3, 4])
        said = [rng.choice(FRAMES).format(*rng.sample(LEXICON[s], 3)) for s, c in counts.items() for _ in range(c)] + [rng.choice(CODE) for _ in range(rng.randrange(1, 4))]
        rng.shuffle(said)
        docs.append((i, " ".join(said)))
        truth[i] = {s for s, c in counts.items() if c >= 2} if counts else {"software"}
    return docs, truth


def test_subjects_of_a_made_corpus(spark, rng):
    docs, truth = made(rng)
    labels = [(i, rng.choice(sorted(truth[i])) if truth[i] else None) for i in range(0, 600, 8)] + [(8, "Law"), (9, "nonsense"), (10, None), (99999, "law")]
    listed = [(s, f"Texts set among {ws[0]} and their {ws[1]}.") for s, ws in LEXICON.items()] + [(None, "x")]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs] + [(1000, None, ""), (1001, "  \n", ""), (None, "a", ""), (1002, "```python\nx = 1\n```", "")], "doc_id long, text string, subject string")
    got = S.document_subjects(d, spark.createDataFrame(listed, "subject string, description string"), spark.createDataFrame([(*x, "a") for x in labels], "doc_id long, subject string, annotator string"))
    found = {}
    for r in got.collect():
        found.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(found.get(i, set()) == truth[i] for i in truth)
    assert right >= 0.97 * len(truth)
    assert 1000 not in found and 1001 not in found and found[1002] == {"software"}
    mixture = {r.subject: r.share for r in S.corpus_mixture(got).collect()}
    assert sum(mixture.values()) == pytest.approx(1.0, abs=1e-5)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    s = spark.createDataFrame([("law", "Texts set among jurors.")], "subject string, description string")
    lab = spark.createDataFrame([], "doc_id long, subject string")
    assert S.document_subjects(d, s, lab).count() == 0
    one = spark.createDataFrame([(1, "One sentence only.")], "doc_id long, text string")
    assert S.document_subjects(one, s, lab).count() == 0
    assert S.document_subjects(one, s.limit(0), lab).count() == 0


def coded_of(spark, rows):
    return S.encode_texts(spark.createDataFrame(rows, "id long, text string"), F.col("id"), F.col("text")).cache()


def test_updates_keep_mass_and_lower_the_divergence(spark, rng):
    docs, _ = made(rng, 60)
    coded = coded_of(spark, docs)
    terms = S.known_terms(coded, {}, least=1)
    matrix = S.term_matrix(coded, terms, {}).cache()
    h = terms.normed(np.random.default_rng(1).random((3, len(terms.keys))))
    one, _ = S.gathered(matrix, terms, terms.normed(np.ones((1, len(terms.keys)))), 0)
    seen = []
    for _ in range(4):
        total, d = S.gathered(matrix, terms, h, 3)
        assert total.sum(axis=0) == pytest.approx(one[0], rel=1e-4, abs=1e-4)
        h = terms.normed(total)
        seen.append(d)
    assert seen == sorted(seen, reverse=True)


def test_only_the_keys_of_known_terms_are_sent():
    keys = np.random.default_rng(2).integers(1, 1 << 63, 20_000).astype(np.uint64)
    numbers = S.Numbers(keys)
    sent = pickle.dumps(numbers)
    assert len(sent) < keys.nbytes + 1000
    asked = np.concatenate([keys, keys + np.uint64(1)])
    assert (pickle.loads(sent)(asked) == numbers(asked)).all() and (numbers(keys) >= 0).all()


def test_a_round_leaves_no_files(spark, rng):
    docs, _ = made(rng, 60)
    coded = coded_of(spark, docs)
    terms = S.known_terms(coded, {}, least=1)
    matrix = S.term_matrix(coded, terms, {}).repartition(3).cache()
    matrix.count()
    files = lambda: {f for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs() for f in glob.glob(f"{d}/**/shuffle_*", recursive=True)}
    paths = lambda: set(glob.glob(f"{spark.sparkContext._temp_dir}/*"))
    shuffled, sent = files(), paths()
    S.gathered(matrix, terms, terms.normed(np.ones((2, len(terms.keys)))), 1)
    assert files() <= shuffled and paths() <= sent


def term_numbers(terms, text):
    """The numbers of a text's words and of its pairs, -1 for unknown ones."""
    codes, _ = S.coded([text])
    tongue = S.tongues(codes)
    return terms.numbers(S.words_at(codes, tongue)[1]), terms.numbers(S.pairs_at(codes, tongue)[1])


def test_words_and_pairs_of_many_documents_are_terms(spark):
    texts = ["Tennis court games of the day."] * 10 + ["Court filings of the day."] * 20 + [f"Nothing but item x{i}q of the day." for i in range(70)]
    coded = coded_of(spark, list(enumerate(texts)))
    terms = S.known_terms(coded, {})
    for text, n in (("Tennis court games of the day.", 4), ("Court filings of the day.", 3)):
        words, pairs = term_numbers(terms, text)
        assert (words >= 0).all() and (pairs >= 0).all() and len(pairs) == n  # of the: no pair, as both are function words
    few = S.known_terms(coded, {}, most=(3, 2))
    assert len(few.keys) <= 5  # by rank, with the ends of sentences among the words


def test_rank_does_not_depend_on_size_and_labelled_terms_stay(spark):
    texts = ["The jurors met at the hearings."] * 6 + ["The rain fell on all roads."] * 400
    coded = coded_of(spark, list(enumerate(texts)))
    labelled = spark.createDataFrame([(i,) for i in range(6)], "id long")
    word = S.words_at(*(lambda c: (c, S.tongues(c)))(S.coded(["jurors the"])[0]))[1][:1]
    assert S.known_terms(coded, {}, None, (5, 5)).numbers(word)[0] < 0
    assert S.known_terms(coded, {}, labelled, (5, 5)).numbers(word)[0] >= 0


def test_encoding_of_signs_and_blanks():
    words = lambda t: S.encoded([t])[0].tolist()
    assert words("A “b”, c—d: e\u2019f.") == words("a b c d e’f.") and words("Straße.") == words("STRASSE.".replace("SS", "ß"))
    assert S.encoded([None, "", " \n", "x"])[1].tolist() == [0, 0, 0, 2]
    assert words("# head\n```\nx = 1\n```") == [8] and words("a. b.\n\n") == [*words("a.")[:1], 8, *words("b.")[:1], 8]
    assert words("x_1 `y` 12 don't") == [2, 2, 0, *words("don't")]
    codes, sizes = S.encoded(["one two.", "", "one two."])
    assert codes[: sizes[0]].tolist() == codes[sizes[0] :].tolist()


def test_sentences_in_another_language_keep_their_own_terms():
    codes, _ = S.coded(["La liste des écluses est dans la table. The list of the locks is in the table. Il faut la voir dans la liste."])
    assert [S.languages.NAMES[t] for t in S.tongues(codes)[S.is_end(codes)]] == ["fr", "en", "fr"]


def test_one_text_on_a_third_of_the_rows(spark, rng):
    docs, truth = made(rng)
    copied = "The jurors met at the hearings with new verdicts. The statutes bind the tribunal and the bail. The notaries read the appeals."
    d = spark.createDataFrame(docs + [(10_000 + i, copied) for i in range(300)], "doc_id long, text string")
    labels = [(i, rng.choice(sorted(truth[i]))) for i in range(0, 600, 8) if truth[i]]
    listed = [(s, f"Texts set among {ws[0]} and their {ws[1]}.") for s, ws in LEXICON.items()]
    got = S.document_subjects(d, spark.createDataFrame(listed, "subject string, description string"), spark.createDataFrame(labels, "doc_id long, subject string"))
    found = {}
    for r in got.collect():
        found.setdefault(r.doc_id, set()).add(r.subject)
    assert sum(found.get(i, set()) == truth[i] for i in truth) >= 0.97 * len(truth)
    assert all(found.get(10_000 + i) == {"law"} for i in range(300))
