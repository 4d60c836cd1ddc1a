"""Defective pairs, one by one."""

import pytest
from pyspark.sql import functions as F

from maieutic.llm.languages import languages_differ, main_language, profile
from maieutic.llm.pairs import common_subsequence, copied_share, defect, defective_pairs
from maieutic.llm.shingles import words

Q = "Write `count_items`, which takes the recipes of Holby and returns the shelf life for each of the bakers. An empty input gives an empty result, also for Selwick."
HINT = "How often is `seen` created while `count_items` runs twice? Write down what you expect before you run it again."
TASK = '{"topic": "T", "statement": "Write a function that counts the recipes of the bakers.", "buggy_solution": "def f(x):\\n    return x[", "metadata": {"difficulty": "hard"}}'

CASES = [
    (Q, None, "empty"),
    (Q, " \n\t", "empty"),
    (Q, "...", "empty"),
    (Q, "```python\n```", "empty"),
    (Q, "```json\n{}\n```", "empty"),
    (Q, "null", "empty"),
    (Q, '{"statement": "", "x": null}', "empty"),
    (Q, "\u200b", "empty"),
    (Q, HINT, None),
    (Q, HINT.removesuffix(" Write down what you expect before you run it again.") + " Keywords: loop, copy", None),
    (Q, HINT[:70], "truncated"),
    (Q, "Follow one value through `count_items` on paper. Does `seen` ev-", "truncated"),
    (Q, TASK, None),
    (Q, TASK[:120], "truncated"),
    (Q, "```json\n" + TASK + "\n```", None),
    (Q, "Here is the task.\n" + TASK, None),
    (Q, "I cannot help with that request. Thank you for understanding.", "refusal"),
    (Q, '{"error": "This assistant is unable to complete the task."}', "refusal"),
    (Q, '{"topic": "T", "statement": "We will not write this exercise.", "buggy_solution": ""}', "refusal"),
    (Q, "Dabei kann ich leider nicht helfen.", "refusal"),
    (Q, "No puedo ayudar con esta petición.", "refusal"),
    (Q, "Je ne peux pas répondre à cette demande.", "refusal"),
    (Q, "I can't tell you the line, yet the traceback can: which name in `count_items` does it mention?", None),
    (Q, "I won't spell out the fix, but ask yourself why `seen` is still unchanged after `count_items` returns.", None),
    (Q, Q, "copied"),
    (Q, Q.upper(), "copied"),
    (Q, "The task says: " + Q.replace("returns", "gives back"), "copied"),
    (Q, '{"topic": "T", "statement": "%s", "buggy_solution": null}' % Q, "copied"),
    (Q, f'"{Q.split(". ")[0]}." {HINT}', None),
    (Q, "Wie oft wird `seen` angelegt, wenn `count_items` zweimal aufgerufen wird? Das soll nicht für die Liste sein.", "other_language"),
    (Q, "Hint: Combien de fois `seen` est-elle créée quand on appelle `count_items` deux fois de suite ?", "other_language"),
    (Q, '{"statement": "Escribe la función que lee las recetas de los panaderos y devuelve el valor para cada una.", "buggy_solution": "x = 1"}', "other_language"),
    (None, HINT, None),
    ("", Q, None),
]


@pytest.mark.parametrize("question,answer,want", CASES)
def test_defect(question, answer, want):
    assert defect(question, answer) == want


def test_common_subsequence_equals_the_table():
    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    for a, b in (("abcbdab", "bdcaba"), ("", "a"), ("aaaa", "aa"), ("xyz" * 40, "zyx" * 30)):
        assert common_subsequence(list(a), list(b)) == table(a, b)
    assert copied_share([], ["a"]) == (0.0, 0.0, 0.0) and copied_share(words(Q), words(Q)) == (1.0, 1.0, 1.0)


def test_language():
    of = lambda t: main_language(profile(t))
    assert of("the value of the list is not what you expect") == "en" and of("xx yy") is None
    assert of("Какое значение имеет список после первого шага") == "cyrillic" and of("リストの値はどこで変わりますか") == "kana"
    assert languages_differ(profile("the value of the list is not what you expect"), profile("Hoe vaak wordt de lijst gemaakt en wat is er dan nog niet in te zien?"))
    assert not languages_differ(profile("el valor de la lista no es el que esperas"), profile("qué valor tiene la lista cuando el bucle termina"))


LONG = " ".join(["The service keeps to rules that others have set, and staff may explain them in person on any weekday."] * 12)


@pytest.mark.parametrize(
    "answer,want",
    [
        ("Thank you for writing. The team values every message. I cannot help with that request.", "refusal"),
        ("I cannot help with that request. " + LONG, "refusal"),
        ("I'd rather not answer this. Is there anything else you would like to talk about?", "refusal"),
        ("I cannot give the solution, but look at the first value again.", None),
        ("I cannot give the solution. What is the first value?", None),
        ("I will not solve it. The recipes of the bakers of Holby and the shelf life belong together.", None),
        ("Hoe vaak wordt de lijst gemaakt en wat is er dan nog niet in te zien? Dat moet je met de hand nagaan voor je het opnieuw probeert.", "other_language"),
    ],
)
def test_refusals_anywhere_and_other_languages(answer, want):
    assert defect(Q, answer) == want


def test_operator(spark):
    rows = [("e", 1, Q, None, 0), ("e", 1, Q, None, 0), ("h", 2, Q, HINT, 0), ("h", 3, None, None, 0), ("h", None, Q, HINT[:70] * 3000, 0)]
    df = spark.createDataFrame(rows, "s string, i long, q string, a string, defect long")
    got = defective_pairs(df, {"s": F.col("s"), "i": F.col("i")}, F.col("q"), F.col("a"))
    assert got.columns == ["s", "i", "defect"]
    assert sorted((r.s, r.i or 0, r.defect) for r in got.collect()) == [("e", 1, "empty"), ("e", 1, "empty"), ("h", 0, "truncated"), ("h", 3, "empty")]
    assert defective_pairs(df.limit(0), {"s": F.col("s")}, F.col("q"), F.col("a")).count() == 0


@pytest.mark.parametrize("answer", ["```json\n" + TASK, TASK + "\nThe program fails for the second baker, because"[:-8] + ",", TASK + "\n```python\nx = 1"])
def test_cut_behind_a_complete_json_value(answer):
    assert defect(Q, answer) == "truncated"
