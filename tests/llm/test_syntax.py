"""Grammars on sound and broken programs of each language."""

import pytest
from pyspark.sql import functions as F

from maieutic.llm.grammars import GRAMMARS, classify, rank_languages
from maieutic.llm.syntax import parse_files

SOUND = {
    "python": "def f(a, b=[]):\n    match a:\n        case []:\n            return b\n    return sorted(b)\n",
    "python2": "def f(a):\n    print \"x\", a\n    try:\n        g()\n    except ValueError, e:\n        raise KeyError, 'k'\n",
    "json": '{"a": [1, 2, {"b": null}]}',
    "jsonc": '{\n  // note\n  "a": "x // y",\n  "b": [1, 2,],\n}',
    "javascript": "import x from 'y';\nconst f = async (a, {b, ...c}) => { for (const [k, v] of a) { if (k === v && !b) return `t${k}`; else throw new Error('x') } };\nclass A extends B { static x = 1; get y() { return this.#z ?? a?.b } }\nlet o = {a, 'b': 2, [c]: 3, d() { return 1 }, ...e}\nfunction* g() {}\nswitch (a) { case 1: break; default: f() }\n",
    "java": "package a.b;\nimport java.util.*;\npublic class A<T> extends B implements C {\n  private final Map<String, List<T>> m = new HashMap<>();\n  static int[] x = {1, 2};\n  public A(int n) { this.n = n; }\n  @Override public int f(int[] a) throws E { int s = 0; for (int i = 0; i < a.length; i++) { s += a[i] / 2; } for (String t : names) s++; return s > 1 ? s : -s; }\n  enum K { X, Y(2); }\n}\n",
    "sql": "CREATE TABLE t (a INTEGER, b DECIMAL(10, 2));\nINSERT INTO t VALUES (1, 'x'), (2, 'it''s');\nSELECT b, SUM(a) AS s FROM t LEFT JOIN u ON t.a = u.a WHERE a > 1 AND b IN ('x', 'y') GROUP BY b HAVING COUNT(*) > 1 ORDER BY s DESC LIMIT 5;",
    "shell": "#!/bin/sh\n# note\nf() {\n  for x in \"$@\"; do\n    if [ \"$x\" -gt 1 ]; then\n      y=$(( ${y} + 1 ))\n    else\n      echo 'a b' | sort > out.txt\n    fi\n  done\n  case $x in a|b) echo 1;; *) echo 2;; esac\n}\nf 1 2 && echo done || exit 1\n",
    "toml": "[a]\nb = 1\nc = [\"x\"]\n",
    "xml": "<a b='c'><d/></a>",
}


@pytest.mark.parametrize("language", SOUND)
def test_grammar_accepts_and_rejects(language):
    text = SOUND[language]
    assert GRAMMARS[language](text) is None
    broken = {"python2": "print \"x\", (a\n", "toml": text + "=", "sql": text.replace("VALUES (1,", "VALUES (1"), "shell": text.replace("fi\n", "\n", 1)}.get(language, text.rstrip()[:-1])
    if language != "python":
        assert GRAMMARS[language](broken) is not None


@pytest.mark.parametrize("language", [x for x in SOUND if x not in ("python", "json", "toml")])  # the last two are Python as well
def test_foreign_language_is_named(language):
    parses, foreign, damage, reason = classify(SOUND[language])
    assert (parses, foreign, damage) == (False, language, None) and reason


def test_damage_is_named():
    good = SOUND["python"]
    for text, want in (("<<<<<<< a\nx = 1\n=======\nx = 2\n>>>>>>> b\n", "merge_conflict"), ("```python\n" + good + "```", "markdown_fence"), (good.replace("\n", "\\n"), "escaped"), ("f(\n", "unclosed"), ("if x:\ny\n", "indentation"), ("x = ’a’\n", "typographic_quotes"), ("+def f():\n     pass\n+x = 1\n", "diff"), ("x y\n", "syntax")):
        assert classify(text)[:3] == (False, None, want), text
    assert set(rank_languages(good)) == set(GRAMMARS) and rank_languages(good)[0] == "python"


def test_deep_and_strange_texts():
    for text in ("(" * 5000, "[" * 100_000, "x = '\x00'", "\ufeffx = 1", "a" * 500_000, "\\"):
        classify(text)


def test_operator(spark):
    rows = [("a", SOUND["python"], 1), ("b", SOUND["java"], 2), ("c", None, 3), ("d", " \n", 4), ("b", SOUND["java"], 5), ("e", "def f(:\n", 6)]
    df = spark.createDataFrame(rows, "id string, src string, parses long")
    got = {(r.id, r.parses, r.foreign_language) for r in parse_files(df, {"id": F.col("id")}, F.col("src")).collect()}
    assert got == {("a", True, None), ("b", False, "java"), ("c", None, None), ("d", None, None), ("e", False, None)}
    bad = parse_files(df, {"id": F.col("id")}, F.col("src"), failures_only=True)
    assert sorted(r.id for r in bad.collect()) == ["b", "b", "e"]
    assert parse_files(df.limit(0), {"id": F.col("id")}, F.col("src")).count() == 0


def test_what_is_beyond_the_parser_is_unknown():
    for text in ("x = " + " + ".join(["1"] * 60_000), "x = " + "-" * 20_000 + "1"):
        parses, foreign, damage, reason = classify(text)
        assert (parses, foreign, damage) in ((None, None, None), (True, None, None)) and (reason is None) == bool(parses)
