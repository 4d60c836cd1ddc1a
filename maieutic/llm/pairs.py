"""Problem 2: defective question and answer pairs."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maieutic.llm.endings import CUT, ending, json_start
from maieutic.llm.languages import WEIGHTS, languages_differ, profile
from maieutic.llm.shingles import words

#: Share of the answer's three-word runs that are in the question, and of its words in their common subsequence, from which it is a copy.
RUNS_COPIED, WORDS_COPIED = 0.45, 0.8
#: Share of the question's words that a copy of the whole question holds.
WHOLE = 0.85
#: Words of the question, function words aside, that a part of an answer must take up to be of use beside a refusal.
TAKEN_UP = 3

# Words that guide a learner, and words that set a second thought against a first.
GUIDING = frozenset(
    "check print look compare write trace follow think consider count run test step read imagine walk mark watch inspect log find start notice "
    "prüfe gib schau vergleiche schreibe verfolge überlege zähle führe teste lies beobachte notiere beginne sieh denk "
    "comprueba imprime mira compara escribe sigue piensa cuenta ejecuta lee observa anota empieza revisa fíjate "
    "vérifie affiche regarde écris suis pense compte exécute lis observe note commence cherche".split()
)
_CLAUSE = re.compile(r"[;:,–—]+\s+(?=(?:but|yet|however|though|aber|doch|jedoch|pero|aunque|mais|pourtant)\b)|(?<=[;:])\s+|\s+(?=(?:but|yet|aber|jedoch|pero|mais)\b)", re.I)

# Refusal templates. A template aligns with a sentence if its words occur in it in order; / parts alternatives.
REFUSALS = {
    "en": """
        i/we/assistant/model/staff/tutor cannot/can't/couldn't
        i/we/assistant/model/tutor am/are/is/remain/be not/unable
        i/we/assistant/model/tutor will/shall/would/must/do/does/may not
        i/we/assistant/model/tutor won't/don't/doesn't/mustn't
        i/we/assistant/model/tutor have/has decided/chosen/resolved not
        i/we/assistant/model/tutor prefer/prefers not
        i/we/assistant/model/tutor would/prefer/prefers prefer/rather not
        i'd/we'd rather/prefer not
        i/we/assistant/model/tutor must/have/has to/decline decline/declined/decline
        i/we/assistant/model must decline/refuse
        i/we/assistant/model decline/declines/refuse/refuses
        would/will not be appropriate
        outside/beyond of/what allowed/permitted/scope
        request/question/this declined/refused/rejected by/policy policy
        would/goes go/against against/the guidelines/policy/rules/principles
        something i/we cannot/can't/won't
        apologies/sorry no
        sorry can't/cannot/won't
        not feel comfortable
    """,
    "de": """
        ich/wir kann/können/darf/dürfen/möchte/möchten/will/werde nicht/lieber/keine
        kann/können/darf/dürfen/möchte/möchten/will/werde/werden ich/wir nicht/lieber/keine/leider
        tut mir leid
        leider kann/können/darf nicht
        nicht beantworten
        mir nicht erlaubt/gestattet/möglich
    """,
    "es": """
        no puedo/podemos/debo/quiero
        prefiero/preferimos no
        no me está/es permitido/posible
        lo siento no/pero
        no está/es permitido/apropiado
    """,
    "fr": """
        ne peux/pouvons/puis/dois/veux pas
        préfère/préférons ne
        ne m'est/est pas permis/possible
        m'est pas permis/possible
        suis désolé/désolée
        refuse/refusons de
    """,
}
# Questions of courtesy, as templates.
COURTESY = """
    anything/something else
    can/could/may i/we help
    sonst noch
    kann/können ich/wir helfen
    algo más
    puedo/podemos ayudar/ayudarte/ayudarle
    autre chose
    puis aider
"""
_COURTESY = [[frozenset(w.split("/")) for w in line.split()] for line in COURTESY.strip().splitlines()]
_TEMPLATES = [[frozenset(w.split("/")) for w in line.split()] for block in REFUSALS.values() for line in block.strip().splitlines()]
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_FENCE_MARK = re.compile(r"(?:```|~~~)[ \t]*[\w+\-]*[ \t]*")
_LEAD_IN = re.compile(r"^\s*(?:\*\*[^*\n]{1,20}\*\*:?|[^\W\d_]{2,10}:)\s+")
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”»)]*\s+|\n+")
_CODE_BLOCK = re.compile(r"(?:```|~~~).*?(?:```|~~~|\Z)", re.S)
_EMPTY_JSON = re.compile(r"^[\s\[\]{}\",:]*(?:null[\s\[\]{}\",:]*)*$")


def gist(value: object) -> list[tuple[str, str]]:
    """(key, text) of all texts, numbers and truth values in a JSON value, in order; nulls and empty texts are left out."""
    out: list[tuple[str, str]] = []
    todo = [("", value)]
    while todo:
        key, v = todo.pop()
        if isinstance(v, dict):
            todo += [(str(k), x) for k, x in reversed(list(v.items()))]
        elif isinstance(v, list):
            todo += [(key, x) for x in reversed(v)]
        elif v is not None and str(v).strip():
            out.append((key, str(v)))
    return out


def unwrapped(answer: str) -> tuple[list[tuple[str, str]] | None, str]:
    """The gist of the JSON that the answer consists of, if it does, and the text beside it."""
    at = json_start(answer)
    if at < 0:
        s = answer.strip()
        if s in ("null", '""') or s[:1] == s[-1:] == '"' and len(s) > 1:
            try:
                return gist(json.loads(s)), ""
            except ValueError:
                pass
        return None, answer
    try:
        value, end = json.JSONDecoder().raw_decode(answer, at)
    except (ValueError, RecursionError):
        return None, answer
    return gist(value), _FENCE_MARK.sub(" ", answer[:at] + " " + answer[end:])


def is_code(text: str) -> bool:
    """Whether a text reads as a program: statements, or many more signs than words."""
    return bool(re.search(r"^\s*(?:def |class |import |from \w+ import|assert |for .*:$|while .*:$|return\b|[\w.\[\]]+ = )|^\s*(?:public|function|const|#!|CREATE|INSERT)\b|\\n {4}", text, re.M))


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    text = _FENCE_MARK.sub(" ", answer) if re.search("```|~~~", answer) else answer
    if not re.search(r"\w", text) or _EMPTY_JSON.match(text.strip()):
        return True
    inside, beside = unwrapped(answer)
    return inside is not None and not re.search(r"\w", "".join(v for _, v in inside) + beside)


def aligned(tokens: list[str], template: list[frozenset[str]], spread: int = 5) -> bool:
    """Whether the template's words occur in tokens in this order, each at most so many words behind the one before."""
    starts = [i for i, t in enumerate(tokens) if t in template[0]]
    for i in starts:
        at = i
        for options in template[1:]:
            at = next((j for j in range(at + 1, min(at + 1 + spread, len(tokens))) if tokens[j] in options), -1)
            if at < 0:
                break
        else:
            return True
    return False


def refuses(text: str, question: str | None = None) -> bool:
    """Whether a text declines and offers nothing of use.

    Some clause, wherever it stands, aligns with a refusal template. None of the text names
    code, and no other clause is of use: asks something beyond courtesy, guides, or takes up what the
    question speaks of. Thanks, excuses and advice to ask somebody else may have any length.
    """
    body = _LEAD_IN.sub("", text.strip())
    if "`" in body or re.search(r"[^\W_]_[^\W_]", body) or is_code(body):
        return False
    asked = {w for w in words(question) if len(w) >= 4 and w not in WEIGHTS}
    declined = False
    for sentence in _SENTENCE.split(body):
        said = _TOKEN.findall(sentence.lower().replace("’", "'"))
        if sentence.rstrip("\"'”») ").endswith("?") and not any(aligned(said, t) for t in _COURTESY):
            return False
        for clause in _CLAUSE.split(sentence):
            tokens = _TOKEN.findall(clause.lower().replace("’", "'"))
            if any(aligned(tokens, t) for t in _TEMPLATES):
                declined = True
            elif not GUIDING.isdisjoint(tokens) or len(asked.intersection(tokens)) >= TAKEN_UP:
                return False
    return declined


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = row & at.get(w, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def runs_of(tokens: list[str], k: int = 3) -> set[tuple[str, ...]]:
    return set(zip(*(tokens[i:] for i in range(k))))


def copied_share(question: list[str], answer: list[str]) -> tuple[float, float, float]:
    """Shares of the answer's runs in the question, of the answer's words in their common subsequence, and of the question's words in it."""
    if not question or not answer:
        return 0.0, 0.0, 0.0
    runs, known = runs_of(answer), runs_of(question)
    held = len(runs & known) / len(runs) if runs else float(answer == question)
    if held < RUNS_COPIED:
        return held, 0.0, 0.0
    n = common_subsequence(question, answer)
    return held, n / len(answer), n / len(question)


def natural(text: str) -> str:
    """A text without code, fences, quoted names and a short lead-in."""
    text = _CODE_BLOCK.sub(" ", text)
    return _LEAD_IN.sub("", re.sub(r"`[^`]*`|\b\w+_\w+\b", " ", text))


def natural_of_json(inside: list[tuple[str, str]]) -> str:
    """The sentences among a JSON value's texts: four words or more, and no program."""
    return "\n".join(v for k, v in inside if len(v.split()) >= 4 and not is_code(v) and "code" not in k and "solution" not in k)


def defect(question: str | None, answer: str | None) -> str | None:
    """empty, refusal, copied, truncated, other_language, or None.

    A null question has no language and nothing to copy. A text in which no language
    is clear is in no other language; see languages for those that are told apart.
    """
    if is_empty(answer):
        return "empty"
    inside, beside = unwrapped(answer)
    if inside is None:
        programs, said, spoken = False, answer, natural(answer)
    else:
        programs = any(is_code(v) or k in ("buggy_solution", "solution", "code") for k, v in inside)
        said = "\n".join(v for k, v in inside if k != "topic")
        spoken = natural_of_json(inside)
        if len(inside) <= 1 and not said:
            said = beside
    cut = ending(answer)[0] == CUT
    if not programs:
        if not cut and refuses(said, question):
            return "refusal"
        q, a = words(question), words(said)
        held, mine, whole = copied_share(q, a)
        if held >= RUNS_COPIED and mine >= WORDS_COPIED and len(a) >= 4:
            last = [w for w in (words(p) for p in _SENTENCE.split(said.strip())) if w][-1]
            runs = runs_of(last)
            own = len(last) >= 5 and len(runs & runs_of(q)) < 0.3 * len(runs)
            if not own and (whole >= WHOLE or not cut):
                return "copied"
    if cut:
        return "truncated"
    if question:
        if languages_differ(profile(natural(question)), profile(spoken)):
            return "other_language"
    return None


def defective_pairs(pairs: DataFrame, keys: dict[str, Column], question: Column, answer: Column) -> DataFrame:
    """The columns of keys and defect, for each pair with a defect; see defect for its kinds.

    Texts are read whole; other columns are not read; repeated rows stay repeated;
    an empty table gives an empty result.
    """
    rows = pairs.select(*(c.alias(k) for k, c in keys.items()), question.alias("__q"), answer.alias("__a"))
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([defect(q, a) for q, a in zip(batch.column("__q").to_pylist(), batch.column("__a").to_pylist())], pa.string())
            table = pa.table([batch.column(x) for x in names] + [found], names=[*names, "defect"])
            yield from table.filter(found.is_valid()).combine_chunks().to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys)
    return rows.mapInArrow(run, f"{schema}, defect string")


def question_pairs(hard_examples: DataFrame, episodes: DataFrame) -> DataFrame:
    """pair_source, pair_id, question, answer of both tables; rows without an id are left out."""
    h = hard_examples.select(F.lit("hard_examples").alias("pair_source"), F.col("example_id").alias("pair_id"), F.col("prompt").alias("question"), F.col("chosen_completion").alias("answer"))
    e = episodes.select(F.lit("episodes").alias("pair_source"), F.col("episode_id").cast("string").alias("pair_id"), F.col("task.statement").alias("question"), F.col("hint.text").alias("answer"))
    return h.unionByName(e).where("pair_id is not null")


def found_pairs(hard_examples: DataFrame, episodes: DataFrame) -> DataFrame:
    """pair_source, pair_id, defect, each once."""
    pairs = question_pairs(hard_examples, episodes)
    keys = {k: F.col(k) for k in ("pair_source", "pair_id")}
    return defective_pairs(pairs, keys, F.col("question"), F.col("answer")).distinct()


def defect_counts(hard_examples: DataFrame, episodes: DataFrame) -> DataFrame:
    """pair_source, defect, n_pairs, and their share of the source's pairs."""
    n = question_pairs(hard_examples, episodes).groupBy("pair_source").agg(F.countDistinct("pair_id").alias("n_all"))
    found = found_pairs(hard_examples, episodes).groupBy("pair_source", "defect").agg(F.count("*").alias("n_pairs"))
    return found.join(n, "pair_source").select("pair_source", "defect", "n_pairs", F.round(F.col("n_pairs") / F.col("n_all"), 6).alias("share"))
