"""Problem 8: subject areas of documents, by anchored non-negative factoring of the document-term matrix."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maieutic.llm import languages
from maieutic.llm.shingles import mix
from maieutic.session import discard, release, stored

#: Known terms: so many words and so many pairs of words, those of most documents, with LEAST_DOCUMENTS at least; and as many again that labelled documents share. Their numbers fit in 16 bits.
WORDS, PAIRS, LEAST_DOCUMENTS = 16_000, 16_000, 4
#: Components beside the subjects, which take up what no subject explains, and updates of the documents' mixtures in each round.
BACKGROUND, INNER = 3, 3
#: Rounds go on until one lowers the divergence by less than this share.
SETTLED, MOST_ROUNDS = 0.003, 40
#: A term weighs as much as its rarity tells, and fully if at most this share of the documents of its language have it.
RARE = 0.001
#: Rows of one text weigh together at most this share of all rows in the fitting, so at most 1 / HEAVIEST texts weigh less than their rows.
HEAVIEST = 0.001
#: Labelled documents that give the components their first values; a documented bound.
LABELS = 100_000
#: Share of a term's occurrences in labelled documents that fall to one subject, for it to be among the first values of the subject's component.
OWN = 0.5
#: A sentence is set in the subject of the greatest part of its mixture, if that explains so much of the weight of its terms, more in one with code, and such a share.
SET, SET_CODE, SET_SHARE = 0.2, 1.5, 0.3
#: Sentences set in a subject that make it one of the document's.
LEAST_SENTENCES = 2

# Marks among the word hashes of a text: a number, a piece of code, and, with the number of the sentence's language added, the end of a sentence. Hashes are _WORD or more; the lowest bit is set in those of function words.
_BREAK, _CODE, _END, _WORD = 0, 2, 8, 64
_FENCE = re.compile(r"(?:```|~~~).*?(?:```|~~~|\Z)", re.S)
_HEADING = re.compile(r"^\s*#.*$", re.M)
_PREFIX = re.compile(r"^[ \t]*(?:[-*•>]+|\d+[.)])?[ \t]*(?:[^\W\d_]{1,12}:(?=[ \t]))?", re.M)
_INLINE = re.compile(r"`[^`\n]*`")

# Kinds of bytes: letter, sign inside a word, line break, sentence mark, digit, mark of code, underscore.
_LETTER, _INSIDE, _LINE, _STOP, _DIGIT, _MARK, _LOW = 1, 2, 3, 4, 5, 6, 7
_KIND = np.zeros(256, np.uint8)
_KIND[128:] = _LETTER
for _signs, _k in (("abcdefghijklmnopqrstuvwxyz", _LETTER), ("'-", _INSIDE), ("\n", _LINE), (".!?", _STOP), ("0123456789", _DIGIT), ("\x01", _MARK), ("_", _LOW)):
    _KIND[[ord(c) for c in _signs]] = _k
_IN_WORD = np.isin(np.arange(8), (_LETTER, _DIGIT, _LOW))
_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_PLUS = np.arange(1, 257, dtype=np.uint64)
_NONE = np.uint32(1)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """The powers of a fixed odd number and of its inverse, modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 20), b, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


def encoded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as 32-bit hashes, with marks for code, for numbers and for the ends of sentences, and how many entries each text has.

    Code blocks and headings are left out. A blank text has no entry, a text of
    nothing but code one empty sentence. All texts are read at once, byte by byte:
    a word's hash is a difference of running sums.
    """
    clean = []
    for t in texts:
        if not t or t.isspace():
            clean.append(b"")
            continue
        t = t.replace("\x01", " ")
        if "```" in t or "~~~" in t:
            t = _FENCE.sub("\n", t)
        if "#" in t:
            t = _HEADING.sub("", t)
        t = _PREFIX.sub("", t)
        if "`" in t:
            t = _INLINE.sub(" \x01 ", t)
        clean.append((t.lower() + "\n").encode("utf-8", "replace"))
    data = np.frombuffer(b"".join(clean), np.uint8)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    kind = _KIND[data]
    # Signs beyond ASCII are no letters; a typographic apostrophe may stand inside a word.
    two = np.flatnonzero(data[:-1] == 0xC2)
    two = two[~np.isin(data[two + 1], (0xAA, 0xB5, 0xBA))]
    kind[two] = kind[two + 1] = 0
    three = np.flatnonzero((data[:-2] == 0xE2) | (data[:-2] == 0xE3) & (data[1:-1] == 0x80))
    inside = three[(data[three] == 0xE2) & (data[three + 1] == 0x80) & (data[three + 2] == 0x99)]
    for j in range(3):
        kind[three + j] = 0
    for j in range(3):
        kind[inside + j] = _INSIDE
    word = _IN_WORD[kind]
    # Signs inside a word count only behind a letter.
    signs = np.flatnonzero(kind == _INSIDE)
    if len(signs):
        run = np.concatenate([[True], np.diff(signs) != 1])
        behind = signs[run] - 1
        word[signs[((behind >= 0) & word[behind])[np.cumsum(run) - 1]]] = True
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    begin, stop = edge[::2], edge[1::2]
    power, inverse = _power(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_PLUS[data] * power[:n], out=sums[1:])
    hashes = (mix((sums[stop] - sums[begin]) * inverse[begin]) >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFFFFFE) | np.uint32(_WORD)
    hashes[kind[begin] == _DIGIT] = _BREAK
    hashes[np.searchsorted(begin, np.flatnonzero(kind == _LOW), "right") - 1] = _CODE
    space = _SPACE[data]
    space[:-1] |= (data[:-1] == 0xC2) & (data[1:] == 0xA0)
    stops = np.flatnonzero(kind == _STOP)
    stops = stops[np.concatenate([space[1:], [True]])[stops]]
    out = np.full(n, _NONE, np.uint32)
    out[begin], out[stops], out[kind == _LINE], out[kind == _MARK] = hashes, _END, _END, _CODE
    at = np.flatnonzero(out != _NONE)
    codes, row = out[at], np.searchsorted(np.cumsum([len(c) for c in clean]), at, "right")
    # Of several ends in a row one is left, and none at the beginning of a text that has more.
    first = np.concatenate([[True], row[1:] != row[:-1]])
    keep = (codes != _END) | ~first & (np.concatenate([[_END], codes[:-1]]) != _END)
    keep |= first & (np.bincount(row[keep], minlength=len(texts)) == 0)[row]
    return codes[keep], np.bincount(row[keep], minlength=len(texts))


class Numbers:
    """The places of known keys in a sorted array, by a table of hashed slots, of which few hold more than one key.

    Only the keys are sent to other processes, which make the table, of sixteen slots a key or more, anew.
    """

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys.astype(np.uint64))
        self.shift = np.uint64(64 - max(12, len(keys).bit_length() + 4))
        slot = self._slots(self.keys)
        order = np.argsort(slot, kind="stable")
        counts = np.bincount(slot, minlength=1 << int(64 - self.shift))
        self.first, self.count, self.order, self.most = np.cumsum(counts) - counts, counts, order, int(counts.max(initial=0))

    def __reduce__(self) -> tuple[type[Numbers], tuple[np.ndarray]]:
        return Numbers, (self.keys,)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(_BASE)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for an unknown one."""
        keys = keys.astype(np.uint64, copy=False)
        slot = self._slots(keys)
        out = np.full(len(keys), -1)
        n = self.count[slot]
        for i in range(self.most):
            some = np.flatnonzero(n > i)
            place = self.order[self.first[slot[some]] + i]
            hit = self.keys[place] == keys[some]
            out[some[hit]] = place[hit]
        return out


def word_hashes(words: list[str]) -> np.ndarray:
    """The different hashes of words; names with digits or underscores have none."""
    codes, _ = encoded([" ".join(words)])
    return np.unique(codes[codes >= _WORD])


def _cut(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """values as one binary entry for each of sizes."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


_FUNCTION = Numbers(np.concatenate([word_hashes(w.split()) for w in languages.FUNCTION_WORDS.values()]).astype(np.uint64))
_FUNCTION = Numbers(np.unique(_FUNCTION.keys))
_SPEAKS = np.stack([np.isin(_FUNCTION.keys, word_hashes(w.split())) for w in languages.FUNCTION_WORDS.values()], axis=1).astype(np.float32)
_SPEAKS /= _SPEAKS.sum(axis=1, keepdims=True)
_SALT = mix(np.arange(1, len(languages.NAMES) + 1, dtype=np.uint64))


def coded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """encoded with the function words marked, and the language of each sentence in its end.

    The language is that of most function words in the sentence, or that of the text
    unless another has clearly more.
    """
    codes, sizes = encoded(texts)
    if not len(codes):
        return codes, sizes
    ends = np.flatnonzero(codes == _END)
    known = _FUNCTION(codes)
    hit = np.flatnonzero(known >= 0)
    sums = np.concatenate([np.zeros((1, len(_SALT)), np.float32), np.cumsum(_SPEAKS[known[hit]], axis=0, dtype=np.float64)])
    upto = np.searchsorted(hit, ends)
    own = np.diff(sums[upto], axis=0, prepend=0.0)
    row = np.searchsorted(np.cumsum(sizes), ends, "right")
    of_text = np.add.reduceat(own, np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])), axis=0).argmax(axis=1)
    own[np.arange(len(ends)), of_text[np.cumsum(np.concatenate([[0], row[1:] != row[:-1]]))]] += 1.5
    codes[hit] |= np.uint32(1)
    codes[ends] += own.argmax(axis=1).astype(np.uint32)
    return codes, sizes


def encode_texts(texts: DataFrame, key: Column, text: Column) -> DataFrame:
    """id, code, hash of each text that is not blank: its words as of coded, and a hash of them."""
    rows = texts.select(key.alias("id"), text.alias("text")).where("id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces([batch], 200):
                yield pa.RecordBatch.from_arrays([piece.column(0), _cut(*coded(piece.column(1).to_pylist()))], names=["id", "code"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, code binary").where(F.length("code") > 0).withColumn("hash", F.xxhash64("code"))


def _flat(column: pa.Array, kind: type = np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a batch side by side, and how many each row has."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=kind), np.array([len(v) for v in values], np.int64) // np.dtype(kind).itemsize


def is_end(codes: np.ndarray) -> np.ndarray:
    return (codes >= _END) & (codes < _WORD)


def tongues(codes: np.ndarray) -> np.ndarray:
    """The number of the language of each entry's sentence."""
    ends = np.flatnonzero(is_end(codes))
    return np.repeat((codes[ends] - _END).astype(np.int64), np.diff(ends, prepend=-1))


def words_at(codes: np.ndarray, tongue: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of single words, and their keys: a word in a language."""
    at = np.flatnonzero(codes >= _WORD)
    return at, codes[at].astype(np.uint64) ^ _SALT[tongue[at]]


def pairs_at(codes: np.ndarray, tongue: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys of the pairs of neighbouring words of a sentence that are not both function words; known: of which words."""
    word = codes >= _WORD if known is None else known
    at = np.flatnonzero(word[:-1] & word[1:] & ((codes[:-1] & codes[1:] & 1) == 0))
    pair = mix(codes[at].astype(np.uint64) * np.uint64(_BASE) + codes[at + 1].astype(np.uint64)) | np.uint64(1 << 63)
    return at, pair ^ _SALT[tongue[at]]


class Terms(NamedTuple):
    """Known terms by number: sorted keys, the number of each one's language, its weight, and the weighted number of documents that have it; numbers finds a term by its key."""

    keys: np.ndarray
    tongue: np.ndarray
    weight: np.ndarray
    documents: np.ndarray
    numbers: Numbers

    def normed(self, rows: np.ndarray) -> np.ndarray:
        """rows x terms, made to add up to one within each language where there is anything."""
        sums = np.stack([np.bincount(self.tongue, weights=x, minlength=len(_SALT)) for x in rows])
        return rows / np.maximum(sums, 1e-30)[:, self.tongue]


def row_weights(coded: DataFrame) -> dict[int, float]:
    """hash to weight of a row, for the texts that hold more than HEAVIEST of the rows; at most 1 / HEAVIEST entries."""
    n = coded.count()
    most = max(1.0, HEAVIEST * n)
    return {r.hash: most / r["n"] for r in coded.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > most).collect()}


def known_terms(coded: DataFrame, light: dict[int, float], labelled: DataFrame | None = None, most: tuple[int, int] = (WORDS, PAIRS), least: float = LEAST_DOCUMENTS) -> Terms:
    """Words, then pairs of known words: those of most documents, and as many that labelled documents share.

    The choice is by rank, so a term's chance does not sink as the corpus grows.
    """
    rows = coded.select("id", "code", "hash")
    rows = rows.withColumn("labelled", F.lit(False)) if labelled is None else rows.join(F.broadcast(labelled.select("id", F.lit(True).alias("labelled")).distinct()), "id", "left")

    def counted(words: Numbers | None, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting: list[tuple[np.ndarray, ...]] = []

            def merged() -> tuple[np.ndarray, ...]:
                key, tongue, n, m = (np.concatenate(x) for x in zip(*waiting))
                u, first, back = np.unique(key, return_index=True, return_inverse=True)
                return u, tongue[first], np.bincount(back, weights=n, minlength=len(u)), np.bincount(back, weights=m, minlength=len(u))

            for batch in batches:
                codes, sizes = _flat(batch.column("code"))
                weight = np.array([light.get(h, 1.0) for h in batch.column("hash").to_pylist()])
                marked = weight * np.array(batch.column("labelled").to_pylist(), dtype=bool)
                tongue = tongues(codes)
                at, key = words_at(codes, tongue)
                if words is None:  # the ends of sentences count the documents of each language
                    ends = np.flatnonzero(is_end(codes))
                    at, key = np.concatenate([at, ends]), np.concatenate([key, _SALT[tongue[ends]]])
                else:
                    known = np.zeros(len(codes), bool)
                    known[at] = words(key) >= 0
                    at, key = pairs_at(codes, tongue, known)
                order = np.argsort(key, kind="stable")  # places, and with them rows, stay in order
                key, place = key[order], at[order]
                row = np.searchsorted(np.cumsum(sizes), place, "right")
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                key, place, row = key[new], place[new], row[new]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
                waiting.append((key[first], tongue[place[first]], *(np.add.reduceat(w[row], first) if len(first) else np.zeros(0) for w in (weight, marked))))
                if len(waiting) > 40:
                    waiting = [merged()]
            if waiting:
                key, tongue, n, m = merged()
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(tongue.astype(np.int32)), pa.array(n), pa.array(m)], names=["term", "tongue", "n", "m"])

        each = rows.select("code", "hash", "labelled").mapInArrow(run, "term long, tongue int, n double, m double")
        counts = stored(each.groupBy("term", "tongue").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where((F.col("n") >= least) | (F.col("term").isin([int(x) for x in _SALT.view(np.int64)]))))
        # At most twice the limit reaches the driver.
        often = counts.orderBy(F.col("n").desc(), "term").limit(limit)
        told = counts.where(F.col("m") >= least).orderBy(F.col("m").desc(), "term").limit(limit)
        found = often.unionByName(told).distinct().toPandas()
        return found["term"].to_numpy(np.int64).view(np.uint64), found["tongue"].to_numpy(np.int64), found["n"].to_numpy(np.float64)

    words, tongue, n = counted(None, most[0])
    total = np.zeros(len(_SALT))
    ends = np.isin(words, _SALT)
    total[tongue[ends]] = n[ends]
    words, tongue, n = words[~ends], tongue[~ends], n[~ends]
    pairs = counted(Numbers(words), most[1]) if len(words) else (words, tongue, n)
    keys, tongue, n = (np.concatenate(x) for x in zip((words, tongue, n), pairs))
    order = np.argsort(keys)
    keys, tongue, n = keys[order], tongue[order], n[order]
    share = np.minimum(n / np.maximum(total[tongue], 1e-9), 1.0)
    return Terms(keys, tongue, np.minimum(1.0, np.log(np.maximum(share, 1e-12)) / np.log(RARE)), n, Numbers(keys))


#: Marks of code and of the end of a sentence among the numbers of terms, which are below both.
_CODE_NUMBER, _STOP_NUMBER = 0xFFFE, 0xFFFF


def term_matrix(coded: DataFrame, terms: Terms, light: dict[int, float]) -> DataFrame:
    """id, weight, terms: each document's known terms in order, as 16-bit numbers, with marks behind its sentences."""
    if len(terms.keys) > _CODE_NUMBER:
        raise ValueError("too many terms")
    known = coded.sparkSession.sparkContext.broadcast((terms.numbers, light))
    kind = coded.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, less = known.value
        for batch in batches:
            codes, sizes = _flat(batch.column("code"))
            tongue = tongues(codes)
            # Two slots a place, for the word and for the pair that begin there, keep the order.
            number = np.full((len(codes), 2), -1)
            at, key = words_at(codes, tongue)
            number[at, 0] = numbers(key)
            at, key = pairs_at(codes, tongue)
            number[at, 1] = numbers(key)
            number[codes == _CODE, 0], number[is_end(codes), 0] = _CODE_NUMBER, _STOP_NUMBER
            held = number >= 0
            upto = np.concatenate([[0], np.cumsum(held.sum(axis=1))])[np.concatenate([[0], np.cumsum(sizes)])]
            weight = [less.get(h, 1.0) for h in batch.column("hash").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(weight, pa.float32()), _cut(number[held].astype(np.uint16), np.diff(upto))], names=["id", "weight", "terms"])

    return coded.select("id", "code", "hash").mapInArrow(run, f"id {kind}, weight float, terms binary")


def solved(h: np.ndarray, weight: np.ndarray, term: np.ndarray, sizes: np.ndarray, begin: np.ndarray | None, inner: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mixtures that fit rows of terms to the components h (components x terms), after `inner` multiplicative updates from the mixtures `begin` (components x rows; None: even ones).

    Rows lie side by side, sizes of them each, none empty. Returns the mixtures, the share of each
    component in each term's weight, and the probability of each term.
    """
    mixture, part = begin, h[:, term]
    starts = np.cumsum(sizes) - sizes
    for i in range(inner + 1):
        if mixture is None:
            share, mixture = part * np.float32(1.0 / len(h)), np.full((len(h), len(sizes)), 1.0 / len(h), np.float32)
        else:
            share = np.repeat(mixture, sizes, axis=1)
            share *= part
        chance = np.maximum(share.sum(axis=0), np.float32(1e-30))
        if i < inner:
            got = mixture * np.add.reduceat(part * (weight / chance), starts, axis=1)
            mixture = got / np.maximum(got.sum(axis=0), np.float32(1e-30))
    share *= weight / chance
    return mixture, share, chance


class Model(NamedTuple):
    """names: the subjects in order; terms; h: components x terms, those of the subjects before those of the background; divergence after each round."""

    names: list[str]
    terms: Terms
    h: np.ndarray
    divergence: list[float]


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 150) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


class Sentences(NamedTuple):
    """Of the numbers of a batch: the sentence of each, which ones are terms, which sentences hold code, and the row of each sentence."""

    of: np.ndarray
    is_term: np.ndarray
    has_code: np.ndarray
    row: np.ndarray


def _sentences(number: np.ndarray, sizes: np.ndarray) -> Sentences:
    end = number == _STOP_NUMBER
    of = np.cumsum(end) - end
    has_code = np.zeros(int(end.sum()), bool)
    has_code[of[number == _CODE_NUMBER]] = True
    return Sentences(of, number < _CODE_NUMBER, has_code, np.repeat(np.arange(len(sizes)), sizes)[end])


def merged(term: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's different terms, ascending, how often each occurs in it, and how many there are in each row."""
    cell = np.sort((np.repeat(np.arange(len(sizes)), sizes) << 16) | term)
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    count = np.diff(first, append=len(cell))
    return cell[first] & 0xFFFF, count, np.bincount(cell[first] >> 16, minlength=len(sizes))


def _known_only(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of the sentences without code, how many each row has, and the rows that have any, by number."""
    number, sizes = _flat(piece.column("terms"), np.uint16)
    s = _sentences(number, sizes)
    real = s.is_term & ~s.has_code[s.of]
    n = np.bincount(s.row[s.of[real]], minlength=len(sizes))
    return number[real].astype(np.int64), n[n > 0], np.flatnonzero(n)


def _sums(total: np.ndarray, divergence: float, mass: float) -> Iterator[pa.RecordBatch]:
    """A task's sums (components x terms) for the terms that it has seen, and its divergence under number -1."""
    seen = np.flatnonzero(total.any(axis=0))
    columns = [pa.array(np.concatenate([total[c, seen], [divergence, mass][c : c + 1] if c < 2 else [0.0]]).astype(np.float32)) for c in range(len(total))]
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([seen, [-1]]).astype(np.int32)), *columns], names=["term", *(f"c{c}" for c in range(len(total)))])


def _added(parts: DataFrame, k: int, v: int) -> tuple[np.ndarray, float]:
    """The tasks' sums added up, components x terms, and the divergence by weight of term. One row a known term reaches the driver, and no file of the shuffle stays."""
    out = np.zeros((k, v))
    added = parts.groupBy("term").agg(*(F.sum(f"c{c}").alias(f"c{c}") for c in range(k)))
    found = added.toArrow()
    release(added)
    at = found["term"].to_numpy()
    values = np.stack([found[f"c{c}"].to_numpy() for c in range(k)])
    out[:, at[at >= 0]] = values[:, at >= 0]
    last = values[:, at < 0].sum(axis=1)
    return out, float(last[0] / last[1]) if k > 1 and last[1] else 0.0


def _schema(k: int) -> str:
    return "term int, " + ", ".join(f"c{c} float" for c in range(k))


def gathered(matrix: DataFrame, terms: Terms, h: np.ndarray, inner: int) -> tuple[np.ndarray, float]:
    """One round: the documents' mixtures with the components h fixed, the components' new sums, and the divergence."""
    k, v = h.shape
    known = matrix.sparkSession.sparkContext.broadcast((h.astype(np.float32), terms.weight.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, weigh = known.value
        total, divergence, mass = np.zeros((k, v)), 0.0, 0.0
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def add_up() -> None:
            terms = np.concatenate([t for t, _ in waiting])
            for c in range(k):
                total[c] += np.bincount(terms, weights=np.concatenate([s[c] for _, s in waiting]), minlength=v)
            waiting.clear()

        for piece in _pieces(batches):
            term, sizes, rows = _known_only(piece)
            if not len(term):
                continue
            term, count, sizes = merged(term, sizes)
            weight = weigh[term] * count.astype(np.float32) * np.repeat(np.asarray(piece.column("weight"))[rows], sizes)
            _, share, chance = solved(now, weight, term, sizes, None, inner)
            divergence -= float(weight @ np.log(chance))
            mass += float(weight.sum())
            waiting.append((term, share))
            if len(waiting) == 12:
                add_up()
        if waiting:
            add_up()
        yield from _sums(total, divergence, mass)

    out = _added(matrix.select("weight", "terms").mapInArrow(run, _schema(k)), k, v)
    known.destroy()
    return out


def _labelled(matrix: DataFrame, labels: DataFrame, terms: Terms, names: list[str]) -> np.ndarray:
    """Sums of the terms' weights in labelled documents, each document weighing one: subjects x terms. labels has at most LABELS rows."""
    number, weigh, k, v = {n: i for i, n in enumerate(names)}, terms.weight, len(names), len(terms.keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, v))
        for piece in _pieces(batches):
            term, sizes, rows = _known_only(piece)
            which = np.array([number[s] for s in piece.column("subject").to_pylist()], dtype=np.int64)[rows]
            weight = weigh[term]
            all_of = np.add.reduceat(weight, np.cumsum(sizes) - sizes) if len(term) else np.zeros(0)
            np.add.at(total, (np.repeat(which, sizes), term), weight / np.maximum(np.repeat(all_of, sizes), 1e-9))
        yield from _sums(total, 0.0, 0.0)

    return _added(matrix.join(F.broadcast(labels), "id").select("terms", "subject").mapInArrow(run, _schema(k)), k, v)[0]


def description_words(subjects: dict[str, str]) -> dict[str, list[str]]:
    """For each subject its name and the words that only its description has."""
    split = {s: set(re.findall(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*", d.lower())) for s, d in subjects.items()}
    every = [w for ws in split.values() for w in ws]
    alone = {w for w in every if every.count(w) == 1}
    return {s: sorted((ws & alone) | {s.lower()}) for s, ws in split.items()}


def first_components(terms: Terms, seen: np.ndarray, subjects: dict[str, str], background: int = BACKGROUND) -> np.ndarray:
    """Anchored first values: components x terms.

    A subject's component gets, in each language, the terms that its labelled documents have
    beyond the usual and the words that only its description has, over a faint trace of
    all terms; one without anchors in a language stays empty there. Background components
    are the usual terms, stirred.
    """
    k, v = seen.shape
    base = terms.normed((terms.documents * terms.weight)[None])[0]
    share = terms.normed(seen)
    own = share / np.maximum(share.sum(axis=0), 1e-30)
    said = np.zeros((k, v))
    for i, (_, ws) in enumerate(sorted(description_words(subjects).items())):
        at = terms.numbers((word_hashes(ws).astype(np.uint64)[:, None] ^ _SALT).ravel())
        said[i, at[at >= 0]] = 1.0
    first = terms.normed(np.where(own >= OWN, np.maximum(share - 1.5 * base, 0.0), 0.0)) + 0.5 * terms.normed(said)
    anchored = np.stack([np.bincount(terms.tongue, weights=x, minlength=len(_SALT)) > 0 for x in first])
    h = np.zeros((k + background, v))
    h[:k] = np.where(anchored[:, terms.tongue], first + 0.02 * base, 0.0)
    h[k:] = base * np.random.default_rng(7).uniform(0.5, 1.5, (background, v))
    return terms.normed(h)


def fit(matrix: DataFrame, terms: Terms, subjects: dict[str, str], labels: DataFrame | None, settled: float = SETTLED, inner: int = INNER) -> Model:
    """Components for subjects and background, by alternating multiplicative updates that never increase the divergence.

    Sentences with code take no part, as those about nothing but code have no subject.
    Each round reads all documents, solves their mixtures with the components fixed,
    and gathers the components' new values; a component stays tied to its anchors, as
    updates only multiply. Rounds end when one lowers the divergence by a share of
    less than `settled`.
    """
    names = sorted(subjects)
    if not len(terms.keys) or not names:
        return Model(names, terms, np.zeros((len(names) + BACKGROUND, len(terms.keys)), np.float32), [])
    seen = _labelled(matrix, labels, terms, names) if labels is not None else np.zeros((len(names), len(terms.keys)))
    h = first_components(terms, seen, subjects)
    divergence: list[float] = []
    while len(divergence) < MOST_ROUNDS:
        total, d = gathered(matrix, terms, h, inner)
        h = terms.normed(total)
        divergence.append(d)
        if len(divergence) > 1 and divergence[-2] - d < settled * abs(divergence[-2]):
            break
    return Model(names, terms, h.astype(np.float32), divergence)


def sentence_subjects(model: Model, number: np.ndarray, sizes: np.ndarray, inner: int = INNER) -> tuple[np.ndarray, np.ndarray]:
    """The row and the subject, -1 for none, of each sentence, in order.

    A document's mixture over the components is solved first; those of its sentences
    are one update away from it, so that a sentence of few telling terms leans to what its
    document is about. A sentence is set in the subject that explains most of the weight of its terms,
    if that is SET at least, SET_CODE in a sentence with code, and SET_SHARE of all.
    """
    k, s = len(model.names), _sentences(number, sizes)
    n = len(s.row)
    setting = np.full(n, -1)
    term = number[s.is_term].astype(np.int64)
    if not k or not len(term):
        return s.row, setting
    h, weight = model.h, model.terms.weight.astype(np.float32)
    mixture = np.full((len(h), len(sizes)), 1.0 / len(h), np.float32)
    plain = s.is_term & ~s.has_code[s.of]
    in_row = np.bincount(s.row[s.of[plain]], minlength=len(sizes))
    rows = np.flatnonzero(in_row)
    if len(rows):
        own, count, different = merged(number[plain].astype(np.int64), in_row[rows])
        mixture[:, rows] = solved(h, weight[own] * count.astype(np.float32), own, different, None, inner)[0]
    in_sentence = np.bincount(s.of[s.is_term], minlength=n)
    some = np.flatnonzero(in_sentence)
    begin = mixture[:, s.row[some]] + np.float32(0.05 / len(h))
    _, share, _ = solved(h, weight[term], term, in_sentence[some], begin / begin.sum(axis=0), 1)
    mass = np.add.reduceat(share, np.cumsum(in_sentence[some]) - in_sentence[some], axis=1)
    best = mass[:k].argmax(axis=0)
    top = mass[best, np.arange(len(some))]
    need = np.where(s.has_code[some], SET_CODE, SET)
    setting[some] = np.where((top >= need) & (top >= SET_SHARE * mass.sum(axis=0)), best, -1)
    return s.row, setting


def assign(matrix: DataFrame, model: Model, fallback: str | None, least: int = LEAST_SENTENCES) -> DataFrame:
    """id, subject, n_sentences of each document's subjects; one without any set sentence has the fallback, with 0."""
    known = matrix.sparkSession.sparkContext.broadcast(model)
    kind = matrix.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        names = np.array(m.names, dtype=object)
        for piece in _pieces(batches):
            row, subject = sentence_subjects(m, *_flat(piece.column("terms"), np.uint16))
            count = np.zeros((piece.num_rows, len(names)), dtype=np.int32)
            np.add.at(count, (row[subject >= 0], subject[subject >= 0]), 1)
            d, s = np.nonzero(count >= least)
            bare = np.flatnonzero(count.sum(axis=1) == 0) if fallback is not None else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays(
                [piece.column("id").take(pa.array(np.concatenate([d, bare]))), pa.array([*names[s], *[fallback] * len(bare)], pa.string()), pa.array(np.concatenate([count[d, s], np.zeros(len(bare), np.int32)]), pa.int32())],
                names=["id", "subject", "n_sentences"],
            )

    return matrix.select("id", "terms").mapInArrow(run, f"id {kind}, subject string, n_sentences int")


def document_subjects(documents: DataFrame, subject_list: DataFrame, subject_labels: DataFrame, fallback: str = "software") -> DataFrame:
    """doc_id, subject, n_sentences: the subjects in which at least two of a document's sentences are set.

    Null and blank texts have none. Labels of other subjects than those of subject_list,
    null ones and those of unknown documents are left out, spellings differ by case
    only; a document labelled twice with one subject counts once for it. Texts in a
    language without function words in languages.py are read with the first of that list.
    """
    subjects = {r.subject: r.description or "" for r in subject_list.where("subject is not null").groupBy("subject").agg(F.min("description").alias("description")).collect()}
    coded = stored(encode_texts(documents, F.col("doc_id"), F.col("text")))
    labels = subject_labels.select(F.col("doc_id").alias("id"), F.lower(F.trim("subject")).alias("subject")).where(F.col("subject").isin([s.lower() for s in subjects])).distinct().orderBy(F.xxhash64("id"), "subject").limit(LABELS)
    labels = stored(labels)
    light = row_weights(coded)
    terms = known_terms(coded, light, labels)
    matrix = stored(term_matrix(coded, terms, light))
    discard(coded)  # the matrix, stored in its turn, is all that the rest reads
    model = fit(matrix, terms, {s.lower(): d for s, d in subjects.items()}, labels)
    spelled = F.create_map(*[F.lit(x) for s in subjects for x in (s.lower(), s)]) if subjects else None
    found = assign(matrix, model, fallback if fallback in subjects else None)
    return found.select(F.col("id").alias("doc_id"), F.element_at(spelled, F.col("subject")).alias("subject"), "n_sentences") if subjects else found.withColumnRenamed("id", "doc_id")


def corpus_mixture(assigned: DataFrame) -> DataFrame:
    """subject, n_documents, and the share of all documents with a subject, each document spread evenly over its subjects."""
    each = assigned.groupBy("doc_id").agg(F.collect_set("subject").alias("s"))
    weights = each.select(F.explode("s").alias("subject"), (1 / F.size("s")).alias("w"))
    # A document's weights add up to one, so all weights add up to the number of documents. One row a subject reaches the window.
    of = weights.groupBy("subject").agg(F.count("*").alias("n_documents"), F.sum("w").alias("w"))
    return of.select("subject", "n_documents", F.round(F.col("w") / F.sum("w").over(Window.partitionBy()), 6).alias("share"))
