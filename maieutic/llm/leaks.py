"""Problem 7: evaluation passages inside training texts, by size-partitioned MinHash containment search."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maieutic.llm import shingles
from maieutic.session import stored

#: Words in each hashed run of the MinHash sets; a passage of n words has n - RUN + 1 runs.
RUN = 5
#: A text is a chain of sets, one for every so many places where a passage can begin.
STEP = 2
#: Coordinates in a band, and the chance with which a passage that is there may go unseen.
BAND_ROWS, MISS = 3, 2e-4
#: Most passages that are sent to every executor, about 60 MB; more are met by a shuffle.
BROADCAST_PASSAGES = 60_000
#: Bits of the table of known bands for each of them, and its greatest size (2 ** 30 bits, 128 MB); probes a band. Each chunk of the table has 2 ** CHUNK bits.
BITS, MOST_BITS, PROBES, CHUNK = 16, 30, 2, 16
_MOST = np.uint32(0xFFFFFFFF)


def bands_for(passage_runs: int, set_size: int) -> int:
    """Bands of which a passage that is wholly in a set of so many runs shares one, but for a chance of MISS.

    Containment 1 of a query of q runs in a set of size u means a Jaccard similarity of q / u.
    """
    p = min(1.0, passage_runs / set_size) ** BAND_ROWS
    return math.ceil(math.log(MISS) / math.log1p(-p)) if p < 1 else 1


class BandTable:
    """Which bands are known, in bits, with PROBES probes a band: no known one is refused, one in (BITS / 1) ** PROBES others is let through."""

    def __init__(self, size: int, bits: np.ndarray | None = None):
        self.size = size  # the table has 2 ** size bits
        self.bits = np.zeros((1 << size) // 8, np.uint8) if bits is None else bits

    @staticmethod
    def size_for(n: int) -> int:
        return max(CHUNK, min(MOST_BITS, math.ceil(math.log2(max(1, n * BITS)))))

    def places(self, keys: np.ndarray) -> list[np.ndarray]:
        shift, mask = np.uint64(64 - self.size), np.uint64((1 << self.size) - 1)
        return [(keys >> shift).astype(np.int64), (keys & mask).astype(np.int64)][:PROBES]

    def add(self, keys: np.ndarray) -> None:
        for at in self.places(keys):
            np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def __contains__(self, key: int) -> bool:
        return bool(self.maybe(np.array([key], np.uint64))[0])

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        ok = np.ones(len(keys), bool)
        for at in self.places(keys):
            ok &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return ok


class Runs(NamedTuple):
    """The runs of a batch of texts side by side; candidate sets with the text, the first run and the band key of each, and where each text's runs end."""

    runs: np.ndarray
    text: np.ndarray
    place: np.ndarray
    key: np.ndarray
    end: np.ndarray


class Banding:
    """MinHash bands of passages of so many words, and of the sets of a text that may hold them."""

    def __init__(self, words: int):
        if words < RUN:
            raise ValueError(f"a passage has at least {RUN} words")
        self.words, self.q = words, words - RUN + 1
        self.width = self.q + STEP - 1  # runs of the passages that begin at STEP neighbouring places
        self.n_bands = np.array([0] * self.q + [bands_for(self.q, u) for u in range(self.q, self.width + 1)])
        rng = np.random.default_rng(20240607)
        self.mult = (rng.integers(1, 1 << 62, int(self.n_bands.max()) * BAND_ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)

    def values(self, runs: np.ndarray, coordinate: int) -> np.ndarray:
        return ((runs * self.mult[coordinate]) >> np.uint64(32)).astype(np.uint32)

    def band_key(self, band: int, least: list[np.ndarray]) -> np.ndarray:
        key = least[0].astype(np.uint64) + self.mult[band]
        for x in least[1:]:
            key = key * np.uint64(0x9E3779B97F4A7C15) + x
        return shingles.mix(key)

    def windows(self, v: np.ndarray) -> np.ndarray:
        """The least of each self.width consecutive values."""
        have = 1
        while have < self.width:
            step = min(have, self.width - have)
            v = np.minimum(v[:-step], v[step:])
            have += step
        return v

    def passages(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The text and the runs of each passage of the texts: one of words - RUN + 1 runs at each place."""
        hashes, starts = shingles.flat(texts)
        lengths = np.maximum(np.diff(starts) - self.words + 1, 0)
        text = np.repeat(np.arange(len(texts)), lengths)
        at = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts[:-1], lengths)
        runs = shingles.runs(hashes, RUN)
        return text, runs[at[:, None] + np.arange(self.q)] if len(at) else np.zeros((0, self.q), np.uint64)

    def passage_keys(self, runs: np.ndarray) -> np.ndarray:
        """The band keys of passages: bands x passages."""
        return np.stack([self.band_key(b, [self.values(runs, BAND_ROWS * b + j).min(axis=1) for j in range(BAND_ROWS)]) for b in range(int(self.n_bands.max()))])

    def candidates(self, texts: list[str | None], maybe: Callable[[np.ndarray], np.ndarray]) -> Runs:
        """The sets of the texts with a band that may be known. The size class of a set says how many of its bands are looked up."""
        flat, number, begin, count = [], [], [], []
        gap = [0] * (self.width + RUN)
        for i, t in enumerate(texts):
            tokens = shingles.words(t)
            if len(tokens) >= self.words:
                number.append(i)
                begin.append(len(flat))
                count.append(len(tokens))
                flat += shingles.word_hashes(tokens)
                flat += gap
        none = np.zeros(0, np.int64)
        if not number:
            return Runs(np.zeros(0, np.uint64), none, none, none.astype(np.uint64), none)
        hashes, begin, count, number = np.array(flat, dtype=np.uint64), np.array(begin), np.array(count), np.array(number)
        runs = shingles.runs(hashes, RUN)
        size = count - RUN + 1
        inside = np.zeros(len(runs) + 1, dtype=np.int32)
        np.add.at(inside, begin, 1)
        np.add.at(inside, begin + size, -1)
        outside = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
        sets = -(-(size - self.q + 1) // STEP)
        text = np.repeat(np.arange(len(number)), sets)
        k = (np.arange(len(text)) - np.repeat(np.cumsum(sets) - sets, sets)) * STEP
        place = begin[text] + k
        bands = self.n_bands[np.minimum(size[text] - k, self.width)]
        found_set, found_key = [], []
        for b in range(int(bands.max())):
            least = []
            for j in range(BAND_ROWS):
                v = self.values(runs, BAND_ROWS * b + j)
                v[outside] = _MOST
                least.append(self.windows(v)[place])
            key = self.band_key(b, least)
            hit = np.flatnonzero((bands > b) & maybe(key))
            found_set.append(hit)
            found_key.append(key[hit])
        block = np.concatenate(found_set)
        return Runs(runs, number[text[block]], place[block], np.concatenate(found_key), (begin + size)[text[block]])

    def verified(self, window: np.ndarray, passage: np.ndarray) -> np.ndarray:
        """Which passages (rows of q runs) are contained, run by run, in the sets beside them (rows of self.width runs)."""
        ok = np.zeros(len(window), bool)
        for step in range(STEP):
            ok |= (window[:, step : step + self.q] == passage).all(axis=1)
        return ok

    def set_runs(self, found: Runs, rows: np.ndarray) -> np.ndarray:
        """The runs of candidate sets, EMPTY behind the end of a text."""
        at = found.place[rows][:, None] + np.arange(self.width)
        return np.where(at < found.end[rows][:, None], found.runs[np.minimum(at, len(found.runs) - 1)], shingles.EMPTY) if len(rows) else np.zeros((0, self.width), np.uint64)


def passage_hash(runs: np.ndarray) -> np.ndarray:
    h = runs[:, 0].copy()
    for i in range(1, runs.shape[1]):
        h = shingles.mix(h * np.uint64(0x9E3779B97F4A7C15) + runs[:, i])
    return h.view(np.int64)


class Passages:
    """The different passages of the held-out texts with their bands, for search in one place."""

    def __init__(self, items: list[tuple[int, str | None]], banding: Banding):
        self.banding = banding
        text, runs = banding.passages([t for _, t in items])
        item = np.array([i for i, _ in items], dtype=np.int64)[text]
        self.hash, first, back = np.unique(passage_hash(runs), return_index=True, return_inverse=True)
        self.runs = runs[first]
        pair = np.unique(np.stack([back, item], axis=1), axis=0) if len(text) else np.zeros((0, 2), np.int64)
        self.items, self.item_starts = pair[:, 1], np.searchsorted(pair[:, 0], np.arange(len(self.hash) + 1))
        keys = banding.passage_keys(self.runs) if len(self.hash) else np.zeros((1, 0), np.uint64)
        order = np.argsort(keys.ravel(), kind="stable")
        self.keys, self.owners = keys.ravel()[order], np.tile(np.arange(len(self.hash)), len(keys))[order]
        self.table = BandTable(BandTable.size_for(len(self.keys)))
        self.table.add(self.keys)

    def search(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Text numbers and passage numbers of all passages in the texts, each pair once."""
        found = self.banding.candidates(texts, self.table.maybe)
        low, high = np.searchsorted(self.keys, found.key, "left"), np.searchsorted(self.keys, found.key, "right")
        n = high - low
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        block, passage = np.repeat(np.arange(len(n)), n), self.owners[at]
        ok = self.banding.verified(self.banding.set_runs(found, block), self.runs[passage])
        pairs = np.unique(found.text[block[ok]] * max(1, len(self.hash)) + passage[ok])
        return pairs // max(1, len(self.hash)), pairs % max(1, len(self.hash))

    def items_of(self, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each entry of passage its items; the entry's position is repeated for each of them."""
        count = self.item_starts[passage + 1] - self.item_starts[passage]
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.item_starts[passage], count)
        return np.repeat(np.arange(len(passage)), count), self.items[at]


def _met_in_place(rows: DataFrame, texts: DataFrame, banding: Banding) -> DataFrame:
    """doc_id, item_id, passage: the passages go to every executor; documents are not shuffled."""
    known = rows.sparkSession.sparkContext.broadcast(Passages([(r.i, r.t) for r in texts.collect()], banding))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = known.value
        for batch in batches:
            for piece in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                number, passage = passages.search(piece.column(1).to_pylist())
                entry, item = passages.items_of(passage)
                ids = np.array(piece.column(0).to_pylist(), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[number[entry]]), pa.array(item), pa.array(passages.hash[passage[entry]])], names=["doc_id", "item_id", "passage"])

    return rows.mapInArrow(run, "doc_id long, item_id long, passage long")


def _rows(values: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.ascontiguousarray(values)], pa.binary())


def _met_by_shuffle(rows: DataFrame, texts: DataFrame, banding: Banding) -> DataFrame:
    """doc_id, item_id, passage: band keys of both sides meet in a join.

    Documents are read once. Only sets with a band that the bit table knows are
    shuffled; the table, of bounded size, is the only thing that every executor gets.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, runs = banding.passages(batch.column("t").to_pylist())
            keys = banding.passage_keys(runs) if len(runs) else np.zeros((1, 0), np.uint64)
            n = len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(passage_hash(runs), n)), _rows(np.tile(runs, (n, 1))), batch.column("i").take(pa.array(np.tile(text, n)))], names=["key", "passage", "runs", "item_id"]
            )

    passages = stored(texts.mapInArrow(split, "key long, passage long, runs binary, item_id long"))
    known = passages.select("key", "passage", "runs").dropDuplicates(["key", "passage"])
    size = BandTable.size_for(passages.count())

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = BandTable(size)
        for batch in batches:
            table.add(np.asarray(batch.column("key")).view(np.uint64))
        parts = table.bits.reshape(-1, (1 << CHUNK) // 8)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), _rows(parts[some])], names=["chunk", "bits"])

    def united(group: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in group.column("bits").to_pylist()])
        return pa.table({"chunk": group.column("chunk").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

    bits = np.zeros(((1 << size) >> CHUNK, (1 << CHUNK) // 8), np.uint8)
    for r in passages.select("key").mapInArrow(chunks, "chunk long, bits binary").groupBy("chunk").applyInArrow(united, "chunk long, bits binary").toLocalIterator():  # at most 2 ** MOST_BITS bits
        bits[r.chunk] = np.frombuffer(r.bits, np.uint8)
    table = rows.sparkSession.sparkContext.broadcast(BandTable(size, bits.ravel()))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                found = banding.candidates(piece.column(1).to_pylist(), table.value.maybe)
                yield pa.RecordBatch.from_arrays([pa.array(found.key.view(np.int64)), piece.column(0).take(pa.array(found.text)), _rows(banding.set_runs(found, np.arange(len(found.key))))], names=["key", "doc_id", "set"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            window, passage = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("set", "runs"))
            if batch.num_rows:
                ok = pa.array(np.flatnonzero(banding.verified(window, passage)))
                yield pa.RecordBatch.from_arrays([batch.column(c).take(ok) for c in ("doc_id", "passage")], names=["doc_id", "passage"])

    met = rows.mapInArrow(look, "key long, doc_id long, set binary").join(known, "key").select("doc_id", "passage", "set", "runs")
    held = met.mapInArrow(verify, "doc_id long, passage long").distinct()
    return held.join(passages.select("passage", "item_id").distinct(), "passage").select("doc_id", "item_id", "passage")


def leaked_passages(documents: DataFrame, doc_key: Column, text: Column, items: DataFrame, item_key: Column, item_texts: list[Column], words: int = 12, passages_a_pass: int = BROADCAST_PASSAGES) -> DataFrame:
    """doc_id, item_id, n_passages: documents that hold at least `words` consecutive words of a text of an item.

    The queries are the item texts' passages, all runs of `words` words, each as the
    set of its five-word runs. A document is a chain of overlapping sets, each of the
    runs of the passages that begin at two neighbouring places, so that the size of a
    set is bounded however long the text is; a short text, and the end of any text, is a
    smaller set. Sets are partitioned by size, and each size class has as many bands as
    a passage wholly contained in such a set needs to be met but for a chance of 2e-4.
    Each candidate is then verified by exact containment of the passage's runs, in
    order; n_passages counts the different passages of the item that were found.

    At most passages_a_pass passages go to every executor; with more, documents and
    passages meet by a shuffle of their bands. Either way documents are read once. Null
    and blank texts and texts of fewer words hold nothing. Equal rows give one row. Empty
    tables give an empty result. Other columns are not read.
    """
    banding = Banding(words)
    rows = documents.select(doc_key.cast("long").alias("doc_id"), text.alias("text")).where("doc_id is not null and text is not null")
    texts = items.select(item_key.cast("long").alias("i"), F.explode(F.array(*item_texts)).alias("t")).where("i is not null and t is not null").distinct()

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([max(0, len(shingles.words(t)) - words + 1) for t in batch.column("t").to_pylist()], pa.int64())], names=["n"])

    n = texts.select("t").mapInArrow(size, "n long").agg(F.sum("n")).first()[0] or 0
    found = (_met_in_place if n <= passages_a_pass else _met_by_shuffle)(rows, texts, banding)
    return found.groupBy("doc_id", "item_id").agg(F.countDistinct("passage").alias("n_passages"))


def leaks(documents: DataFrame, heldout_items: DataFrame, **settings) -> DataFrame:
    """Documents with at least twelve consecutive words of an item's statement or reference_hint."""
    return leaked_passages(documents, F.col("doc_id"), F.col("text"), heldout_items, F.col("item_id"), [F.col("statement"), F.col("reference_hint")], **settings)


def leak_report(documents: DataFrame, heldout_items: DataFrame) -> DataFrame:
    """For each held-out item its topic, the documents that leak it, and the most passages that one of them holds; 0 where none does."""
    hits = leaks(documents, heldout_items).groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("n_passages").alias("most_passages"))
    items = heldout_items.groupBy("item_id").agg(F.min("topic").alias("topic")).where("item_id is not null")
    zero = F.lit(0).cast("long")
    return items.join(hits, "item_id", "left").select("item_id", "topic", F.coalesce("n_documents", zero).alias("n_documents"), F.coalesce("most_passages", zero).alias("most_passages"))
