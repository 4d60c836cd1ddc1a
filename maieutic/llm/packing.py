"""Problem 6: filling containers of fixed capacity with texts of varying length."""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maieutic.session import stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits a text before byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Parts into which the texts of one length are split for ranking, so that a length that a third of all texts share is no single task.
SALTS = 64
#: Tokens that room must have at least to take a part of a text that is longer than the capacity.
LEAST_PIECE = 16
#: Length buckets, of which bucket_batches makes its batches.
BUCKETS = 24
#: Characters after which a long text is handed to the tokenizer in parts.
PART = 100_000


def parts_of(text: str) -> Iterator[str]:
    """Parts of a text that yield the same tokens as the whole: cut before a single blank between two words."""
    begin = 0
    while len(text) - begin > PART:
        at = text.find(" ", begin + PART)
        while at >= 0 and not (at + 1 < len(text) and text[at - 1].isalnum() and text[at + 1].isalnum()):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        yield text[begin:at]
        begin = at
    yield text[begin:]


def token_counts(texts: DataFrame, key: Column, text: Column, tokenizer: str = TOKENIZER) -> DataFrame:
    """id, n_tokens of each text that is not null, in tokens of the ranks file at `tokenizer`, read by every executor."""
    rows = texts.select(key.alias("id"), text.alias("text")).where("id is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [sum(len(encoding.encode_ordinary(p)) for p in parts_of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["id", "n_tokens"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long")


class Slots(NamedTuple):
    """Items of one length, from rank begin on and before rank end: item i goes to container first + (i - begin + shift) // each."""

    length: int
    begin: int
    end: int
    first: int
    shift: int
    each: int


class Rooms(NamedTuple):
    """Containers first to last - 1 with room for so many tokens each."""

    room: int
    first: int
    last: int


def best_fit(histogram: dict[int, int], capacity: int) -> tuple[list[Slots], int, list[Rooms]]:
    """Best fit, longest first, over a histogram of lengths up to the capacity; how many containers that takes, and the room left in them.

    All items of one length are placed at once, into the containers with the least
    room that still holds one, so the work and the result depend on the number of
    different lengths only. At most 11/9 of the least possible number of containers, and one.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    slots, containers = [], 0

    def leave(room: int, first: int, last: int) -> None:
        if room and first < last:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(sizes, room)
            rooms[room].append((first, last))

    for length in sorted(histogram, reverse=True):
        done, n = 0, histogram[length]
        while done < n:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                room = sizes[at]
                first, last = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], sizes[at]
                each = min(room // length, -(-(n - done) // (last - first)))
                take = min(n - done, (last - first) * each)
            else:
                each = capacity // length
                first, last, room = containers, containers + -(-(n - done) // each), capacity
                containers, take = last, n - done
            slots.append(Slots(length, done, done + take, first, 0, each))
            done += take
            whole = first + take // each
            leave(room - each * length, first, whole)
            if take % each:
                leave(room - take % each * length, whole, whole + 1)
                whole += 1
            leave(room, whole, last)
    return slots, containers, [Rooms(room, a, b) for room in sorted(rooms, reverse=True) for a, b in rooms[room]]


def optimal_buckets(histogram: dict[int, int], buckets: int) -> list[tuple[int, int]]:
    """(least, greatest) length of each of at most so many buckets that together pad least.

    Each item is padded to the greatest length of its bucket. Dynamic programming over
    the histogram's different lengths: exact, whatever the number of items.
    """
    lengths = np.array(sorted(histogram), dtype=np.float64)
    n = len(lengths)
    if not n:
        return []
    counts = np.array([histogram[int(x)] for x in lengths], dtype=np.float64)
    below = np.concatenate([[0.0], np.cumsum(counts)])
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    cuts = []
    for _ in range(min(buckets, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        for j in range(0, n, 256):
            top = np.arange(j, min(n, j + 256))
            # The tokens of a bucket from length i to length j, padded; what is not padding is the same for all bounds.
            cost = best[:n, None] + lengths[top] * (below[top + 1] - below[:n, None])
            cost[np.arange(n)[:, None] > top] = np.inf
            cut[top + 1] = cost.argmin(axis=0)
            new[top + 1] = cost.min(axis=0)
        cuts.append(cut)
        best = new
    out, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        i = int(cut[j])
        out.append((int(lengths[i]), int(lengths[j - 1])))
        j = i
    return out[::-1]


def in_buckets(histogram: dict[int, int], capacity: int, buckets: int = BUCKETS) -> tuple[list[Slots], int, list[Rooms]]:
    """Token-budget batches inside each optimal bucket: as many items a container as its greatest length allows. Room in them is not offered."""
    slots, containers = [], 0
    for low, high in optimal_buckets(histogram, buckets):
        each, rank = capacity // high, 0
        for length in sorted(x for x in histogram if low <= x <= high):
            slots.append(Slots(length, 0, histogram[length], containers + rank // each, rank % each, each))
            rank += histogram[length]
        containers += -(-rank // each)
    return slots, containers, []


class Pour:
    """Where the tokens of long texts go when they are poured, one text behind the other, into rooms and then into whole containers."""

    def __init__(self, rooms: list[Rooms], containers: int, capacity: int, least: int):
        used = [r for r in rooms if r.room >= least]
        self.room = np.array([*(r.room for r in used), capacity], dtype=np.int64)
        self.first = np.array([*(r.first for r in used), containers], dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum([r.room * (r.last - r.first) for r in used], dtype=np.int64)]).astype(np.int64)

    def pieces(self, start: int, n: int) -> list[tuple[int, int, int]]:
        """(first token, tokens, container) of the pieces of a text of n tokens that is poured from position start on."""
        out, at, end = [], start, start + n
        i = int(np.searchsorted(self.begin, at, "right")) - 1
        while at < end:
            room, begin = int(self.room[i]), int(self.begin[i])
            stop = int(self.begin[i + 1]) if i + 1 < len(self.begin) else end
            k = (at - begin) // room
            upto = min(end, stop, begin + (k + 1) * room)
            out.append((at - start, upto - at, int(self.first[i]) + k))
            at = upto
            if at == stop:
                i += 1
        return out


def _salted(rows: DataFrame, keys: list[str], value: str, salts: int) -> DataFrame:
    """rows with r, the sum of value over the rows of equal keys that come before, in the order of salt and id.

    Sums run inside salted parts and are moved by the sums of the parts before, so
    that no task orders all rows of a key.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    earlier = Window.partitionBy(*keys).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy(*keys, "salt").agg(F.sum(value).alias("n")).select(*keys, "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    before = Window.partitionBy(*keys, "salt").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return salted.withColumn("own", F.coalesce(F.sum(value).over(before), F.lit(0))).join(offsets, [*keys, "salt"]).withColumn("r", (F.col("own") + F.col("offset")).cast("long")).drop("own", "offset", "salt")


def fill_containers(counts: DataFrame, capacities: dict[str, int], method: str = "best_fit", salts: int = SALTS, least_piece: int = LEAST_PIECE) -> DataFrame:
    """container_kind, doc_id, piece_no, first_token, n_tokens, container_id for all texts and each kind of container.

    counts: id, n_tokens, as of token_counts; read several times, so hand over a stored
    one. A text is split only if it is longer than the capacity: such texts are poured,
    one behind the other, into the room of at least least_piece tokens that the others
    leave, and then into containers of their own, which they fill. A text without
    tokens is in no container. Rows are items, repeated ones too.

    method: best_fit packs the global histogram of text lengths, in_buckets forms
    batches inside optimal length buckets. Only that histogram, at most one entry for
    each length up to the capacity, goes to the driver, and only the slots made from
    it come back. Each text then takes the slot of its rank among the texts of its
    length, or the place of its tokens among those poured; both are counted in salted
    parts, more of them the more texts there are.
    """
    if method not in ("best_fit", "in_buckets") or any(c < 1 for c in capacities.values()):
        raise ValueError("unknown method, or a capacity below 1")
    spark = counts.sparkSession
    schema = "container_kind string, doc_id long, piece_no long, first_token long, n_tokens long, container_id string"
    if not capacities:
        return spark.createDataFrame([], schema)
    salts = max(salts, counts.count() // 1_000_000)
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("long").alias("capacity")) for k, c in sorted(capacities.items()))))
    items = counts.where("n_tokens > 0").select(F.col("id").cast("long").alias("id"), F.col("n_tokens").cast("long").alias("n_tokens"), kinds.alias("k")).select("id", "n_tokens", "k.*")
    whole, long = items.where("n_tokens <= capacity"), items.where("n_tokens > capacity")
    histogram: dict[str, dict[int, int]] = {k: {} for k in capacities}
    for r in whole.groupBy("container_kind", "n_tokens").agg(F.count("*").alias("n")).collect():  # at most one row a token of capacity
        histogram[r.container_kind][r.n_tokens] = r.n
    slots, pours = [], {}
    for kind, capacity in capacities.items():
        own, containers, rooms = {"best_fit": best_fit, "in_buckets": in_buckets}[method](histogram[kind], capacity)
        slots += [(kind, *s) for s in own]
        pours[kind] = Pour(rooms, containers, capacity, least_piece)
    table = spark.createDataFrame(slots, "container_kind string, n_tokens long, begin long, end long, first long, shift long, each long")
    ranked = _salted(whole.withColumn("one", F.lit(1)), ["container_kind", "n_tokens"], "one", salts)
    # Slots number a few for each length up to the capacity, whatever the number of texts.
    put = ranked.join(F.broadcast(table), ["container_kind", "n_tokens"]).where("r >= begin and r < end")
    number = F.col("first") + F.floor((F.col("r") - F.col("begin") + F.col("shift")) / F.col("each")).cast("long")
    zero = F.lit(0).cast("long")
    placed = put.select("container_kind", F.col("id").alias("doc_id"), zero.alias("piece_no"), zero.alias("first_token"), "n_tokens", F.format_string("%s-%d", "container_kind", number).alias("container_id"))

    def pour(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kind, doc, n, at in zip(*(batch.column(c).to_pylist() for c in ("container_kind", "id", "n_tokens", "r"))):
                out += [(kind, doc, i, first, size, f"{kind}-{c}") for i, (first, size, c) in enumerate(pours[kind].pieces(at, n))]
            columns = list(zip(*out)) if out else [()] * 6
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["container_kind", "doc_id", "piece_no", "first_token", "n_tokens", "container_id"])

    poured = _salted(long, ["container_kind"], "n_tokens", salts).select("container_kind", "id", "n_tokens", "r").mapInArrow(pour, schema)
    return placed.unionByName(poured)


def capacities_of(container_sizes: DataFrame) -> dict[str, int]:
    """The capacity of each kind; null and non-positive ones are left out, of several for a kind the least counts."""
    rows = container_sizes.where("container_kind is not null and capacity_tokens > 0").groupBy("container_kind").agg(F.min("capacity_tokens").alias("c"))
    return {r.container_kind: r.c for r in rows.collect()}


def packed_documents(documents: DataFrame, container_sizes: DataFrame, method: str = "best_fit", tokenizer: str = TOKENIZER) -> DataFrame:
    counts = stored(token_counts(documents, F.col("doc_id"), F.col("text"), tokenizer))
    return fill_containers(counts, capacities_of(container_sizes), method)


def fill_report(packed: DataFrame, container_sizes: DataFrame) -> DataFrame:
    """container_kind, capacity, n_pieces, n_tokens, n_containers, fullest, least_containers, room_share, n_split_texts, mean_pieces.

    least_containers is the tokens' own lower bound; mean_pieces is that of the texts that
    were split, null where none was.
    """
    sizes = container_sizes.groupBy("container_kind").agg(F.min("capacity_tokens").cast("long").alias("capacity"))
    each = packed.groupBy("container_kind", "container_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"), F.count_if(F.col("piece_no") == 1).alias("split"), F.count_if(F.col("piece_no") >= 1).alias("further"))
    total = each.groupBy("container_kind").agg(
        F.sum("pieces").alias("n_pieces"), F.sum("tokens").alias("n_tokens"), F.count("*").alias("n_containers"), F.max("tokens").alias("fullest"), F.sum("split").alias("n_split_texts"), F.sum("further").alias("further")
    )
    room = 1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))
    pieces = F.when(F.col("n_split_texts") > 0, 1 + F.col("further") / F.col("n_split_texts"))
    return total.join(sizes, "container_kind").select(
        "container_kind", "capacity", "n_pieces", "n_tokens", "n_containers", "fullest", F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_containers"), F.round(room, 6).alias("room_share"), "n_split_texts", F.round(pieces, 6).alias("mean_pieces")
    )
