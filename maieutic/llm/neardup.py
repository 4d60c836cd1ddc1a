"""Problem 1: near-duplicate records, by fast similarity sketches, banding and exact verification."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maieutic.llm import shingles
from maieutic.session import broadcast_if_small, stored

#: Coordinates of the short sketch that thins the candidates, one byte each, and how far below the threshold its estimate may lie.
SHORT, SLACK = 128, 0.2
#: Bands that are joined at once, so that a shuffle holds few rows a record.
BAND_BLOCK = 48
#: Values of one key that are paired in one place; more are split into blocks, and each two blocks meet in a place of their own.
BLOCK = 2000
#: Most rows that are sent to every executor; beyond, the join shuffles.
BROADCAST_ROWS = 500_000


def _longs(values: np.ndarray, sizes: np.ndarray | int, n: int) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(np.broadcast_to(sizes, n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1).view(np.int64)))


def hash_of_sets(owner: np.ndarray, h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each set, the same whatever record the set comes from."""
    total = np.zeros(len(size), dtype=np.uint64)
    np.add.at(total, owner, shingles.mix(h))
    return shingles.mix(total + size.astype(np.uint64)).view(np.int64)


def pairs_within(rows: DataFrame, key: str, value: str, block: int = BLOCK) -> DataFrame:
    """a, b: all pairs a < b of different values that share a key, once for each such key.

    Equal rows count once, null keys and values not at all. A key of at most `block` values is paired where it lies. The
    values of a larger one are split by hash into blocks of about that size, and each two
    blocks meet in a task's row group of their own, so no task pairs more than two blocks at
    once, however many values a key has.
    """
    # Both branches below read one shuffle; with the nulls left out here, no filter that one of them infers can tell them apart.
    each = rows.select(F.col(key).alias("k"), F.col(value).alias("v")).where("k is not null and v is not null").repartition("k").dropDuplicates(["k", "v"])
    sized = each.withColumn("m", F.count("*").over(Window.partitionBy("k"))).where("m > 1")
    lists = sized.where(F.col("m") <= block).groupBy("k").agg(F.sort_array(F.collect_list("v")).alias("vs"))  # at most `block` values
    small = lists.select("vs", F.posexplode("vs").alias("i", "a")).select("a", F.explode(F.slice("vs", F.col("i") + 2, F.size("vs"))).alias("b"))
    n = F.ceil(F.col("m") / block).cast("int")
    split = sized.where(F.col("m") > block).select("k", "v", F.pmod(F.xxhash64("v", "k"), n).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), n - 1)).alias("j"))
    met = split.select("k", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "v").repartition("k", "lo", "hi")
    x, y = (met.withColumnsRenamed({"v": v, "i": f"i{v}"}) for v in "ab")
    large = x.join(y, ["k", "lo", "hi"]).where("a < b and (ia <> ib or lo = hi)").select("a", "b")
    return small.unionByName(large)


def sketches(records: DataFrame, key: Column, text: Column, words: int, bands: int, rows: int) -> DataFrame:
    """id, set_hash, size, short, bands for each record whose text has a run of so many words.

    Records with equal sets share set_hash; in each partition only the first of them
    carries bands. The others of other partitions fall out before values are paired.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                ids, texts = part.column(0), part.column(1).to_pylist()
                owner, h, size = shingles.shingle_sets(texts, words)
                set_hash = hash_of_sets(owner, h, size)
                new = []
                for i, (x, n) in enumerate(zip(set_hash.tolist(), size.tolist())):
                    if n and x not in seen:
                        seen.add(x)
                        new.append(i)
                keep = np.flatnonzero(size)
                if not len(keep):
                    continue
                place = np.full(len(texts), -1)
                place[new] = np.arange(len(new))
                chosen = place[owner] >= 0
                sketch = shingles.fast_similarity_sketch(place[owner][chosen], h[chosen], len(new), bands * rows)
                banded = iter(shingles.band_keys(sketch, rows).view(np.int64))
                short = iter((sketch[:, :SHORT] & np.uint64(255)).astype(np.uint8))
                is_new = place[keep] >= 0
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(keep)),
                        pa.array(set_hash[keep]),
                        pa.array(size[keep].astype(np.int32)),
                        pa.array([next(short).tobytes() if x else None for x in is_new], type=pa.binary()),
                        pa.array([next(banded) if x else None for x in is_new], type=pa.list_(pa.int64())),
                    ],
                    names=["id", "set_hash", "size", "short", "bands"],
                )

    rows_in = records.select(key.alias("id"), text.alias("text")).where("id is not null")
    return rows_in.mapInArrow(run, f"id {rows_in.schema['id'].dataType.simpleString()}, set_hash long, size int, short binary, bands array<long>")


def _sets(records: DataFrame, words: int) -> DataFrame:
    """set_hash and the sorted run hashes of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, h, size = shingles.shingle_sets(batch.column("text").to_pylist(), words)
            yield pa.RecordBatch.from_arrays([pa.array(hash_of_sets(owner, h, size)), _longs(h, size, batch.num_rows)], names=["set_hash", "runs"])

    return records.select("text").mapInArrow(run, "set_hash long, runs array<long>")


def _agreement(pairs: DataFrame) -> DataFrame:
    """a, b and the share of equal bytes of the two short sketches, freed of chance agreement."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, SHORT) for c in ("sa", "sb"))
            share = ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(share)], names=["a", "b", "share"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, share double")


class NearDuplicates:
    """Records whose sets of word runs have a Jaccard similarity of at least threshold.

    members: id, set_hash of every record that has at least one run of so many words;
    records of equal sets have equal set_hash. links: a, b, similarity for each pair
    of different sets, a < b, verified on the full sets. With bands * rows coordinates
    a pair of similarity s is a candidate with probability 1 - (1 - s**rows)**bands:
    0.998 at 0.5, 0.9999 at 0.55 for the defaults; nothing caps the
    size of a band or the number of candidates.

    Null and empty texts, and texts with fewer words than a run, are like nothing.
    Rows of equal id count once if their texts are equal; rows of one id with different
    texts count with each text. A null id is left out. An empty table gives empty
    tables. Values of a hot band and copies of one text are paired in blocks.
    """

    def __init__(self, records: DataFrame, key: Column, text: Column, threshold: float = 0.8, words: int = 5, bands: int = 96, rows: int = 4):
        if bands * rows < SHORT:
            raise ValueError(f"bands * rows must be at least {SHORT}")
        table = stored(sketches(records, key, text, words, bands, rows))
        self.members = table.select("id", "set_hash").distinct()
        banded = table.where("bands is not null")
        blocks = [pairs_within(banded.select("set_hash", F.explode(F.slice("bands", i + 1, BAND_BLOCK)).alias("key")), "key", "set_hash") for i in range(0, bands, BAND_BLOCK)]
        pairs = functools.reduce(DataFrame.unionByName, blocks).distinct()
        short = banded.groupBy("set_hash").agg(F.first("short").alias("short"))
        left, right = (short.select(F.col("set_hash").alias(x), F.col("short").alias(f"s{x}")) for x in "ab")
        likely = stored(_agreement(pairs.join(left, "a").join(right, "b")).where(F.col("share") >= threshold - SLACK).select("a", "b"))
        wanted = likely.select(F.explode(F.array("a", "b")).alias("set_hash")).distinct()
        chosen = stored(table.select("id", "set_hash").join(wanted, "set_hash", "left_semi").groupBy("set_hash").agg(F.min("id").alias("id")))
        texts = records.select(key.alias("id"), text.alias("text")).join(broadcast_if_small(chosen, BROADCAST_ROWS), "id")
        sets = _sets(texts, words).dropDuplicates(["set_hash"])
        common = F.size(F.array_intersect("ra", "rb"))
        self.links = stored(
            likely.join(sets.select(F.col("set_hash").alias("a"), F.col("runs").alias("ra")), "a")
            .join(sets.select(F.col("set_hash").alias("b"), F.col("runs").alias("rb")), "b")
            .select("a", "b", common.alias("common"), (F.size("ra") + F.size("rb") - common).alias("union"))
            .where(F.col("common") >= F.col("union") * F.lit(threshold))
            .select("a", "b", (F.col("common") / F.col("union")).alias("similarity"))
        )

    def pairs(self) -> DataFrame:
        """a, b, similarity for every pair of records, the smaller id first, copies expanded."""
        m = self.members
        first, second = m.select(F.col("set_hash").alias("a"), F.col("id").alias("x")), m.select(F.col("set_hash").alias("b"), F.col("id").alias("y"))
        linked = self.links.join(first, "a").join(second, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
        same = pairs_within(m, "set_hash", "id").withColumn("similarity", F.lit(1.0))
        return linked.where("a <> b").unionByName(same).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))

    def classes(self) -> DataFrame:
        """id, class_id, copies, links: one row a record; class_id is the least set_hash that links lead to.

        copies counts the other records of the same set, links the different sets that
        the record's set is linked to. Records that are like no other form classes of one.
        """
        label = components(self.links.select("a", "b"))
        degree = self.links.select(F.explode(F.array("a", "b")).alias("set_hash")).groupBy("set_hash").agg(F.count("*").alias("links"))
        sizes = self.members.groupBy("set_hash").agg((F.count("*") - 1).alias("copies"))
        sets = sizes.join(label, "set_hash", "left").join(degree, "set_hash", "left")
        return self.members.join(sets, "set_hash").select("id", F.coalesce("label", "set_hash").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """set_hash, label: the least node of each node's connected component, for the nodes of edges (a, b).

    Alternates large-star and small-star steps until the edges stay the same; each
    step is one grouped minimum and one join, and is stored, so that no step repeats
    an earlier one. A component of any size needs O(log n) rounds in practice; more
    than rounds raises RuntimeError.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("x"), F.col("m").alias("y")), F.struct(F.col("u").alias("x"), F.col("m").alias("y")))).alias("e"))
        now = stored(small.select(F.col("e.x").alias("u"), F.col("e.y").alias("v")).where("u <> v").distinct())
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == new:
            return now.select(F.col("u").alias("set_hash"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("set_hash"), F.col("v").alias("label")).distinct())
        mark = new
    raise RuntimeError(f"the components did not settle in {rounds} rounds")


#: TESTDATA.md sets runs of three words and half of the union for tasks.
TASK_WORDS, TASK_THRESHOLD = 3, 0.5


def similar_tasks(episodes: DataFrame) -> NearDuplicates:
    """Tasks of episodes by the runs of three words in statement, line break, buggy_solution; null counts as empty."""
    blank = F.lit("")
    text = F.concat(F.coalesce("task.statement", blank), F.lit("\n"), F.coalesce("task.buggy_solution", blank))
    return NearDuplicates(episodes, F.col("task.task_id"), text, TASK_THRESHOLD, TASK_WORDS)
