"""Problem 4: texts cut off by field limits or in transfer."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from maieutic.llm.endings import CUT, DOUBT, ending
from maieutic.session import stored

#: Neighbouring lengths on either side, share of false discoveries, and fewest texts of a significant length.
NEIGHBOURS, FALSE_SHARE, LEAST_TEXTS = 20, 0.001, 8
#: A limit has a hazard so many times that of its neighbours, and incomplete endings for so large a share of its texts; usual lengths of whole texts have neither.
SHARP, CUT_SHARE = 3.0, 0.5
#: An ending is usual from this share of its field's endings without a sentence mark; so at most 1 / USUAL are.
USUAL = 0.002
#: How many times rarer than a usual ending one that is the beginning of it must be, to be taken for a part of it.
RARER = 20


def read_endings(texts: DataFrame, keys: dict[str, Column], text: Column) -> DataFrame:
    """The columns of keys, verdict, tail, and the text's length in characters, bytes and words, with a hash of it; null texts are left out.

    A text that rows of one batch share is read once.
    """
    rows = texts.select(*(c.alias(k) for k, c in keys.items()), text.alias("__text")).where("__text is not null")
    names = list(keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read: dict[int, tuple] = {}
            hashes = batch.column("__hash").to_pylist()
            for i, h in enumerate(hashes):
                if h not in read:
                    t = batch.column("__text")[i].as_py()
                    read[h] = (*ending(t), len(t), len(t.encode("utf-8", "surrogatepass")), len(t.split()))
            columns = list(zip(*(read[h] for h in hashes))) if hashes else [()] * 5
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), *(pa.array(c, k) for c, k in zip(columns, kinds)), batch.column("__hash")], names=[*names, "verdict", "tail", "chars", "bytes", "words", "hash"])

    return rows.withColumn("__hash", F.xxhash64("__text")).mapInArrow(run, f"{schema}, verdict string, tail string, chars int, bytes int, words int, hash long")


@F.pandas_udf(DoubleType())
def log_upper_tail(n, at_risk, rate):
    """log P(X >= n) for X binomial with at_risk trials of the given rate."""
    import pandas as pd

    def one(k: float, m: float, p: float) -> float:
        if p <= 0:
            return -700.0 if k > 0 else 0.0
        if k <= m * p or p >= 1:
            return 0.0
        a, b = math.log(p), math.log1p(-p)
        term = math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1) + k * a + (m - k) * b
        ratio = p / (1 - p)
        total, now, i = 1.0, 1.0, k
        while i < m:
            now *= (m - i) / (i + 1) * ratio
            total += now
            i += 1
            if now < total * 1e-12:
                break
        return min(0.0, term + math.log(total))

    return pd.Series([one(*x) for x in zip(n, at_risk, rate)])


def length_hazards(endings: DataFrame, by: list[str], neighbours: int = NEIGHBOURS, false_share: float = FALSE_SHARE, least: int = LEAST_TEXTS) -> DataFrame:
    """by, unit, length, n_texts, n_cut, at_risk, hazard, neighbour_hazard, log_p, significant for each length of each source.

    The hazard of a length is the share of the texts at least that long that end just
    there. It is tested, by a binomial upper tail, against the mean hazard of the
    neighbouring lengths, and significant where the step-up procedure of Benjamini and
    Hochberg keeps the share of false discoveries of its source and unit below
    false_share, the hazard is SHARP times that of the neighbours, and at least
    CUT_SHARE of the texts of that length end incomplete. A text that occurs in several rows counts once for its source.
    Windows run over the aggregated histogram, never over texts.
    """
    once = endings.select(*by, "hash", "chars", "bytes", "words", (F.col("verdict") == CUT).alias("cut")).distinct()
    units = F.explode(F.array(*(F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("chars", "bytes", "words"))))
    counts = once.select(*by, "cut", units.alias("e")).groupBy(*by, "e.unit", "e.length").agg(F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut"))
    family = [*by, "unit"]
    longer = Window.partitionBy(*family).orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = Window.partitionBy(*family).orderBy("length").rangeBetween(-neighbours, neighbours)
    h = counts.withColumn("at_risk", F.sum("n_texts").over(longer)).withColumn("hazard", F.col("n_texts") / F.col("at_risk"))
    h = h.withColumn("neighbour_hazard", (F.sum("hazard").over(near) - F.col("hazard") + 0.5 / F.col("at_risk")) / (2 * neighbours))
    h = h.withColumn("log_p", log_upper_tail(F.col("n_texts").cast("double"), F.col("at_risk").cast("double"), "neighbour_hazard"))
    by_p = Window.partitionBy(*family).orderBy("log_p", "length")
    tests = Window.partitionBy(*family)
    h = h.withColumn("passes", F.col("log_p") <= F.log(F.lit(false_share) * F.row_number().over(by_p) / F.count("*").over(tests)))
    worst = F.max(F.when(F.col("passes"), F.col("log_p"))).over(tests)
    real = (F.col("log_p") <= worst) & (F.col("n_texts") >= least) & (F.col("hazard") >= SHARP * F.col("neighbour_hazard")) & (F.col("n_cut") >= CUT_SHARE * F.col("n_texts"))
    return h.withColumn("significant", F.coalesce(real, F.lit(False))).drop("passes")


def cut_texts(endings: DataFrame, field: str, source: str) -> DataFrame:
    """endings with is_cut, evidence and at_limit.

    First, a text that ends incomplete, or whose ending leaves doubt, is cut if its
    length is significant for its source (evidence limit). What no limit explains was
    cut in transfer, at whatever length: there an ending counts only if it is
    incomplete by itself (evidence transfer), or if the last line is a rare beginning of a
    usual last line of its field (evidence part).
    at_limit: the length is significant, in whichever of characters, bytes and words
    the source's limits show most clearly.
    """
    both = [field, source]
    hazards = length_hazards(endings, both).where("significant")
    # A limit in one unit also shows, blurred, in the others: only the unit with the clearest limit of a source counts.
    clearest = F.min_by("unit", F.struct("log_p", "unit")).over(Window.partitionBy(*both))
    hazards = hazards.withColumn("clearest", clearest).where("unit = clearest")
    limits = hazards.groupBy(*both).agg(F.collect_set(F.struct("unit", "length")).alias("limits"))
    tails = endings.where("tail is not null").groupBy(field, "tail").agg(F.countDistinct("hash").alias("n"))
    # One row a field; at most 1 / USUAL endings of a field are usual, so the lists have a bound too.
    all_of = tails.groupBy(field).agg(F.sum("n").alias("all"))
    usual = tails.join(F.broadcast(all_of), field).where(F.col("n") >= F.greatest(F.col("all") * USUAL, F.lit(RARER))).groupBy(field).agg(F.collect_list(F.struct("tail", "n")).alias("usual"))
    parts = (
        tails.join(F.broadcast(usual), field)
        .where(F.exists("usual", lambda u: F.startswith(u["tail"], F.col("tail")) & (F.length(u["tail"]) > F.length("tail")) & (u["n"] >= F.col("n") * RARER)))
        .select(field, "tail", F.lit(True).alias("part"))
    )
    e = endings.alias("e")
    rows = e.join(limits.alias("l"), [F.col(f"e.{c}").eqNullSafe(F.col(f"l.{c}")) for c in both], "left").join(parts.alias("p"), [F.col(f"e.{field}") == F.col(f"p.{field}"), F.col("e.tail") == F.col("p.tail")], "left")
    at = F.coalesce(F.exists("l.limits", lambda x: x["length"] == F.when(x["unit"] == "chars", F.col("e.chars")).when(x["unit"] == "bytes", F.col("e.bytes")).otherwise(F.col("e.words"))), F.lit(False))
    part = F.coalesce("p.part", F.lit(False))
    evidence = F.when(at & (F.col("e.verdict").isin(CUT, DOUBT) | part), "limit").when(F.col("e.verdict") == CUT, "transfer").when(part, "part")
    return rows.select("e.*", at.alias("at_limit"), evidence.alias("evidence")).withColumn("is_cut", F.col("evidence").isNotNull())


def stored_texts(episodes: DataFrame) -> DataFrame:
    """field_name, source, episode_id, text for the three raw texts of each episode; rows without a text are left out.

    The source of raw_response is the red_adapter, that of hint_raw_text the
    socratic_model, that of judge_raw_text the judge_model.
    """
    fields = F.array(
        F.struct(F.lit("raw_response").alias("field_name"), F.col("metadata.red_adapter").alias("source"), F.get_json_object("task.metadata", "$.raw_response").alias("text")),
        F.struct(F.lit("hint_raw_text").alias("field_name"), F.col("metadata.socratic_model").alias("source"), F.col("hint.raw_text").alias("text")),
        F.struct(F.lit("judge_raw_text").alias("field_name"), F.get_json_object("judge.metadata", "$.judge_model").alias("source"), F.col("judge.raw_text").alias("text")),
    )
    return episodes.where("episode_id is not null").select("episode_id", F.inline(fields)).where("text is not null")


def judged_texts(episodes: DataFrame) -> DataFrame:
    """field_name, source, episode_id and what cut_texts adds, for each stored text of each episode."""
    keys = {k: F.col(k) for k in ("field_name", "source", "episode_id")}
    return cut_texts(stored(read_endings(stored_texts(episodes), keys, F.col("text"))), "field_name", "source")


def cut_rates(judged: DataFrame) -> DataFrame:
    """For each field and source: episodes with a text that is not blank, those whose text is cut, at a limit, cut at a limit, or cut elsewhere, and the share of cut ones."""
    once = judged.where("verdict <> 'blank'").groupBy("field_name", F.coalesce("source", F.lit("unknown")).alias("source"), "episode_id").agg(F.max("is_cut").alias("cut"), F.max("at_limit").alias("lim"))
    return once.groupBy("field_name", "source").agg(
        F.count("*").alias("n_texts"),
        F.count_if("cut").alias("n_cut"),
        F.count_if("lim").alias("n_at_limit"),
        F.count_if(F.col("cut") & F.col("lim")).alias("n_cut_at_limit"),
        F.count_if(F.col("cut") & ~F.col("lim")).alias("n_cut_in_transfer"),
        F.round(F.count_if("cut") / F.count("*"), 6).alias("cut_rate"),
    )
