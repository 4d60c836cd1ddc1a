"""The curriculum over topics: replayed from an episode log, in parts that run side by side."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maieutic.functions.text import unit_draw
from maieutic.operators.batches import ranges
from maieutic.session import stored


@dataclass(frozen=True)
class Curriculum:
    """Weight of a new reward, boost of a weak topic, boost of the weakest at each iteration, run length that resets, first estimate."""

    alpha: float = 0.2
    low_reward_boost: float = 1.5
    focus_boost: float = 0.15
    reset_after: int = 5
    first: float = 0.5
    least_weight: float = 1e-3
    iteration_size: int = 8
    recent: int = 32


def topic_weight(ema: Column, base: Column | float = 1.0, c: Curriculum = Curriculum()) -> Column:
    b = F.lit(base) if isinstance(base, (int, float)) else base
    return F.greatest(F.lit(c.least_weight), b * (1 + F.lit(c.low_reward_boost) * F.greatest(F.lit(0.0), 1 - ema)))


@dataclass(frozen=True)
class Saved:
    """A stored state: averages (topic, ema, weight), the topic and length of the last run, and the resets so far."""

    averages: DataFrame
    topic: str | None = None
    count: int = 0
    resets: int = 0


def _carried(parts: DataFrame, topic: str | None, run: int) -> dict[int, tuple[str | None, int]]:
    """For each part the topic and the length of the run that reaches it from before.

    One row a part is gathered: the runs at its two ends.
    """

    def ends(key, pdf):
        t = pdf.sort_values("seq")["topic"].to_numpy()
        other, back = np.flatnonzero(t != t[0]), np.flatnonzero(t[::-1] != t[-1])
        a, z = (int(x[0]) if len(x) else len(t) for x in (other, back))
        return pd.DataFrame([(int(key[0]), t[0], a, t[-1], z, len(t))], columns=["p", "first", "a", "last", "z", "n"])

    rows = parts.groupBy("_part").applyInPandas(ends, "p int, first string, a long, last string, z long, n long").collect()
    out = {}
    for r in sorted(rows, key=lambda r: r.p):
        out[r.p] = (topic, run)
        run = r.z + (run if r.z == r.n and r["last"] == topic else 0)
        topic = r["last"]
    return out


def _folded(pdf: pd.DataFrame, part: int, last: str | None, run: int, c: Curriculum) -> pd.DataFrame:
    """The rows of one part with their runs, resets, epochs counted from 0, and the affine map a * x + b that takes a topic's average where the epoch's part begins to that behind the row."""
    pdf = pdf.sort_values("seq", ignore_index=True)
    code, names = pd.factorize(pdf["topic"])
    at = np.arange(len(pdf))
    change = np.concatenate([[True], code[1:] != code[:-1]])
    pos = at - np.maximum.accumulate(np.where(change, at, 0)) + 1
    if names[0] == last:
        pos[: int(np.append(np.flatnonzero(change), len(pdf))[1])] += run
    reset = pos % c.reset_after == 0
    local = np.cumsum(reset) - reset
    groups = [local, code]
    k = pdf.groupby(groups).cumcount().to_numpy()
    reward = pdf["reward"].to_numpy()
    b = pd.Series(np.where(k == 0, c.alpha * reward, reward)).groupby(groups).ewm(alpha=c.alpha, adjust=False).mean()
    return pd.DataFrame(
        {"part": np.int32(part), "seq": pdf["seq"], "topic": pdf["topic"], "reward": reward, "run": (pos - 1) % c.reset_after + 1, "reset": reset, "local": local, "a": (1 - c.alpha) ** (k + 1.0), "b": b.droplevel([0, 1]).sort_index().to_numpy()}
    )


def replay(episodes: DataFrame, seq: str, topic: str, reward: str, c: Curriculum = Curriculum(), rows_per_part: int = 500_000, weights: DataFrame | None = None, saved: Saved | None = None) -> DataFrame:
    """seq, topic, reward, run, reset, epoch, ema, weight, part after each episode; part is the range of seq that it was replayed in.

    The moving average of a topic's rewards starts at first; reset_after consecutive
    episodes of one topic reset all topics, and the row that resets shows the state
    after it. Rewards are clamped to [0, 1]; rows with a null topic or reward are left
    out; seq must be unique. weights: topic, weight, the configured first weights, 1 for other
    topics. saved: the state that an earlier replay left, from which this one goes on.

    The log is cut into ranges of seq. Resets depend on topics alone: each range needs
    the run that reaches it. An average depends on what came before only through its
    value at the range's start, as an affine map, so ranges are folded side by side, without a
    loop over rows, and then joined along each topic: no window or list grows with the log.
    """
    rows = episodes.select(F.col(seq).alias("seq"), F.col(topic).alias("topic"), F.col(reward).alias("reward")).where("seq is not null and topic is not null and reward is not null")
    rows = rows.withColumn("reward", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("reward"))))
    parts = ranges(rows, ["seq"], rows_per_part)
    begin = (saved.topic, saved.count) if saved else (None, 0)
    carried = _carried(parts, *begin)

    def fold(key, pdf):
        return _folded(pdf, int(key[0]), *carried.get(int(key[0]), (None, 0)), c)

    folded = parts.groupBy("_part").applyInPandas(fold, "part int, seq long, topic string, reward double, run long, reset boolean, local long, a double, b double")
    resets = saved.resets if saved else 0
    first = F.lit(c.first)
    if len(carried) > 1 or saved:
        folded = stored(folded)
        # One row a part: how many resets came before it.
        earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offset = folded.groupBy("part").agg(F.count_if("reset").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
        placed = folded.join(F.broadcast(offset), "part").withColumn("epoch", F.col("local") + F.col("before") + F.lit(resets))
        # The state of a topic where a part begins: the maps of the parts before it in the same epoch, one a part.
        ends = placed.groupBy("topic", "epoch", "part").agg(F.max_by("a", "seq").alias("a"), F.max_by("b", "seq").alias("b")).withColumn("begin", first)
        if saved:
            known = saved.averages.select("topic", F.col("ema").alias("_ema"), F.lit(resets).cast("long").alias("epoch"))
            ends = ends.join(known, ["topic", "epoch"], "left").withColumn("begin", F.coalesce("_ema", "begin")).drop("_ema")

        def along(key, pdf):
            pdf = pdf.sort_values("part")
            x, out = pdf["begin"].iloc[0], []
            for p, a, b in zip(pdf["part"], pdf["a"], pdf["b"]):  # one step a part
                out.append((key[0], int(key[1]), int(p), float(x)))
                x = a * x + b
            return pd.DataFrame(out, columns=["topic", "epoch", "part", "start"])

        starts = ends.groupBy("topic", "epoch").applyInPandas(along, "topic string, epoch long, part int, start double").where(F.col("start") != first)
        full = placed.join(starts, ["topic", "epoch", "part"], "left")
    else:  # a log of one part begins at first everywhere
        full = folded.withColumn("epoch", F.col("local")).withColumn("start", first)
    base = F.lit(1.0)
    if weights is not None:
        full = full.join(weights.select("topic", F.col("weight").cast("double").alias("_base")), "topic", "left")
        base = F.coalesce("_base", F.lit(1.0))
    ema = F.when(F.col("reset"), first).otherwise(F.col("a") * F.coalesce("start", first) + F.col("b"))
    out = full.withColumn("ema", ema).withColumn("weight", F.when(F.col("reset"), base).otherwise(topic_weight(F.col("ema"), base, c)))
    return out.select("seq", "topic", "reward", "run", "reset", "epoch", "ema", "part", "weight")


def _resets(replayed: DataFrame) -> int:
    return replayed.agg(F.max(F.col("epoch") + F.col("reset").cast("long"))).first()[0] or 0


def latest_state(replayed: DataFrame, topics: DataFrame, c: Curriculum = Curriculum(), saved: Saved | None = None) -> DataFrame:
    """topic, ema, weight, resets of each topic of `topics` and each one seen since the last reset.

    topics may have the configured first weights in a column weight. saved: the state from
    which the replay went on, whose averages and weights hold for topics that were
    neither seen nor reset since.
    """
    total = max(_resets(replayed), saved.resets if saved else 0)
    now = replayed.where(F.col("epoch") == total).groupBy("topic").agg(F.max_by("ema", "seq").alias("ema"))
    base = F.max("weight").cast("double") if "weight" in topics.columns else F.lit(1.0)
    state = topics.where("topic is not null").groupBy("topic").agg(base.alias("_base")).join(now, "topic", "full")
    old = saved.averages.select("topic", F.col("ema").alias("_ema"), F.col("weight").alias("_weight")) if saved and saved.resets == total else None
    if old is not None:
        state = state.join(old, "topic", "full")
    kept_ema, kept_weight = (F.col("_ema"), F.col("_weight")) if old is not None else (F.lit(None).cast("double"),) * 2
    base = F.coalesce("_base", F.lit(1.0))
    known = F.coalesce(F.col("ema"), kept_ema, F.lit(c.first))
    weight = F.when(F.col("ema").isNull(), F.coalesce(kept_weight, base)).otherwise(topic_weight(known, base, c))
    return state.select("topic", known.alias("ema"), weight.alias("weight"), F.lit(total).cast("long").alias("resets"))


def saved_state(replayed: DataFrame, topics: DataFrame, c: Curriculum = Curriculum(), saved: Saved | None = None) -> Saved:
    """The state behind a replay, to go on from: one row a topic, stored, and the last run."""
    last = replayed.agg(F.max_by(F.struct("topic", "run", "reset"), "seq").alias("r")).first().r
    averages = stored(latest_state(replayed, topics, c, saved))
    resets = max(_resets(replayed), saved.resets if saved else 0)
    if last is None:
        return Saved(averages, saved.topic if saved else None, saved.count if saved else 0, resets)
    return Saved(averages, None if last.reset else last.topic, 0 if last.reset else int(last.run), resets)


def weakest(state: DataFrame) -> DataFrame:
    """The topic of the least average; of equal ones the least name."""
    return state.orderBy("ema", "topic").limit(1)


def focus_boosts(replayed: DataFrame, topics: list[str], c: Curriculum = Curriculum()) -> DataFrame:
    """iteration, seq, topic: the weakest topic at the end of each iteration of iteration_size episodes.

    topics: the configured ones, a setting of the run, which stand at first until they
    are seen and again after a reset. Each part of the replay is read for itself, from
    the averages that hold where it begins: those of the part before that last had
    the topic, or first if a reset lies between. replayed is read four times: hand over
    a stored one.
    """
    if not topics:
        return replayed.sparkSession.createDataFrame([], "iteration long, seq long, topic string")
    bounds = replayed.groupBy("part").agg(F.count("*").alias("n"), F.max("epoch").alias("last"), (F.max("epoch") > F.min("epoch")).alias("crossed"), F.max_by("reset", "seq").alias("clear"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    bounds = bounds.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    ends = replayed.groupBy("part", "topic", "epoch").agg(F.max_by("ema", "seq").alias("ema"))
    grid = bounds.select("part", "last", (F.col("crossed") | F.col("clear")).alias("crossed"), "clear", F.explode(F.array(*map(F.lit, topics))).alias("topic"))
    left = grid.join(ends.withColumnRenamed("epoch", "last"), ["part", "topic", "last"], "left")
    value = F.when(F.col("clear"), F.lit(c.first)).otherwise(F.coalesce("ema", F.when(F.col("crossed"), F.lit(c.first))))
    along = Window.partitionBy("topic").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = left.select(F.col("part").alias("p"), "topic", F.coalesce(F.last(value, ignorenulls=True).over(along), F.lit(c.first)).alias("ema"))

    def run(key, rows, begin):
        state = dict(zip(begin["topic"], begin["ema"]))
        heap = [(e, t) for t, e in state.items()]
        heapq.heapify(heap)
        out, n = [], int(rows["before"].iloc[0]) if len(rows) else 0
        for s, t, reset, ema in rows.sort_values("seq")[["seq", "topic", "reset", "ema"]].itertuples(index=False):
            if reset:
                state = {x: c.first for x in topics}
                heap = [(c.first, x) for x in topics]
                heapq.heapify(heap)
            else:
                state[t] = ema
                heapq.heappush(heap, (ema, t))
            n += 1
            if n % c.iteration_size == 0:
                while state.get(heap[0][1]) != heap[0][0]:
                    heapq.heappop(heap)
                out.append((n // c.iteration_size, s, heap[0][1]))
        return pd.DataFrame(out, columns=["iteration", "seq", "topic"])

    rows = replayed.select("part", "seq", "topic", "reset", "ema").join(F.broadcast(bounds.select("part", "before")), "part").select(F.col("part").alias("q"), "before", "seq", "topic", "reset", "ema")
    return rows.groupBy("q").cogroup(starts.groupBy("p")).applyInPandas(run, "iteration long, seq long, topic string")


def boosted_weights(replayed: DataFrame, boosts: DataFrame, topics: DataFrame, c: Curriculum = Curriculum()) -> DataFrame:
    """topic, weight: the last weights, each raised by focus_boost for every iteration since the topic was last seen, or since the last reset, in which it was weakest."""
    state = latest_state(replayed, topics, c)
    since = replayed.where("reset").agg(F.max("seq")).first()[0]
    seen = replayed.groupBy("topic").agg(F.max("seq").alias("seen"))
    after = F.greatest(F.col("seen"), F.lit(since).cast("long"))  # the greater of those that are not null
    n = boosts.join(seen, "topic", "left").where(after.isNull() | (F.col("seq") >= after)).groupBy("topic").agg(F.count("*").alias("n"))
    raised = F.col("weight") * F.pow(F.lit(1 + c.focus_boost), F.coalesce("n", F.lit(0)))
    return state.join(n, "topic", "left").select("topic", F.greatest(F.lit(c.least_weight), raised).alias("weight"))


def recent_topics(replayed: DataFrame, c: Curriculum = Curriculum()) -> DataFrame:
    """seq, topic: the last topics since the last reset, at most c.recent of them."""
    return replayed.where(F.col("epoch") == _resets(replayed)).select("seq", "topic").orderBy(F.col("seq").desc()).limit(c.recent)


def sampled_topics(requests: DataFrame, request: str, state: DataFrame, seed: int = 0) -> DataFrame:
    """request, topic: for each request a topic with a chance in proportion to its weight, at least 1e-6.

    The draw is a digest of request and seed, so it depends on no partition, order or
    engine. The topics, a setting of the run, go to the executors as one sorted table of
    cumulated weights, which an Arrow batch searches by bisection; null without topics.
    """
    table = state.select("topic", F.greatest(F.lit(1e-6), F.col("weight")).alias("w")).where("topic is not null").orderBy("topic").toPandas()
    names, upto = table["topic"].to_numpy(dtype=object), np.cumsum(table["w"].to_numpy(dtype=float))

    @F.pandas_udf("string")
    def chosen(u: pd.Series) -> pd.Series:
        if not len(names):
            return pd.Series([None] * len(u), dtype=object)
        return pd.Series(names[np.minimum(np.searchsorted(upto, u.to_numpy() * upto[-1], "right"), len(names) - 1)])

    return requests.select(F.col(request).alias("request"), chosen(unit_draw(F.concat_ws(":", F.col(request).cast("string"), F.lit(str(seed))))).alias("topic"))
