"""The curriculum while episodes come in: state in the stream, scoring a micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from maieutic.operators.curriculum import Curriculum
from maieutic.operators.scoring import SPREAD, clamp


class _Averages(StatefulProcessor):
    """Averages of all topics of one run. The reset looks across topics, so a run is one key."""

    def __init__(self, c: Curriculum, weights: Mapping[str, float]):
        self.c, self.weights = c, dict(weights)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ema = handle.getMapState("ema", "topic string", "ema double")
        self.run = handle.getValueState("run", "topic string, length long, resets long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        c, out = self.c, []
        topic, length, resets = self.run.get() if self.run.exists() else (None, 0, 0)
        pdf = pd.concat(list(rows)).sort_values("seq")
        for s, t, r in pdf[["seq", "topic", "reward"]].itertuples(index=False):
            length = length + 1 if t == topic else 1
            topic = t
            before = self.ema.getValue((t,))[0] if self.ema.containsKey((t,)) else c.first
            ema = (1 - c.alpha) * before + c.alpha * max(0.0, min(1.0, r))
            reset = length >= c.reset_after
            if reset:
                for k in [k for k in self.ema.keys()]:  # noqa: C416
                    self.ema.removeKey(k)
                topic, length, resets, ema = None, 0, resets + 1, c.first
            else:
                self.ema.updateValue((t,), (ema,))
            base = self.weights.get(t, 1.0)
            weight = base if reset else max(c.least_weight, base * (1 + c.low_reward_boost * max(0.0, 1 - ema)))
            out.append((key[0], int(s), t, float(ema), float(weight), int(resets)))
        self.run.update((topic, length, resets))
        yield pd.DataFrame(out, columns=["run", "seq", "topic", "ema", "weight", "resets"])

    def close(self) -> None:
        pass


def live_averages(episodes: DataFrame, run: str = "run", c: Curriculum = Curriculum(), weights: Mapping[str, float] | None = None) -> DataFrame:
    """run, seq, topic, ema, weight, resets after each episode of a stream with run, seq, topic and reward.

    Rows of one micro-batch are taken in order of seq; a row that arrives in a later
    one counts then. weights: the configured first weights, 1 for other topics. Needs the RocksDB state store and a checkpoint location.
    """
    rows = episodes.select(F.col(run).alias("run"), "seq", "topic", "reward").where("topic is not null and reward is not null")
    schema = "run string, seq long, topic string, ema double, weight double, resets long"
    return rows.groupBy("run").transformWithStateInPandas(_Averages(c, weights or {}), schema, "Append", "None")


def scored_batches(sink: Callable[[DataFrame, int], None], fraction: float = 0.25, strength: float = SPREAD) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: spreads the scores of each judged batch (batch_id, episode_id, score), and hands rewards and mined rows to sink."""
    from maieutic.operators.batches import hardest
    from maieutic.operators.scoring import spread

    def run(batch: DataFrame, number: int) -> None:
        rewards = batch.dropDuplicates(["episode_id"]).withColumn("reward", clamp(spread(F.col("score"), ["batch_id"], strength)) / 10)
        mined = hardest(rewards, ["batch_id"], "reward", "episode_id", fraction).select("episode_id", F.lit(True).alias("mined"))
        sink(rewards.join(mined, "episode_id", "left").withColumn("mined", F.coalesce("mined", F.lit(False))), number)

    return run
