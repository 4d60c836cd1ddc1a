"""Problem 3: the N highest-scoring items of every group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction


#: Groups of which a task keeps heaps at once; beyond, the engine sorts the rest of the task's rows by group, with the same result. Its own setting, 128, would sort nearly all rows.
GROUPS_A_TASK = 100_000
_FALLBACK = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"


def topic_key(topic: Column) -> Column:
    """Lower case, underscores as blanks, runs of blanks as one, trimmed; null stays null."""
    return F.trim(F.regexp_replace(F.lower(F.replace(topic, F.lit("_"), F.lit(" "))), r"\s+", " "))


def top_n_per_group(items: DataFrame, group: Column, score: Column, ties: Sequence[Column], n: int, names: Sequence[str]) -> DataFrame:
    """The first n items of each group by score, highest first, then by each of ties, smallest first.

    names: the result's columns, one for the group and one for each of ties; rank
    and score are added. The aggregate is a heap of at most n entries a group that
    each task fills before the shuffle; the heaps are merged behind it, so a group
    of any size sends at most n entries a task.

    Rows whose group or score is null, or whose score is NaN, are left out. A null
    tie value comes after all others. Equal rows stay apart: remove copies before.
    An empty table gives an empty result. Raises the session's limit of groups a task
    to GROUPS_A_TASK where it is lower.
    """
    conf = items.sparkSession.conf
    if int(conf.get(_FALLBACK)) < GROUPS_A_TASK:
        conf.set(_FALLBACK, str(GROUPS_A_TASK))
    if n < 1 or len(names) != 1 + len(ties):
        raise ValueError("n must be positive, and names must hold the group and each tie column")
    rows = items.select(group.alias("g"), score.cast("double").alias("s"), *(c.alias(f"t{i}") for i, c in enumerate(ties))).where(
        F.col("g").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s")
    )
    order = [(-F.col("s")).alias("k")]
    for i in range(len(ties)):
        order += [F.col(f"t{i}").isNull().alias(f"u{i}"), F.col(f"t{i}").alias(f"t{i}")]
    heaps = rows.groupBy("g").agg(InternalFunction.collect_top_k(F.struct(*order), n, True).alias("heap"))
    return heaps.select("g", F.posexplode("heap").alias("p", "e")).select(
        F.col("g").alias(names[0]),
        *(F.col(f"e.t{i}").alias(name) for i, name in enumerate(names[1:])),
        (-F.col("e.k")).alias("score"),
        (F.col("p") + 1).alias("rank"),
    )


def one_per_id(items: DataFrame, key: str, *values: Column) -> DataFrame:
    """One row for each non-null key; where rows of a key differ, the smallest by values."""
    names = [f"v{i}" for i in range(len(values))]
    return (
        items.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("id"))
        .agg(F.min(F.struct(*(v.alias(x) for v, x in zip(values, names)))).alias("v"))
        .select("id", *(F.col(f"v.{x}").alias(x) for x in names))
    )


def top_examples(hard_examples: DataFrame, n: int = 3) -> DataFrame:
    """topic_key, example_id, rank, score: the n examples of highest reward for each topic.

    Rows with one example_id count once. Ties go to the smaller metadata.episode_id,
    then to the smaller example_id. Null topics, rewards and example_ids are left out.
    """
    rows = one_per_id(hard_examples, "example_id", topic_key(F.col("topic")), F.col("reward"), F.col("metadata.episode_id"))
    return top_n_per_group(rows, F.col("v0"), F.col("v1"), [F.col("v2"), F.col("id")], n, ["topic_key", "episode_id", "example_id"])
