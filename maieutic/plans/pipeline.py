"""The loop's data steps put together: judged batches into episodes and rejections, and the data sets of an update."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maieutic.functions import jsons, prompts
from maieutic.functions.quality import corruption
from maieutic.functions.text import or_default, sanitized_hint
from maieutic.operators import batches, datasets, scoring, validation
from maieutic.session import stored
from maieutic.sources.config import Settings


def iteration_size(*options: int | None) -> int:
    """The first option that is set, at least 1."""
    return max(1, next((int(o) for o in options if o), 1))


def checkpoint_due(last_episode: int, s: Settings) -> bool:
    return last_episode > 0 and last_episode % s.checkpoint_every_episodes == 0


def clean_hints(answers: DataFrame, raw: str) -> DataFrame:
    """answers with hint: the clean text, the raw one, and what speaks against the raw one."""
    reasons = corruption(F.col(raw))
    return answers.withColumn("hint", F.struct(sanitized_hint(F.col(raw)).alias("text"), F.col(raw).alias("raw_text"), (F.size(reasons) > 0).alias("is_corrupted"), reasons.alias("corruption_reasons")))


def fan_out(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """requests (batch_id, idx, ...) with the item at their place in the reply (batch_id, raw_text) to their batch, and the reply itself.

    A reply that does not hold one item for each request gives zeros.
    """
    n = requests.groupBy("batch_id").agg(F.count("*").cast("int").alias("n"))
    items = replies.join(n, "batch_id").select("batch_id", "raw_text", jsons.array_first(F.col("raw_text")).alias("p"), "n").select("batch_id", "raw_text", jsons.judge_items(F.col("p"), F.col("n")).alias("items"))
    return requests.join(items, "batch_id", "left").withColumn("item", F.coalesce(F.get("items", F.col("idx")), F.lit("0.0"))).drop("items")


class Judged(NamedTuple):
    episodes: DataFrame
    rejections: DataFrame


def judged(rows: DataFrame, context: Column, s: Settings, last_episode: int = 0) -> Judged:
    """Episodes and rejections of judged rows (batch_id, idx, topic, task, hint, item).

    Scores are assembled and spread in their batches; a row whose task is good becomes
    an episode, with the next number in order of batch and place, even if its hint is
    useless; the others become rejections with a reason.
    """
    text = rows.withColumn("_h", F.coalesce(F.nullif(F.col("hint.raw_text"), F.lit("")), F.col("hint.text")))
    scored = stored(scoring.assemble(text, ["batch_id"], "item", "_h", context, s.reward_weights, s.batch_spread_strength, s.bad_task_threshold).withColumn("reward", F.col("adjusted_score") / 10))
    good, bad = validation.gated(scored, "task_valid")
    episodes = batches.numbered(good, ["batch_id", "idx"], "episode_id", start=last_episode + 1).drop("_h", "item")
    mined = batches.hardest(episodes.select("batch_id", "episode_id", "reward"), ["batch_id"], "reward", "episode_id", s.mining_bottom_fraction).select("episode_id", F.lit(True).alias("is_hard"))
    episodes = episodes.join(mined, "episode_id", "left").withColumn("is_hard", F.coalesce("is_hard", F.lit(False)))
    rejections = bad.select("batch_id", "idx", "topic", prompts.training_text(F.col("topic"), F.lit(None).cast("string")).alias("prompt"), "task", or_default(F.col("task_reason"), "judge_bad_task").alias("rejection_reason"), "task_quality")
    return Judged(episodes, rejections)


def update_sets(hard: DataFrame, rejected: DataFrame, recent: DataFrame, s: Settings) -> Mapping[str, DataFrame]:
    """The data sets of an update: sft, pairs, prompts, and gate, the reason for none.

    hard: example_id, topic, task_id, prompt, chosen_completion, reward, seq; rejected:
    topic, seq, prompt, rejected_completion; recent: episodes with seq, topic, reward.
    Each is cut to its newest rows first.
    """
    newest = batches.tail(hard, ["seq"], s.max_sft_examples)
    last = batches.tail(recent, ["seq"], max(256, s.max_sft_examples))
    chosen = stored(datasets.topped_up(newest, last, s.min_hard_examples))
    return {
        "sft": datasets.sft_texts(chosen, limit=s.max_sft_examples),
        "pairs": datasets.preference_pairs(chosen, rejected, last, s.max_dpo_pairs),
        "prompts": datasets.tutor_prompts(last, limit=s.max_episodes),
        "gate": datasets.update_gate(chosen, s.min_hard_examples),
    }
