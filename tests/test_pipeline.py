"""The loop's steps together, on a handful of rows."""

import json

import pytest
from pyspark.sql import functions as F

from maieutic.functions import quality
from maieutic.plans import pipeline
from maieutic.sources.config import settings

S = settings({"topics": ["t"], "min_hard_examples": 4})
ITEM = dict.fromkeys(S.reward_weights, 8)


def requests(spark):
    kind = "batch_id long, idx int, topic string, task struct<task_id string, topic string, statement string, buggy_solution string, failing_asserts array<string>, metadata string>, raw string"
    rows = [(b, i, "t", (f"k{b}{i}", "t", "s", f"x{b} = {i}", [], "{}"), f"Why is `x{b}` so?") for b in (0, 1) for i in range(3)]
    return pipeline.clean_hints(spark.createDataFrame(rows, kind), "raw")


def test_judged_batches(spark):
    replies = [(0, json.dumps([ITEM, ITEM | {"task_quality": 1, "task_rejection_reason": " dull "}, ITEM | {"usefulness": 1}])), (1, json.dumps([ITEM]))]
    rows = pipeline.fan_out(requests(spark), spark.createDataFrame(replies, "batch_id long, raw_text string"))
    assert rows.where("batch_id = 1").select("item").distinct().first().item == "0.0"
    context = quality.hint_context(F.col("task.buggy_solution"), F.lit("ValueError"), F.col("task.failing_asserts"), F.lit(""), F.lit("failed"))
    got = pipeline.judged(rows, context, S, last_episode=10)
    episodes = {r.episode_id: r for r in got.episodes.collect()}
    assert sorted(episodes) == [11, 12, 13, 14, 15]
    assert (episodes[11].batch_id, episodes[11].idx, episodes[12].idx, episodes[13].batch_id) == (0, 0, 2, 1)
    assert episodes[11].reward > episodes[12].reward and episodes[12].is_hard and not episodes[11].is_hard
    assert [(r.idx, r.rejection_reason) for r in got.rejections.collect()] == [(1, "dull")]


def test_update_sets(spark):
    kind = "episode_id long, seq long, topic string, reward double, task struct<task_id string, topic string, statement string, buggy_solution string, failing_asserts array<string>, metadata string>, metadata struct<weakness_summary string>"
    recent = spark.createDataFrame([(i, i, "t", i / 10, (f"k{i}", "t", f"s{i}", f"x = {i}", [], "{}"), (None,)) for i in range(1, 6)], kind)
    hard = spark.createDataFrame([("h", "t", "k9", "p", "c", 0.1, 1)], "example_id string, topic string, task_id string, prompt string, chosen_completion string, reward double, seq long")
    rejected = spark.createDataFrame([("t", 1, "q", "bad")], "topic string, seq long, prompt string, rejected_completion string")
    sets = pipeline.update_sets(hard, rejected, recent, S)
    assert sets["gate"].first().n == 4 and sets["gate"].first().reason is None
    assert sets["sft"].orderBy("position").first().text.endswith("ASSISTANT: c") and sets["sft"].count() == 4
    assert {r.part for r in sets["pairs"].collect()} == {1, 2} and sets["prompts"].count() == 5


@pytest.mark.parametrize("options,want", [((8, 2), 8), ((0, 2), 2), ((None, None), 1), ((), 1)])
def test_iteration_size(options, want):
    assert pipeline.iteration_size(*options) == want


def test_checkpoint_due():
    assert [pipeline.checkpoint_due(i, S) for i in (0, 9, 10, 20)] == [False, False, True, True]
