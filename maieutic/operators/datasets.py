"""Training sets out of episodes: fine-tuning texts, preference pairs, prompts, and the gates before an update."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maieutic.functions import jsons, prompts
from maieutic.functions.text import combined_program, observed_failure, rendered_chat, strip
from maieutic.operators.batches import tail

#: Bounds of the training sets.
MAX_SFT, MAX_PAIRS, MIN_EXAMPLES, RECENT, MAX_PROMPTS = 256, 128, 8, 256, 10


def failure_of(metadata: Column) -> Column:
    return observed_failure(F.get_json_object(metadata, "$.observed_failure"))


def program_of(task: str = "task") -> Column:
    return combined_program(F.col(f"{task}.buggy_solution"), F.col(f"{task}.failing_asserts"))


def task_text(task: str = "task") -> Column:
    """The task of an episode as JSON text."""
    t = lambda k: F.col(f"{task}.{k}")
    return jsons.task_json(t("topic"), t("statement"), program_of(task), t("metadata"), failure_of(t("metadata")))


def sft_texts(examples: DataFrame, seq: str = "seq", limit: int = MAX_SFT) -> DataFrame:
    """position, text: the last `limit` examples, those of lowest reward first, each as a rendered conversation; ties by seq."""
    last = tail(examples, [seq], limit)
    text = rendered_chat(prompts.chat(("system", prompts.ADVERSARY), ("user", F.coalesce(F.col("prompt"), F.lit(""))), ("assistant", F.coalesce(F.col("chosen_completion"), F.lit("")))))
    # At most `limit` rows reach this window.
    return last.select(F.row_number().over(Window.orderBy(F.col("reward").asc_nulls_last(), seq)).alias("position"), text.alias("text"))


def easiest(episodes: DataFrame, topic: str, reward: str, seq: str) -> tuple[DataFrame, DataFrame]:
    """The episode of the highest reward of each topic, and of all: topic, task, reward, seq; of equal ones the earliest. Rewards that are null are left out."""
    rows = episodes.where(F.col(reward).isNotNull()).select(F.col(topic).alias("topic"), F.struct(F.col(reward).alias("r"), (-F.col(seq)).alias("s"), task_text().alias("task")).alias("m"))
    of = lambda best: best.where("m is not null").select("topic", F.col("m.task").alias("task"), F.col("m.r").alias("reward"), (-F.col("m.s")).alias("seq"))
    return of(rows.where("topic is not null").groupBy("topic").agg(F.max("m").alias("m"))), of(rows.agg(F.max("m").alias("m")).withColumn("topic", F.lit(None).cast("string")))


def preference_pairs(hard: DataFrame, rejected: DataFrame, recent: DataFrame, limit: int = MAX_PAIRS) -> DataFrame:
    """part, position, prompt, chosen, rejected: at most `limit` pairs.

    Part 1: the hard examples of lowest reward, each against the easiest recent task of
    its topic, or of any. Part 2: as many of the last rejected examples as part 1 left
    room for, each below the easiest task. Pairs that are equal as JSON, whatever their layout, and
    blank rejections are dropped, without others in their place. hard, rejected: with
    seq; recent: episodes with seq, topic and reward. The easiest tasks are one a topic;
    only `limit` rows meet them.
    """
    by_topic, any_ = easiest(recent, "topic", "reward", "seq")
    any_task = any_.select("task").scalar()

    def with_easy(rows: DataFrame) -> DataFrame:
        return rows.join(by_topic.select("topic", "task"), "topic", "left").withColumn("easy", F.coalesce("task", any_task)).where("easy is not null")

    differ = lambda a, b: ~jsons.canonical(F.col(a)).eqNullSafe(jsons.canonical(F.col(b)))
    first = hard.orderBy(F.col("reward").asc_nulls_last(), "seq").limit(limit)
    one = with_easy(first.select("topic", "seq", "reward", "prompt", "chosen_completion")).where(differ("easy", "chosen_completion"))
    part1 = one.select(F.lit(1).alias("part"), F.row_number().over(Window.orderBy(F.col("reward").asc_nulls_last(), "seq")).alias("position"), "prompt", F.col("chosen_completion").alias("chosen"), F.col("easy").alias("rejected"))
    last = tail(rejected.select("topic", "seq", "prompt", "rejected_completion"), ["seq"], limit).withColumn("back", F.row_number().over(Window.orderBy(F.col("seq").desc())))
    two = with_easy(last.where(F.col("back") <= F.lit(limit) - part1.agg(F.count("*")).scalar())).withColumn("said", strip(F.coalesce("rejected_completion", F.lit(""))))
    part2 = two.where((F.col("said") != "") & differ("said", "easy")).select(F.lit(2).alias("part"), F.row_number().over(Window.orderBy("seq")).alias("position"), "prompt", F.col("easy").alias("chosen"), F.col("said").alias("rejected"))
    return part1.unionByName(part2)


def fallback_examples(recent: DataFrame, limit: int, ascending: bool = False) -> DataFrame:
    """The recent episodes of highest reward as examples, `recent_` before their number as id; ties by seq. ascending: those of lowest reward."""
    order = F.col("reward").asc_nulls_last() if ascending else F.col("reward").desc_nulls_last()
    return recent.orderBy(order, "seq").limit(limit).select(
        F.concat(F.lit("recent_"), F.col("episode_id").cast("string")).alias("example_id"), "topic", F.col("task.task_id").alias("task_id"), prompts.training_text(F.col("topic"), F.col("metadata.weakness_summary")).alias("prompt"), task_text().alias("chosen_completion"), "reward", "seq"
    )


def topped_up(hard: DataFrame, recent: DataFrame, least: int = MIN_EXAMPLES) -> DataFrame:
    """hard, and below `least` of them as many fallback examples as are missing, less those whose task is there already. hard: example_id, topic, task_id, prompt, chosen_completion, reward, seq."""
    n = hard.limit(least).count()
    cols = ["example_id", "topic", "task_id", "prompt", "chosen_completion", "reward", "seq"]
    if n >= least:
        return hard.select(*cols)
    extra = fallback_examples(recent, least - n).dropDuplicates(["task_id"]).join(hard.select("task_id"), "task_id", "left_anti")
    return hard.select(*cols).unionByName(extra.select(*cols))


def update_gate(chosen: DataFrame, least: int) -> DataFrame:
    """n, skipped, reason: whether there are examples enough for an update."""
    return chosen.agg(F.count("*").alias("n")).select("n", (F.col("n") < least).alias("skipped"), F.when(F.col("n") < least, F.format_string("need_%d_chosen_examples_have_%d", F.lit(least), F.col("n"))).alias("reason"))


def tutor_prompts(episodes: DataFrame, seq: str = "seq", limit: int = MAX_PROMPTS) -> DataFrame:
    """seq, prompt: the last `limit` episodes as conversations that ask the tutor for a hint."""
    return tail(episodes, [seq], limit).select(F.col(seq).alias("seq"), prompts.tutor_chat(F.col("task.statement"), program_of(), failure_of(F.col("task.metadata"))).alias("prompt"))


def zipped(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Two lists of the same batches side by side, by batch and place."""
    return left.join(right, list(keys))


def export(rows: DataFrame, path: str) -> None:
    """A data set as JSON Lines for a trainer, null fields included; replaces what is there."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
