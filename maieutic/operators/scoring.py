"""Scores of judged batches: criteria, rule-based adjustment, precedence, and spread within a batch."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maieutic.functions import quality
from maieutic.functions.text import strip

# The criteria with their weights, the least quality of a task, the strength of the spread, the cap of a useless hint, and a reason's wording.
WEIGHTS = {"no_solution_reveal": 0.2, "bug_localization": 0.2, "usefulness": 0.25, "socratic_style": 0.15, "technical_accuracy": 0.2}
BAD_TASK, SPREAD, HINT_CAP = 3.0, 0.15, 2.5
CORRUPTED = "assistant output is corrupted and contains gibberish"


def clamp(x: Column, low: float = 0.0, high: float = 10.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def criteria(item: Column, names: Sequence[str]) -> Column:
    """The criteria of a grader's item, JSON text: each clamped, missing or unreadable ones 0; a bare number counts for all."""
    is_object = F.startswith(F.ltrim(item), F.lit("{"))
    number = F.coalesce(item.try_cast("double"), F.lit(0.0))
    read = lambda k: F.coalesce(F.get_json_object(item, f"$.{k}").try_cast("double"), F.lit(0.0))
    return F.create_map(*[x for k in names for x in (F.lit(k), clamp(F.when(is_object, read(k)).otherwise(number)))])


def weighted_score(scores: Column, weights: Mapping[str, float]) -> Column:
    """The weighted mean of a map of criteria, clamped; 0 where no weight is positive. A missing criterion counts 0."""
    total = sum(max(0.0, w) for w in weights.values())
    if total <= 0:
        return F.lit(0.0)
    out = F.lit(0.0)
    for k, w in weights.items():
        out = out + F.coalesce(F.try_element_at(scores, F.lit(k)), F.lit(0.0)) * F.lit(float(w))
    return clamp(out / F.lit(total))


def truth(text: Column) -> Column:
    """A JSON value as a truth value: false for false, zero and an empty text, true for all else; null stays null."""
    return F.when(text.isNotNull(), ~(text.isin("false", "0", "0.0", "", "[]", "{}")))


def assessment(item: Column, bad_task: float = BAD_TASK) -> Column:
    """What a grader's item says of task and hint: a struct; a bare number says nothing against either."""
    is_object = F.startswith(F.ltrim(item), F.lit("{"))
    at = lambda k: F.when(is_object, F.get_json_object(item, f"$.{k}"))
    grade = clamp(F.coalesce(at("task_quality").try_cast("double"), F.lit(5.0)))
    none = F.lit("")
    return F.struct(
        grade.alias("task_quality"),
        F.coalesce(truth(at("task_is_valid_for_socratic")), grade > bad_task).alias("task_valid"),
        strip(F.coalesce(F.nullif(at("task_rejection_reason"), none), at("red_rejection_reason"), none)).alias("task_reason"),
        F.coalesce(truth(at("hint_is_valid_for_socratic")), truth(at("use_for_socratic")), F.lit(True)).alias("hint_valid"),
        strip(F.coalesce(at("hint_rejection_reason"), none)).alias("hint_reason"),
    )


def spread(score: Column, batch: Sequence[str], strength: float = SPREAD) -> Column:
    """Scores moved from the mean of their batch by twice strength times their z value, clamped; a batch of one, or of equal scores, stays as it is."""
    w = Window.partitionBy(*batch)
    deviation = F.stddev_pop(score).over(w)
    move = (F.count(score).over(w) >= 2) & F.lit(strength > 0) & (deviation > 1e-6)
    return F.when(move, clamp(score + F.lit(strength * 2.0) * (score - F.avg(score).over(w)) / deviation)).otherwise(score)


def assemble(rows: DataFrame, batch: Sequence[str], item: str, hint: str, context: Column, weights: Mapping[str, float] = WEIGHTS, strength: float = SPREAD, bad_task: float = BAD_TASK, apply_spread: bool = True) -> DataFrame:
    """rows with criteria, model_score, score, adjusted_score, and what was found of task and hint.

    Precedence: a corrupted hint scores 0, then a severely wrong one, then any hint of
    a bad task; else the model's score plus the hint's delta, capped where the hint is
    useless. The spread counts the zeros; afterwards they are zero again. One window
    over the batch is the only shuffle; what the quality needs is read once, in earlier projections.
    """
    names = list(weights)
    read = rows.select("*", criteria(F.col(item), names).alias("_criteria"), assessment(F.col(item), bad_task).alias("_said"), quality.corruption(F.col(hint)).alias("corruption"))
    read = quality.with_quality(read, hint, context, "_quality").withColumn("model_score", weighted_score(F.col("_criteria"), weights))
    corrupt, severe, bad = F.size("corruption") > 0, F.col("_quality.severe"), ~F.col("_said.task_valid")
    zero = corrupt | severe | bad
    plain = clamp(F.col("model_score") + F.col("_quality.delta"))
    scored = read.withColumn("score", F.when(zero, 0.0).when(~F.col("_said.hint_valid"), F.least(plain, F.lit(HINT_CAP))).otherwise(plain))
    moved = spread(F.col("score"), batch, strength) if apply_spread else F.col("score")
    none = F.create_map(*[x for k in names for x in (F.lit(k), F.lit(0.0))])
    why = or_empty(F.col("_said.hint_reason"), F.array_join("_quality.reasons", ", "))
    return scored.withColumn("adjusted_score", F.when(zero, 0.0).otherwise(moved)).select(
        *rows.columns,
        F.when(corrupt | severe, none).otherwise(F.col("_criteria")).alias("criteria"),
        "model_score",
        "score",
        "adjusted_score",
        "corruption",
        F.col("_quality").alias("quality"),
        F.col("_said.task_quality").alias("task_quality"),
        F.col("_said.task_valid").alias("task_valid"),
        F.col("_said.task_reason").alias("task_reason"),
        (F.col("_said.hint_valid") & ~corrupt & ~severe).alias("hint_valid"),
        F.when(corrupt, CORRUPTED).when(severe, why).otherwise(F.col("_said.hint_reason")).alias("hint_reason"),
    )


def or_empty(text: Column, other: Column) -> Column:
    return F.when(text == "", other).otherwise(text)
