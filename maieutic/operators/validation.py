"""Which tasks and completions are kept, and why the others are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maieutic.functions.quality import kept
from maieutic.functions.text import filled_line_count, strip, topic_key, unit_draw

# Non-empty lines that a program should have, the share of short or passing ones that are sent back, and a reason's wording.
LEAST_LINES, REPAIR_SHARE = 15, 0.5
ALREADY_RIGHT = "already correct code, there are no errors in asserts"


def drawn(key: Column, rule: str, share: float, seed: int = 0) -> Column:
    """True for a share of the keys: a digest of key, seed and rule decides, so the draw depends on no order, partition or engine."""
    return unit_draw(F.concat_ws(":", key.cast("string"), F.lit(str(seed)), F.lit(rule))) < F.lit(share)


def rejection_reasons(task_id: Column, topic: Column, requested: Column, program: Column, status: Column, least_lines: int = LEAST_LINES, share: float = REPAIR_SHARE, seed: int = 0) -> Column:
    """Reasons against a generated task: another topic; for a share of them, too few lines, or checks that all pass."""
    short = filled_line_count(program) < least_lines
    return kept(
        F.when(~topic_key(F.coalesce(topic, F.lit(""))).eqNullSafe(topic_key(F.coalesce(requested, F.lit("")))), F.lit("wrong topic")),
        F.when(short & drawn(task_id, "short", share, seed), F.lit("too short")),
        F.when((status == "passed") & drawn(task_id, "passed", share, seed), F.lit(ALREADY_RIGHT)),
    )


def with_text(rows: DataFrame, completion: str) -> DataFrame:
    """Rows whose completion holds more than white space."""
    return rows.where(strip(F.coalesce(F.col(completion), F.lit(""))) != "")


def gated(rows: DataFrame, valid: str) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and rows that do not; a null verdict passes."""
    ok = F.coalesce(F.col(valid), F.lit(True))
    return rows.where(ok), rows.where(~ok)
