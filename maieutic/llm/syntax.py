"""Problem 5: source files that do not parse."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maieutic.llm.grammars import classify

_SCHEMA = "parses boolean, foreign_language string, damage string, reason string"


def parse_files(files: DataFrame, keys: dict[str, Column], source: Column, expected: str = "python", failures_only: bool = False) -> DataFrame:
    """The columns of keys, and for each file whether it parses in the expected language.

    parses is null for a null or blank file, and, with a reason, for one that takes the
    parser to its limits. A file that fails is parsed by all other grammars:
    foreign_language is the first by token ranking that accepts it (a wrong extension), damage the
    likely corruption where none does, reason the message of the expected grammar. Files are read whole. Repeated rows stay repeated; an empty
    table gives an empty result; columns beside keys and source are not read.

    failures_only: only files that do not parse, so that a caller after those alone
    moves no other row out of the Python worker.
    """
    rows = files.select(*(c.alias(k) for k, c in keys.items()), source.alias("__source"))
    names, kinds = list(keys), [f for f in rows.schema.fields if f.name != "__source"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", " + _SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, keep = [], []
            for i, text in enumerate(batch.column("__source").to_pylist()):
                r = (None, None, None, None) if text is None or not text.strip() else classify(text, expected)
                if not failures_only or r[0] is False:
                    out.append(r)
                    keep.append(i)
            found = pa.table([pa.array([r[j] for r in out], type=t) for j, t in enumerate((pa.bool_(), pa.string(), pa.string(), pa.string()))], names=["parses", "foreign_language", "damage", "reason"])
            kept = pa.table(batch.select(names)).take(pa.array(keep, type=pa.int64()))
            for j, name in enumerate(found.column_names):
                kept = kept.append_column(name, found.column(j))
            yield from kept.combine_chunks().to_batches()

    return rows.mapInArrow(run, schema)


def unparsed_tasks(episodes: DataFrame) -> DataFrame:
    """task_id of each task whose buggy_solution, neither null nor blank, is a program of another language or corrupted."""
    failed = parse_files(episodes, {"task_id": F.col("task.task_id")}, F.col("task.buggy_solution"), failures_only=True)
    return failed.where("task_id is not null and (foreign_language is not null or damage is not null)").select("task_id").distinct()


def language_name(raw: Column) -> Column:
    """One name for the spellings of a language: lower case, without version; py is python; null is unknown."""
    name = F.regexp_replace(F.lower(F.trim(raw)), r"[\s\d.]+$", "")
    return F.when(F.coalesce(name, F.lit("")) == "", "unknown").when(name == "py", "python").otherwise(name)


def parse_rates(episodes: DataFrame) -> DataFrame:
    """For each repo and language of task.metadata: tasks with a program, those that do not parse, by kind, those beyond the parser, and the rate.

    A missing repo or language is unknown. Tasks that occur in several rows count once.
    """
    meta = F.col("task.metadata")
    rows = parse_files(episodes, {"task_id": F.col("task.task_id"), "meta": meta}, F.col("task.buggy_solution"))
    tasks = (
        rows.where("task_id is not null and (parses is not null or reason is not null)")
        .select("task_id", F.coalesce(F.get_json_object("meta", "$.repo"), F.lit("unknown")).alias("repo"), language_name(F.get_json_object("meta", "$.language")).alias("language"), "parses", F.col("foreign_language").isNotNull().alias("wrong"), F.col("damage").isNotNull().alias("damaged"))
        .groupBy("task_id")
        .agg(F.min(F.struct("repo", "language", "parses", "wrong", "damaged")).alias("t"))
        .select("t.*")
    )
    count = lambda c: F.count_if(c)
    return tasks.groupBy("repo", "language").agg(
        F.count("*").alias("n_files"),
        count(~F.col("parses")).alias("n_unparsed"),
        count(F.col("wrong")).alias("n_wrong_language"),
        count(F.col("damaged")).alias("n_corrupted"),
        count(F.col("parses").isNull()).alias("n_unknown"),
        F.round(count(~F.col("parses")) / F.count("*"), 6).alias("unparsed_rate"),
    )
