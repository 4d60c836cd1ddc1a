"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maieutic.llm import leaks, neardup, packing, pairs, subjects, syntax, topn, truncation
from maieutic.sources import read_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    similar = neardup.similar_tasks(read_table(spark, root, "episodes")).pairs()
    return similar.select(F.col("a").alias("task_id_a"), F.col("b").alias("task_id_b"))


def p1_classes(spark: SparkSession, root: str) -> DataFrame:
    return neardup.similar_tasks(read_table(spark, root, "episodes")).classes().withColumnRenamed("id", "task_id")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return pairs.found_pairs(read_table(spark, root, "hard_examples"), read_table(spark, root, "episodes"))


def p2_counts(spark: SparkSession, root: str) -> DataFrame:
    return pairs.defect_counts(read_table(spark, root, "hard_examples"), read_table(spark, root, "episodes"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return topn.top_examples(read_table(spark, root, "hard_examples")).select("topic_key", "example_id")


def p3_ranked(spark: SparkSession, root: str) -> DataFrame:
    return topn.top_examples(read_table(spark, root, "hard_examples")).select("topic_key", "example_id", "rank", "score")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return truncation.judged_texts(read_table(spark, root, "episodes")).where("is_cut").select("field_name", "episode_id").distinct()


def p4_rates(spark: SparkSession, root: str) -> DataFrame:
    return truncation.cut_rates(truncation.judged_texts(read_table(spark, root, "episodes")))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return syntax.unparsed_tasks(read_table(spark, root, "episodes"))


def p5_rates(spark: SparkSession, root: str) -> DataFrame:
    return syntax.parse_rates(read_table(spark, root, "episodes"))


def p6_containers(spark: SparkSession, root: str) -> DataFrame:
    return packing.packed_documents(read_table(spark, root, "documents"), read_table(spark, root, "container_sizes"))


def p6_fill(spark: SparkSession, root: str) -> DataFrame:
    sizes = read_table(spark, root, "container_sizes")
    return packing.fill_report(packing.packed_documents(read_table(spark, root, "documents"), sizes), sizes)


def p6_bucket_fill(spark: SparkSession, root: str) -> DataFrame:
    sizes = read_table(spark, root, "container_sizes")
    return packing.fill_report(packing.packed_documents(read_table(spark, root, "documents"), sizes, "in_buckets"), sizes)


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return leaks.leaks(read_table(spark, root, "documents"), read_table(spark, root, "heldout_items")).select("doc_id", "item_id")


def p7_report(spark: SparkSession, root: str) -> DataFrame:
    return leaks.leak_report(read_table(spark, root, "documents"), read_table(spark, root, "heldout_items"))


def _subjects(spark: SparkSession, root: str) -> DataFrame:
    return subjects.document_subjects(*(read_table(spark, root, t) for t in ("documents", "subject_list", "subject_labels")))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return _subjects(spark, root).select("doc_id", "subject").distinct()


def p8_mixture(spark: SparkSession, root: str) -> DataFrame:
    return subjects.corpus_mixture(_subjects(spark, root))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k.startswith("p") and k[1:2].isdigit()}


_P3 = r"""
WITH one AS (
  SELECT example_id, key, reward, episode_id FROM (
    SELECT example_id, trim(regexp_replace(lower(replace(topic, '_', ' ')), '\s+', ' ', 'g')) AS key, reward, metadata.episode_id AS episode_id,
      row_number() OVER (PARTITION BY example_id ORDER BY topic, reward, metadata.episode_id) AS copy
    FROM hard_examples WHERE example_id IS NOT NULL) WHERE copy = 1),
ranked AS (
  SELECT key AS topic_key, example_id, reward AS score,
    row_number() OVER (PARTITION BY key ORDER BY reward DESC, episode_id NULLS LAST, example_id) AS rank
  FROM one WHERE key IS NOT NULL AND reward IS NOT NULL)
"""


_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
_P1 = rf"""
WITH t AS (SELECT task.task_id AS id, any_value(coalesce(task.statement, '') || chr(10) || coalesce(task.buggy_solution, '')) AS x FROM episodes WHERE task.task_id IS NOT NULL GROUP BY 1),
w AS (SELECT id, {_WORDS.format("x")} AS ws FROM t),
s AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) AS g FROM w),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
SELECT a AS task_id_a, b AS task_id_b FROM p JOIN n AS x ON x.id = a JOIN n AS y ON y.id = b WHERE 2 * c >= x.n + y.n - c
"""
_P7 = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
i AS (SELECT item_id, {_WORDS.format("t")} AS ws FROM (SELECT item_id, unnest([statement, reference_hint]) AS t FROM heldout_items) WHERE t IS NOT NULL AND item_id IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ws) - 10), lambda k: array_to_string(ws[k:k + 11], ' '))) AS g FROM d),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(ws) - 10), lambda k: array_to_string(ws[k:k + 11], ' '))) AS g FROM i),
h AS (SELECT doc_id, item_id, count(*) AS n FROM dg JOIN ig USING (g) GROUP BY 1, 2)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1,
        "p7_found": _P7 + "SELECT doc_id, item_id FROM h",
        "p7_report": _P7 + "SELECT x.item_id, x.topic, count(h.doc_id) AS n_documents, coalesce(max(h.n), 0) AS most_passages FROM (SELECT item_id, min(topic) AS topic FROM heldout_items GROUP BY 1) AS x LEFT JOIN h USING (item_id) GROUP BY 1, 2",
        "p3_found": _P3 + "SELECT topic_key, example_id FROM ranked WHERE rank <= 3",
        "p3_ranked": _P3 + "SELECT topic_key, example_id, CAST(rank AS INTEGER) AS rank, score FROM ranked WHERE rank <= 3",
    }
