"""The engine's queries by name, and SQL that gives the same rows."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maieutic.functions import jsons, prompts, quality, text
from maieutic.operators import batches, curriculum, datasets, scoring, validation
from maieutic.plans import pipeline
from maieutic.plans.oracle import JUDGE_CASES, ORACLE, TASK_CASES
from maieutic.session import ensure_checkpoint_dir, stored
from maieutic.sources import logs, read_table
from maieutic.sources.config import Settings
from maieutic.sources.store import Store

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(*tables: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a function of tables as a query; tables are read whole."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(f)
        def run(spark: SparkSession, root: str) -> DataFrame:
            return f(*(_table(spark, root, t) for t in tables))

        _QUERIES[f.__name__] = run
        return f

    return register


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table; the names ending in ! are without the copies of a record."""
    rows = read_table(spark, root, name.rstrip("!"))
    if not name.endswith("!"):
        return rows
    return batches.one_per(rows, "episode_id" if name.startswith("episodes") else "example_id")


def _episodes(e: DataFrame) -> DataFrame:
    """Episodes as a log: seq, batch, topic, reward and score beside the rest."""
    return e.select("*", F.col("episode_id").alias("seq"), batches.batch_number(F.col("episode_id")).alias("batch_id"), F.col("judge.score").alias("score"), F.col("judge.normalized_reward").alias("reward"))


def _hard(h: DataFrame) -> DataFrame:
    """Hard examples in the order of their episodes."""
    return h.select("*", F.col("metadata.episode_id").alias("seq"), F.col("task.task_id").alias("task_id"))


md5 = F.md5


def r6(c):
    return F.round(c, 6)


# ---- store and logs


@query("episodes!")
def q_episode_count(e):
    return e.agg(F.count("*").alias("n"))


@query("episodes!")
def q_recent_episodes(e):
    return batches.tail(e.select("episode_id", "topic", F.col("judge.normalized_reward").alias("reward")), ["episode_id"], 20)


@query("hard_examples!")
def q_hard_buffer(h):
    return batches.tail(_hard(h).select("seq", "example_id", "reward"), ["seq", "example_id"], 64)


@query("red_rejections!")
def q_rejected_buffer(r):
    return batches.tail(r.select("example_id", "rejection_reason"), ["example_id"], 64)


@query("episodes!")
def q_stored_tail(e):
    """Episodes appended to a store in two goes, and its newest rows read back."""
    rows = e.select("episode_id", "topic", F.col("judge.normalized_reward").alias("reward"))
    store = Store(e.sparkSession, f"{ensure_checkpoint_dir(e.sparkSession).rstrip('/')}/store-{uuid.uuid4().hex}", "json")
    for odd in (0, 1):
        store.append("episodes", rows.where(F.pmod("episode_id", F.lit(2)) == odd))
    return store.last("episodes", rows.schema, "episode_id", 100).withColumn("n", F.lit(store.count("episodes", rows.schema)).cast("long"))


@query("red_rejections!")
def q_rejected_by_reason(r):
    return r.groupBy("rejection_reason").agg(F.count("*").alias("n"), F.count_if(F.col("spec").isNull()).alias("n_without_spec"), r6(F.avg("task_quality")).alias("mean_quality"))


@query("pointers")
def q_latest_pointers(p):
    return batches.newest_per_key(p, "name", "value", "seq")


def _checkpoints(p):
    return p.where("value is not null").select(F.regexp_extract("value", "checkpoints/(\\w+)/", 1).alias("role"), F.regexp_extract("value", "step_(\\d+)", 1).cast("int").alias("step")).distinct()


@query("pointers")
def q_checkpoint_names(p):
    return _checkpoints(p).select("role", "step", batches.checkpoint_name(F.col("role"), F.col("step")).alias("name"))


@query("pointers")
def q_checkpoint_prune(p):
    named = _checkpoints(p).select("role", batches.checkpoint_name(F.col("role"), F.col("step")).alias("name"))
    return batches.pruned(named, "role", "name", 2)


@query("run_log")
def q_log_events(log):
    return logs.parse_lines(log).select("line_no", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"), "level", "event", F.col("payload").isNotNull().alias("readable"), F.get_json_object("payload", "$.episode_id").cast("long").alias("episode_id"))


@query("run_log")
def q_log_event_counts(log):
    return logs.event_counts(logs.distinct_events(logs.parse_lines(log))).select("event", "level", "n", "unreadable")


@query("run_log")
def q_log_gaps(log):
    return logs.gaps(logs.distinct_events(logs.parse_lines(log)))


# ---- texts


@query("episodes!")
def q_line_counts(e):
    return e.select("episode_id", text.filled_line_count(F.col("task.buggy_solution")).alias("n_lines"))


@query("episodes!")
def q_combined_programs(e):
    program = datasets.program_of()
    return e.select("episode_id", F.length(program).alias("n_chars"), md5(program).alias("program_md5"), datasets.failure_of(F.col("task.metadata")).alias("failure"))


@query("episodes!")
def q_grpo_examples(e):
    x = text.grpo_example(F.col("task.statement"), datasets.program_of(), F.get_json_object("task.metadata", "$.observed_failure"))
    return e.select("episode_id", x.alias("x")).select("episode_id", md5("x.problem").alias("problem_md5"), md5("x.code").alias("code_md5"), "x.observed_failure")


@query("episodes!")
def q_split_asserts(e):
    body, checks = text.split_asserts(F.col("task.buggy_solution"))
    return e.select("episode_id", F.size(checks).alias("n_asserts"), md5(body).alias("body_md5"), md5(F.array_join(checks, "\n")).alias("asserts_md5"))


@query("episodes!")
def q_sanitized_hints(e):
    return e.select("episode_id", text.sanitized_hint(F.col("hint.raw_text")).alias("hint_text"))


@query("red_rejections!")
def q_rejected_tails(r):
    return r.select("example_id", text.tail(F.col("rejected_completion"), 160).alias("tail"))


@query("episodes!")
def q_topic_keys(e):
    return e.where("topic is not null").groupBy(text.topic_key(F.col("topic")).alias("topic_key")).agg(F.count("*").alias("n"), F.countDistinct("topic").alias("n_spellings"))


@query("episodes!")
def q_weakness_texts(e):
    m = e.where("topic is not null").groupBy("topic").agg(r6(F.avg("judge.normalized_reward")).alias("m"))
    return m.select("topic", text.weakness_summary(F.col("topic"), F.col("m") + F.lit(0.0000001)).alias("summary"))


def _messages():
    return prompts.chat(("system", "Tutor"), ("user", F.coalesce(F.col("task.statement"), F.lit(""))), ("assistant", F.coalesce(F.col("hint.text"), F.lit(""))))


@query("episodes!")
def q_rendered_chats(e):
    return e.select("episode_id", md5(text.rendered_chat(_messages())).alias("chat_md5"), md5(text.rendered_chat(_messages(), True)).alias("asking_md5"))


@query("episodes!")
def q_chat_parts(e):
    m = _messages()
    return e.select("episode_id", text.user_text(m).alias("user_text"), text.completion_text(F.slice(m, 3, 1)).alias("completion"))


@query("episodes!")
def q_task_json(e):
    j = datasets.task_text()
    at = lambda k: F.get_json_object(j, f"$.{k}").alias(k)
    return e.select("episode_id", at("topic"), at("intended_bug"), at("expected_first_failure"), md5(F.get_json_object(j, "$.buggy_solution")).alias("program_md5"), F.get_json_object(j, "$.metadata.difficulty").alias("difficulty"))


@query("episodes!")
def q_tutor_prompts(e):
    return e.select("episode_id", md5(prompts.tutor_text(F.col("task.statement"), datasets.program_of(), datasets.failure_of(F.col("task.metadata")))).alias("prompt_md5"))


@query("episodes!")
def q_generator_prompts(e):
    topic, focus = F.col("topic"), F.col("metadata.weakness_summary")
    spec = F.when(F.col("task.task_id").isNotNull(), F.concat(F.lit('{"topic": "'), F.coalesce(topic, F.lit("")), F.lit('"}')))
    reasons = F.when(F.col("task.buggy_solution").isNull(), F.array(F.lit("missing buggy_solution"))).otherwise(F.array().cast("array<string>"))
    parts = [prompts.spec_text(topic, focus), prompts.task_text(spec), prompts.repair_text("spec", topic, reasons), prompts.repair_text("task", topic, reasons, spec), prompts.training_text(topic, focus, spec), prompts.hard_example_text(topic, focus, datasets.failure_of(F.col("task.metadata")), spec)]
    return e.select("episode_id", *(md5(p).alias(n) for p, n in zip(parts, ("spec_md5", "task_md5", "spec_repair_md5", "task_repair_md5", "training_md5", "hard_md5"))))


def grading_item():
    """The grader's row of an episode."""
    cut = lambda c, n: F.left(F.coalesce(c, F.lit("")), F.lit(n))
    said = lambda c: F.nullif(c, F.lit(""))
    metadata = F.col("task.metadata")
    return F.struct(
        F.coalesce("topic", F.lit("")).alias("topic"),
        cut(F.col("task.statement"), 600).alias("statement"),
        cut(datasets.program_of(), 2200).alias("buggy_code"),
        cut(datasets.failure_of(metadata), 1200).alias("observed_failure"),
        F.coalesce(said(F.get_json_object(metadata, "$.execution_status")), F.lit("failed")).alias("execution_status"),
        cut(F.coalesce(said(F.col("hint.raw_text")), F.col("hint.text")), 1800).alias("assistant_response"),
    )


@query("episodes!")
def q_grading_prompts(e):
    item = F.struct("episode_id", grading_item().alias("item"))
    b = _episodes(e).groupBy("batch_id").agg(F.array_sort(F.collect_list(item)).alias("items"))  # four rows a batch
    t = prompts.grading_text(F.transform("items", lambda x: x["item"]))
    return b.select("batch_id", F.size("items").alias("n_items"), F.regexp_extract(t, "^N = (\\d+)", 1).cast("int").alias("n_said"), md5(t).alias("prompt_md5"))


# ---- JSON


@query("hard_examples!")
def q_salvaged(h):
    o, a = jsons.object_first(F.col("chosen_completion")), jsons.array_first(F.col("chosen_completion"))
    rows = h.select("example_id", o.alias("o"), a.alias("a"))
    return rows.select("example_id", F.get_json_object("o", "$.target_function").alias("target_function"), F.coalesce(F.startswith("o", F.lit("{")), F.lit(False)).alias("is_object"), F.coalesce(F.startswith("a", F.lit("[")), F.lit(False)).alias("is_array"))


def _specs(h):
    return h.select("example_id", "topic", jsons.object_first(F.col("chosen_completion")).alias("payload"))


@query("hard_examples!")
def q_parsed_specs(h):
    spec, reasons = jsons.parsed_spec(F.col("payload"), F.col("topic"))
    return _specs(h).select("example_id", spec["target_function"].alias("target_function"), spec["intended_bug"].alias("intended_bug"), F.array_join(reasons, "; ").alias("reasons"))


@query("hard_examples!")
def q_parsed_tasks(h):
    task, reasons = jsons.parsed_task(F.col("payload"), F.col("topic"))
    return _specs(h).select("example_id", F.size(task["failing_asserts"]).alias("n_asserts"), F.length(task["buggy_solution"]).alias("n_chars"), task["observed_failure"].alias("observed_failure"), F.array_join(reasons, "; ").alias("reasons"))


def _judged(e):
    return _episodes(e).where(F.col("judge.raw_text").isNotNull()).select("episode_id", "batch_id", "task", "hint", (F.pmod(F.col("episode_id") - 1, F.lit(4))).cast("int").alias("idx"), jsons.array_first(F.col("judge.raw_text")).alias("payload"))


@query("episodes!")
def q_judge_items(e):
    item = F.get(jsons.judge_items(F.col("payload"), 4), F.col("idx"))
    return _judged(e).select("episode_id", item.alias("item")).select("episode_id", F.get_json_object("item", "$.task_quality").cast("double").alias("task_quality"), F.get_json_object("item", "$.score").cast("double").alias("score"))


def _cases(table, cases):
    return table.sparkSession.sql(f"SELECT * FROM VALUES {cases} AS t(case, payload)")


@query("pointers")
def q_task_cases(p):
    """Tasks whose lists of checks are empty, texts or missing."""
    task, reasons = jsons.parsed_task(F.col("payload"), F.lit("T"))
    return _cases(p, TASK_CASES).select("case", F.array_join(task["failing_asserts"], "|").alias("asserts"), task["buggy_solution"].alias("program"), task["red_spec"]["target_function"].alias("target"), F.array_join(reasons, "; ").alias("reasons"))


@query("pointers")
def q_judge_cases(p):
    """Graders' replies whose items are empty, zero, or under another key."""
    return _cases(p, JUDGE_CASES).select("case", F.array_join(jsons.judge_items(F.col("payload"), 2), "|").alias("items"))


@query("episodes!")
def q_fanned_out(e):
    """The one reply to each batch, handed out to the batch's requests."""
    log = _episodes(e).where(F.col("judge.raw_text").isNotNull())
    requests = log.select("episode_id", "batch_id", (F.row_number().over(Window.partitionBy("batch_id").orderBy("episode_id")) - 1).alias("idx"))
    replies = log.groupBy("batch_id").agg(F.min_by("judge.raw_text", "episode_id").alias("raw_text"))
    item = pipeline.fan_out(requests, replies).select("episode_id", "idx", "item")
    return item.select("episode_id", "idx", F.when(F.startswith("item", F.lit("{")), F.get_json_object("item", "$.score")).otherwise(F.col("item")).cast("double").alias("score"))


@query("red_rejections!")
def q_metadata_specs(r):
    meta = F.to_json(F.struct(F.struct(F.col("spec.topic"), F.col("spec.target_function"), F.col("spec.intended_bug"), F.col("spec.expected_first_failure")).alias("red_spec")))
    s = jsons.spec_of_metadata(meta, F.col("topic"))
    return r.select("example_id", s["topic"].alias("topic"), s["target_function"].alias("target_function"), s["intended_bug"].alias("intended_bug"), s["expected_first_failure"].alias("expected_first_failure"))


# ---- validation


@query("episodes!")
def q_rejection_reasons(e):
    status = F.when(F.get_json_object("task.metadata", "$.observed_failure") == "", "passed").otherwise("failed")
    r = validation.rejection_reasons(F.col("task.task_id"), F.col("task.topic"), F.col("topic"), F.col("task.buggy_solution"), status)
    return e.select("episode_id", F.array_join(r, "; ").alias("reasons"))


@query("red_rejections!")
def q_rejections_with_text(r):
    return validation.with_text(r, "rejected_completion").select("example_id", F.length(text.strip(F.col("rejected_completion"))).alias("n_chars"))


@query("episodes!")
def q_judge_gate(e):
    rows = e.select("episode_id", F.get_json_object("judge.metadata", "$.valid").cast("boolean").alias("valid"))
    good, bad = validation.gated(rows, "valid")
    return good.select("episode_id", F.lit("episode").alias("goes_to")).unionByName(bad.select("episode_id", F.lit("rejected").alias("goes_to")))


@query("documents")
def q_corruption(d):
    # Every seventh text gets damage of each kind, so that all rules are met.
    marks = [" \U0001f600", " 汉字", " Привет", " سلام", " â€™", " �", " Traceback encode"]
    t = F.col("text")
    for i, m in enumerate(marks):
        t = F.when(F.pmod("doc_id", F.lit(7)) == i, F.concat(F.col("text"), F.lit(m))).otherwise(t)
    return d.select("doc_id", F.array_join(quality.corruption(t), "; ").alias("reasons"))


@query("episodes!")
def q_compile_failures(e):
    failure = datasets.failure_of(F.col("task.metadata"))
    return e.select("episode_id", quality.error_name(failure).alias("error_name"), quality.fails_to_compile(quality.error_name(failure), failure).alias("fails_to_compile"))


@query("hard_examples!")
def q_update_gate(h):
    few = h.where("reward < 0.05")
    return datasets.update_gate(h, 8).withColumn("gate", F.lit("all")).unionByName(datasets.update_gate(few, 1_000_000).withColumn("gate", F.lit("few")))


# ---- hints


@query("episodes!")
def q_identifiers(e):
    own = F.array_sort(quality.own_identifiers(F.col("hint.text")))
    return e.select("episode_id", F.size(quality.identifiers(F.col("hint.text"))).alias("n_all"), F.array_join(own, " ").alias("own"), md5(quality.assert_context(F.col("task.failing_asserts"))).alias("checks_md5"))


def _context():
    return quality.hint_context(datasets.program_of(), datasets.failure_of(F.col("task.metadata")), F.col("task.failing_asserts"), F.get_json_object("task.metadata", "$.red_spec.target_function"), F.get_json_object("task.metadata", "$.execution_status"))


@query("episodes!")
def q_foreign_identifiers(e):
    rows = e.select("episode_id", F.col("hint.raw_text").alias("h"), _context().alias("c"))
    return rows.select("episode_id", F.array_join(quality.foreign_identifiers(F.col("h"), F.col("c.allowed")), " ").alias("foreign"))


@query("episodes!")
def q_hint_quality(e):
    rows = quality.with_quality(e.select("episode_id", F.col("hint.raw_text").alias("h"), "task"), "h", _context(), "q")
    return rows.select("episode_id", r6(F.col("q.delta")).alias("delta"), F.col("q.severe").alias("severe"), F.array_join("q.reasons", "; ").alias("reasons"))


@query("episodes!")
def q_weighted_scores(e):
    w = {"bug_localization": 0.25, "usefulness": 0.25, "socratic_style": 0.2, "correctness": 0.2, "clarity": 0.1}
    return e.select("episode_id", r6(scoring.weighted_score(F.col("judge.criteria_scores"), w)).alias("weighted"))


@query("episodes!")
def q_assessments(e):
    item = F.get(jsons.judge_items(F.col("payload"), 4), F.col("idx"))
    rows = _judged(e).select("episode_id", item.alias("item")).select("episode_id", scoring.assessment(F.col("item"), 6.0).alias("a"))
    return rows.select("episode_id", F.col("a.task_quality").alias("task_quality"), F.col("a.task_valid").alias("task_valid"), F.col("a.hint_valid").alias("hint_valid"))


@query("episodes!")
def q_batch_spread(e):
    rows = _episodes(e).where("score is not null")
    return rows.select("episode_id", "batch_id", r6(scoring.spread(F.col("score"), ["batch_id"])).alias("spread_score"))


def _graded_item():
    """The grader's item of a row, with its one score under every criterion."""
    item = F.get(jsons.judge_items(F.col("payload"), 4), F.col("idx"))
    score = F.get_json_object(item, "$.score")
    return F.to_json(F.struct(*(score.alias(k) for k in scoring.WEIGHTS), F.get_json_object(item, "$.task_quality").alias("task_quality")))


@query("episodes!")
def q_judged_batches(e):
    """Judged batches taken apart into numbered episodes, of which the hardest are mined, and rejections."""
    rows = _judged(e).select("batch_id", "idx", F.col("task.topic").alias("topic"), "task", "hint", _graded_item().alias("item"))
    found = pipeline.judged(rows, _context(), Settings({"any": 1.0}))
    kept = found.episodes.select("batch_id", "idx", F.lit("episode").alias("goes_to"), "episode_id", r6("reward").alias("reward"), "is_hard")
    lost = found.rejections.select("batch_id", "idx", F.lit("rejected").alias("goes_to"), F.lit(None).cast("long").alias("episode_id"), F.lit(None).cast("double").alias("reward"), F.lit(None).cast("boolean").alias("is_hard"))
    return kept.unionByName(lost)


@query("episodes!")
def q_evaluated(e):
    """Items of the graders' replies, assembled with what the hints show, and spread in their batches."""
    named = _graded_item()
    rows = _judged(e).select("episode_id", "batch_id", "task", named.alias("item"), F.coalesce(F.nullif("hint.raw_text", F.lit("")), F.col("hint.text")).alias("h"))
    out = scoring.assemble(rows, ["batch_id"], "item", "h", _context())
    return out.select("episode_id", r6("model_score").alias("model_score"), r6("score").alias("score"), r6("adjusted_score").alias("adjusted_score"), "task_valid", "hint_valid")


@query("episodes!")
def q_scored_pairs(e):
    """The same from rendered prompts alone, as a trainer's reward function sees them; a bare number grades each."""
    prompt = prompts.tutor_text(F.col("task.statement"), datasets.program_of(), datasets.failure_of(F.col("task.metadata")))
    rows = _episodes(e).select("episode_id", "batch_id", prompt.alias("p"), F.coalesce("score", F.lit(0.0)).cast("string").alias("item"), F.coalesce("hint.text", F.lit("")).alias("h"))
    out = scoring.assemble(rows, ["batch_id"], "item", "h", quality.prompt_context(F.col("p")))
    return out.select("episode_id", r6("adjusted_score").alias("adjusted_score"), F.array_join("quality.reasons", "; ").alias("reasons"))


# ---- curriculum


def _replayed(e):
    return curriculum.replay(_episodes(e), "seq", "topic", "reward")


def _topics(e):
    return e.where("topic is not null").select("topic").distinct()


@query("episodes!")
def q_ema_replay(e):
    return _replayed(e).select("seq", "topic", "run", "reset", "epoch", F.round("ema", 9).alias("ema"), F.round("weight", 9).alias("weight"))


@query("episodes!")
def q_curriculum_state(e):
    return curriculum.latest_state(_replayed(e), _topics(e)).select("topic", F.round("ema", 9).alias("ema"), F.round("weight", 9).alias("weight"), "resets")


def _configured(e):
    """Topics with first weights, as a configuration would give them."""
    return _topics(e).withColumn("weight", F.lit(0.5) + F.pmod(F.length("topic"), F.lit(4)) / 4)


@query("episodes!")
def q_weighted_replay(e):
    r = curriculum.replay(_episodes(e), "seq", "topic", "reward", weights=_configured(e))
    return r.select("seq", "topic", F.round("weight", 9).alias("weight"))


@query("episodes!")
def q_resumed_state(e):
    """The log in two runs, the second of which goes on from the state that the first one left."""
    log, topics = _episodes(e), _configured(e)
    earlier = F.col("seq") <= 300
    begun = stored(curriculum.replay(log.where(earlier), "seq", "topic", "reward", weights=topics))
    left = curriculum.saved_state(begun, topics)
    went_on = stored(curriculum.replay(log.where(~earlier), "seq", "topic", "reward", weights=topics, saved=left))
    return curriculum.latest_state(went_on, topics, saved=left).select("topic", F.round("ema", 9).alias("ema"), F.round("weight", 9).alias("weight"), "resets")


@query("episodes!")
def q_weakest_topic(e):
    return curriculum.weakest(curriculum.latest_state(_replayed(e), _topics(e)).withColumn("ema", F.round("ema", 9))).select("topic", "ema")


@query("episodes!")
def q_boosted_weights(e):
    topics = _topics(e)
    r = stored(_replayed(e))
    boosts = curriculum.focus_boosts(r, sorted(x.topic for x in topics.collect()))  # the configured topics of the run
    return curriculum.boosted_weights(r, boosts, topics).select("topic", F.round("weight", 6).alias("weight"))


@query("episodes!")
def q_recent_topics(e):
    return curriculum.recent_topics(_replayed(e))


@query("episodes!")
def q_sampled_topics(e):
    return curriculum.sampled_topics(e, "episode_id", curriculum.latest_state(_replayed(e), _topics(e))).groupBy("topic").agg(F.count("*").alias("n"))


# ---- datasets


@query("episodes!")
def q_dense_batches(e):
    n = batches.numbered(e.where(F.get_json_object("judge.metadata", "$.valid") == "true").select("episode_id"), ["episode_id"], "number")
    return n.select("episode_id", "number", batches.batch_number(F.col("number")).alias("batch_id"))


@query("episodes!")
def q_hard_mining(e):
    rows = _episodes(e).where("score is not null").withColumn("reward", r6(scoring.spread(F.col("score"), ["batch_id"]) / 10))
    return batches.hardest(rows, ["batch_id"], "reward", "episode_id").select("batch_id", "episode_id", "topic", "reward")


@query("hard_examples!")
def q_sft_texts(h):
    return datasets.sft_texts(_hard(h).where("seq is not null")).select("position", md5("text").alias("text_md5"))


def _recent(e, n=256):
    return batches.tail(_episodes(e), ["seq"], n)


@query("episodes!")
def q_fallback_examples(e):
    return datasets.fallback_examples(_recent(e), 8).select("example_id", "topic", "task_id", "reward", md5("prompt").alias("prompt_md5"))


@query("episodes!", "hard_examples!")
def q_topped_up(e, h):
    few = batches.tail(_hard(h), ["seq", "example_id"], 3)
    return datasets.topped_up(few, _recent(e)).select("example_id", "task_id", "reward")


@query("episodes!")
def q_easiest(e):
    return datasets.easiest(_episodes(e), "topic", "reward", "seq")[0].select("topic", F.col("seq").alias("episode_id"), "reward")


@query("hard_examples!", "red_rejections!", "episodes!")
def q_preference_pairs(h, r, e):
    rejected = r.select("*", F.col("example_id").alias("seq"))  # the table keeps no order of its own
    p = datasets.preference_pairs(_hard(h).where("seq is not null"), rejected, _recent(e))
    return p.select("part", "position", md5("prompt").alias("prompt_md5"), md5("chosen").alias("chosen_md5"), md5("rejected").alias("rejected_md5"))


@query("episodes!")
def q_tutor_dataset(e):
    return datasets.tutor_prompts(_episodes(e)).select("seq", md5(text.user_text(F.col("prompt"))).alias("user_md5"), F.size("prompt").alias("n_messages"))


@query("episodes!")
def q_zipped_batches(e):
    rows = _episodes(e).select("batch_id", F.pmod(F.col("episode_id") - 1, F.lit(4)).cast("int").alias("idx"), "episode_id", F.col("hint.task_id").alias("hint_task"), F.col("task.task_id").alias("task_id"))
    return datasets.zipped(rows.select("batch_id", "idx", "task_id"), rows.select("batch_id", "idx", "hint_task"), "batch_id", "idx").select("batch_id", "idx", "task_id", (F.col("task_id") == F.col("hint_task")).alias("agrees"))


@query("episodes!")
def q_episode_debug(e):
    rows = _episodes(e)
    return rows.select("episode_id", "batch_id", "topic", F.col("task.task_id").alias("task_id"), text.filled_line_count(F.col("task.buggy_solution")).alias("n_lines"), datasets.failure_of(F.col("task.metadata")).alias("failure"), F.length("hint.text").alias("n_hint"), "score", r6("reward").alias("reward"), F.col("metadata.red_adapter").alias("red_adapter"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLE.items() if k in _QUERIES}
