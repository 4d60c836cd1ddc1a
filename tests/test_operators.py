"""Scoring, curriculum, mining, data sets and sources on golden values and small folds."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from maieutic.functions import prompts, quality
from maieutic.operators import batches, curriculum, datasets, generate, scoring, validation
from maieutic.sources import logs
from maieutic.sources.config import settings
from maieutic.sources.store import Store


def spread(spark, scores, strength=0.15):
    df = spark.createDataFrame([(i, 0, float(s)) for i, s in enumerate(scores)], "i int, b int, s double")
    return [r.y for r in df.withColumn("y", scoring.spread(F.col("s"), ["b"], strength)).orderBy("i").collect()]


def test_spread_golden(spark):
    assert spread(spark, [10, 10, 10, 9.65]) == pytest.approx([10, 10, 10, 9.130384757729338], abs=1e-12)
    assert spread(spark, [10]) == [10] and spread(spark, [5, 5]) == [5, 5] and spread(spark, [1, 9], 0) == [1, 9]


def test_criteria_and_weighted_score(spark):
    items = ['{"a": 20, "b": "3"}', '{"a": null, "b": "x"}', "7", "oops", "-1"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string").select("i", scoring.criteria(F.col("x"), ["a", "b"]).alias("c"))
    got = [r.c for r in df.orderBy("i").collect()]
    assert got == [{"a": 10, "b": 3}, {"a": 0, "b": 0}, {"a": 7, "b": 7}, {"a": 0, "b": 0}, {"a": 0, "b": 0}]
    w = df.select("i", scoring.weighted_score(F.col("c"), {"a": 1.0, "b": 3.0}).alias("w"), scoring.weighted_score(F.col("c"), {"a": -1.0, "b": 0.0}).alias("z")).orderBy("i").first()
    assert w.w == pytest.approx((10 + 9) / 4) and w.z == 0


def test_assessment(spark):
    items = ['{"task_quality": 3}', '{"task_quality": 3.1}', '{"task_quality": 1, "task_is_valid_for_socratic": "false"}', '{"task_is_valid_for_socratic": false, "red_rejection_reason": " r "}', '{"use_for_socratic": false}', "4"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string").select("i", scoring.assessment(F.col("x")).alias("a"))
    a = [r.a for r in df.orderBy("i").collect()]
    assert [x.task_valid for x in a] == [False, True, False, False, True, True]
    assert a[3].task_reason == "r" and [x.hint_valid for x in a] == [True, True, True, True, False, True]


def test_assembled_precedence(spark):
    item = '{"no_solution_reveal": 8, "bug_localization": 8, "usefulness": 8, "socratic_style": 8, "technical_accuracy": 8%s}'
    rows = [(0, item % "", "Why?"), (0, item % "", "汉"), (0, item % ', "task_is_valid_for_socratic": false', "Why?"), (0, item % ', "hint_is_valid_for_socratic": false', "Why?")]
    from maieutic.functions import quality

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, b int, item string, h string")
    context = quality.hint_context(F.lit("x = 1"), F.lit("ValueError"), F.array().cast("array<string>"), F.lit(""), F.lit("failed"))
    got = scoring.assemble(df, ["b"], "item", "h", context).orderBy("i").collect()
    assert [round(r.score, 6) for r in got] == [8.0, 0.0, 0.0, 2.5]
    assert got[1].adjusted_score == 0 and got[2].adjusted_score == 0 and not got[1].hint_valid and got[1].criteria["usefulness"] == 0
    assert got[0].adjusted_score > got[0].score and got[3].adjusted_score != got[3].score


def fold(log, c=curriculum.Curriculum()):
    """The replay, one episode after the other."""
    ema, out, last, run, epoch = {}, [], None, 0, 0
    for s, t, r in log:
        run = run + 1 if t == last else 1
        last = t
        ema[t] = (1 - c.alpha) * ema.get(t, c.first) + c.alpha * max(0.0, min(1.0, r))
        reset = run == c.reset_after
        if reset:
            out.append((s, True, epoch, c.first, 1.0))
            ema, last, run, epoch = {}, None, 0, epoch + 1
        else:
            out.append((s, False, epoch, ema[t], max(c.least_weight, 1 + c.low_reward_boost * max(0.0, 1 - ema[t]))))
    return out


@pytest.mark.parametrize("rows_per_part", [7, 50, 10_000])
def test_replay_equals_a_sequential_fold(spark, rows_per_part):
    rng = random.Random(5)
    log = [(i, rng.choice("aaab"), rng.uniform(-0.2, 1.2)) for i in range(1, 200)] + [(i, "c", 1.0) for i in range(200, 217)]
    df = spark.createDataFrame(log + [(500, None, 1.0), (501, "a", None)], "seq long, topic string, reward double")
    got = curriculum.replay(df, "seq", "topic", "reward", rows_per_part=rows_per_part).orderBy("seq").collect()
    want = fold(log)
    assert [(r.seq, r.reset, r.epoch) for r in got] == [w[:3] for w in want]
    assert [r.ema for r in got] == pytest.approx([w[3] for w in want], abs=1e-12)
    assert [r.weight for r in got] == pytest.approx([w[4] for w in want], abs=1e-12)


def test_replay_golden_and_empty(spark):
    df = spark.createDataFrame([(1, "t", 1.0), (2, "u", 0.9130384757729338)], "seq long, topic string, reward double")
    got = curriculum.replay(df, "seq", "topic", "reward").orderBy("seq").collect()
    assert got[0].ema == pytest.approx(0.6) and got[0].weight == pytest.approx(1.6)
    assert got[1].ema == pytest.approx(0.5826076951545868) and got[1].weight == pytest.approx(1.6260884572681198)
    assert curriculum.replay(df.limit(0), "seq", "topic", "reward").count() == 0


@pytest.mark.parametrize("rows_per_part,seed", [(10_000, 8), (13, 8), (29, 2)])
def test_focus_boosts_and_weights(spark, rows_per_part, seed):
    rng = random.Random(seed)
    c, names = curriculum.Curriculum(), ["a", "b", "c", "d"]
    log = [(i, rng.choice(names[:3] * 3 + ["d"]), rng.random()) for i in range(1, 121)]
    ema, w, last, run, boosts = {n: 0.5 for n in names}, {n: 1.0 for n in names}, None, 0, []
    for n, (s, t, r) in enumerate(log, 1):
        run = run + 1 if t == last else 1
        last = t
        ema[t] = 0.8 * ema[t] + 0.2 * r
        w[t] = 1 + 1.5 * (1 - ema[t])
        if run == 5:
            ema, w, last, run = {n: 0.5 for n in names}, {n: 1.0 for n in names}, None, 0
        if n % 8 == 0:
            weak = min(names, key=lambda x: (ema[x], x))
            w[weak] *= 1.15
            boosts.append((n // 8, weak))
    df = spark.createDataFrame(log, "seq long, topic string, reward double")
    topics = spark.createDataFrame([(n,) for n in names], "topic string")
    r = curriculum.replay(df, "seq", "topic", "reward", rows_per_part=rows_per_part).cache()
    got = curriculum.focus_boosts(r, names)
    assert [(x.iteration, x.topic) for x in got.orderBy("iteration").collect()] == boosts
    weights = {x.topic: x.weight for x in curriculum.boosted_weights(r, got, topics).collect()}
    assert weights == pytest.approx(w, rel=1e-9)


def test_weakest_and_sampled_topics(spark):
    state = spark.createDataFrame([("b", 0.5, 1.0), ("a", 0.5, 3.0), ("c", 0.9, 0.0)], "topic string, ema double, weight double")
    assert curriculum.weakest(state).first().topic == "a"
    n = {r.topic: r["count"] for r in curriculum.sampled_topics(spark.range(4000).toDF("id"), "id", state).groupBy("topic").count().collect()}
    assert n["a"] / 4000 == pytest.approx(0.75, abs=0.04) and n.get("c", 0) < 10


def test_hardest(spark):
    for n, keep in ((4, 1), (5, 2), (1, 1)):
        df = spark.createDataFrame([(0, i, 0.5) for i in range(n)], "b int, id long, r double")
        got = batches.hardest(df, ["b"], "r", "id").orderBy("id").collect()
        assert [x.id for x in got] == list(range(keep))


def test_numbered_without_one_window(spark):
    df = spark.createDataFrame([(i * 3,) for i in range(100)], "k long")
    got = batches.numbered(df, ["k"], "n", rows_per_part=9).orderBy("k").collect()
    assert [r.n for r in got] == list(range(1, 101))
    assert batches.numbered(df.limit(0), ["k"], "n").count() == 0


def test_tails_pointers_and_pruning(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "s long")
    assert [r.s for r in batches.tail(df, ["s"], 2).collect()] == [4, 3] and batches.tail(df, ["s"], 0).count() == 0
    p = spark.createDataFrame([("a", "x", 1), ("a", None, 2), ("b", "y", 1), (None, "z", 9)], "name string, value string, seq long")
    assert {r.name: r.value for r in batches.newest_per_key(p, "name", "value", "seq").collect()} == {"a": None, "b": "y"}
    names = spark.createDataFrame([("r", f"step_{i:06d}") for i in range(4)], "role string, name string")
    assert sorted(r.name for r in batches.pruned(names, "role", "name", 3).collect()) == ["step_000000"]
    assert batches.pruned(names, "role", "name", 0).count() == 0


def episodes(spark, rows):
    """(number, topic, reward) as episodes."""
    kind = "episode_id long, seq long, topic string, reward double, task struct<task_id string, topic string, statement string, buggy_solution string, failing_asserts array<string>, metadata string>, metadata struct<weakness_summary string>"
    return spark.createDataFrame([(i, i, t, r, (f"t{i}", t, f"s{i}", f"x = {i}", [], "{}"), ("w",)) for i, t, r in rows], kind)


def test_preference_pairs(spark):
    recent = episodes(spark, [(1, "a", 0.9), (2, "a", 0.9), (3, "b", 0.4)])
    easy = {r.topic: r.task for r in datasets.easiest(recent, "topic", "reward", "seq")[0].collect()}
    assert "s1" in easy["a"]
    hard = spark.createDataFrame([(1, "a", "p1", "c1", 0.2), (2, "z", "p2", "c2", 0.1), (3, "b", "p3", easy["b"], 0.3)], "seq long, topic string, prompt string, chosen_completion string, reward double")
    rejected = spark.createDataFrame([(1, "a", "q1", " "), (2, "b", "q2", "bad"), (3, None, "q3", "worse")], "seq long, topic string, prompt string, rejected_completion string")
    got = datasets.preference_pairs(hard, rejected, recent, limit=5).orderBy("part", "position").collect()
    assert [(r.part, r.prompt) for r in got] == [(1, "p2"), (1, "p1"), (2, "q2"), (2, "q3")]
    assert got[0].rejected == easy["a"] and got[2].chosen == easy["b"] and got[3].chosen == easy["a"]
    assert all(r.chosen != r.rejected for r in got)
    assert datasets.preference_pairs(hard, rejected, recent, limit=1).count() == 1
    assert datasets.preference_pairs(hard, rejected, recent.limit(0)).count() == 0


def test_topped_up_and_gate(spark):
    recent = episodes(spark, [(i, "a", i / 10) for i in range(1, 8)])
    hard = spark.createDataFrame([("h", "a", "t7", "p", "c", 0.1, 1)], "example_id string, topic string, task_id string, prompt string, chosen_completion string, reward double, seq long")
    got = datasets.topped_up(hard, recent, least=4)
    assert sorted(r.example_id for r in got.collect()) == ["h", "recent_5", "recent_6"]
    assert datasets.update_gate(got, 4).first().reason == "need_4_chosen_examples_have_3"
    assert datasets.update_gate(got, 3).first().reason is None


def test_rejection_draws_are_stable_and_fair(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    share = df.select(F.avg(validation.drawn(F.col("k"), "short", 0.3).cast("int"))).first()[0]
    assert share == pytest.approx(0.3, abs=0.03)
    a = df.where(validation.drawn(F.col("k"), "short", 0.3)).count()
    assert a == df.repartition(7).where(validation.drawn(F.col("k"), "short", 0.3)).count()


def test_store(spark, tmp_path):
    for kind in ("parquet", "json"):
        s = Store(spark, str(tmp_path / kind), kind)
        rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "ü")], "seq long, x string")
        assert s.count("t", rows.schema) == 0 and s.load_state("c", rows.schema).count() == 0
        s.append("t", rows)
        s.append("t", rows.where("seq = 1").withColumn("seq", F.lit(4).cast("long")))
        assert s.count("t", rows.schema) == 4
        assert [r.x for r in s.last("t", rows.schema, "seq", 2).collect()] == ["a b", "ü"]
        assert s.last("t", rows.schema, "seq", 0).count() == 0 and s.buffer("t", rows.schema, "seq", 3).count() == 3
        s.save_state("c", rows)
        s.save_state("c", rows.limit(1))
        assert s.load_state("c", rows.schema).count() == 1
        p = spark.createDataFrame([("n", "v1", 1), ("n", "v2", 2)], "name string, value string, seq long")
        s.append("p", p)
        assert s.pointers("p", p.schema).first().value == "v2"
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path), "csv")


def test_log_lines(spark, tmp_path):
    lines = ["2025-03-03 11:06:40,007 | INFO | a_b | {\"x\": 1}", "2025-03-03 11:06:41,000 | WARNING | a_b | not json", "no event", "", "2025-99-03 11:06:40,007 | INFO | z | {}"]
    (tmp_path / "run.log").write_text("\n".join(lines))
    got = logs.read_log(spark, str(tmp_path / "run.log")).orderBy("event", "ts").collect()
    assert [(r.event, r.level, r.payload) for r in got] == [("a_b", "INFO", '{"x": 1}'), ("a_b", "WARNING", None), ("z", "INFO", "{}")]
    assert got[0].ts.microsecond == 7000 and got[2].ts is None
    assert logs.gaps(logs.read_log(spark, str(tmp_path / "run.log"))).where("event = 'a_b'").first().max_gap_s == pytest.approx(0.993)


def test_log_gaps_over_midnight(spark):
    at = ["2025-03-03 23:59:50", "2025-03-03 23:59:58", "2025-03-04 00:00:08", "2025-03-07 00:00:08", "2025-03-07 00:00:08"]
    rows = [(i, t, "a") for i, t in enumerate(at)] + [(9, "2025-03-03 12:00:00", "rare"), (8, "2025-03-05 12:00:00", "rare"), (7, "2025-03-05 12:00:00", "once"), (6, None, "rare")]
    events = spark.createDataFrame(rows, "line_no long, ts string, event string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.event: (r.n, r.mean_gap_s, r.max_gap_s) for r in logs.gaps(events).collect()}
    assert got == {"a": (4, (8 + 10 + 3 * 86400) / 4, 3 * 86400.0), "rare": (1, 2 * 86400.0, 2 * 86400.0), "once": (0, None, None)}
    assert got == {r.event: (r.n, r.mean_gap_s, r.max_gap_s) for r in logs.gaps(events, "hour").collect()}


def test_settings():
    s = settings({"curriculum": {"topics": [{"name": "a", "weight": 2}, "b"]}, "judge": {"reward_weights": {"usefulness": 1, "other": 3}, "episode_batch_size": "6"}, "unknown": 1})
    assert s.topics == {"a": 2.0, "b": 1.0} and s.reward_weights == {"usefulness": 1.0} and s.episode_batch_size == 6
    with pytest.raises(ValueError):
        settings({"topics": []})
    with pytest.raises(TypeError):
        settings([1])


def test_generators_and_retries(spark):
    asks = spark.createDataFrame([(1, "a"), (2, "b\nc"), (3, None)], "id long, p string")
    assert {r.id: r.answer for r in generate.generated(asks, "id", "p", "tutor").collect()} == {1: "[tutor] a", 2: "[tutor] c", 3: "[tutor] "}
    told = spark.createDataFrame([("a", "A")], "prompt string, answer string")
    assert {r.id: r.answer for r in generate.replayed(asks, told, "id", "p").collect()} == {1: "A", 2: None, 3: None}
    answers = lambda df, i: df.select("id", (F.col("id") <= i).alias("ok"))
    done, failed = generate.with_retries(asks, "id", answers, F.col("ok"), 2)
    assert sorted((r.id, r.attempt) for r in done.collect()) == [(1, 1), (2, 2)]
    assert sorted((r.id, r.attempt) for r in failed.collect()) == [(2, 1), (3, 1), (3, 2)]


def test_execution_is_off_unless_enabled(spark):
    tasks = spark.createDataFrame([(1, "print('x' * 5000)"), (2, "assert 1 == 2"), (3, "while True: pass")], "id long, p string")
    with pytest.raises(PermissionError):
        generate.executed(tasks, "id", F.col("p"))
    got = {r.id: r for r in generate.executed(tasks, "id", F.col("p"), enabled=True, timeout=1.0).collect()}
    assert got[1].status == "passed" and len(got[1].stdout) == 1600
    assert got[2].status == "failed" and "AssertionError" in got[2].error_message
    assert got[3].status == "timeout" or got[3].returncode != 0


def test_mining_count_is_a_ceiling():
    assert [max(1, math.ceil(n * 0.25)) for n in (1, 4, 5, 8)] == [1, 1, 2, 2]


def test_settings_from_yaml(tmp_path):
    pytest.importorskip("yaml")
    from maieutic.sources.config import load_settings

    path = tmp_path / "run.yaml"
    path.write_text("runtime:\n  iteration_size: 4\ntask_execution:\n  capture_max_chars: 99\n  max_red_generation_attempts: 7\ncurriculum:\n  topics:\n    - name: A\n      weight: 2\n    - B\n", encoding="utf-8")
    s = load_settings(str(path))
    assert (s.iteration_size, s.max_capture_chars, s.max_attempts, dict(s.topics)) == (4, 99, 7, {"A": 2.0, "B": 1.0})


def test_replay_with_weights_and_from_a_stored_state(spark):
    rng = random.Random(9)
    c, base = curriculum.Curriculum(), {"a": 2.0, "b": 0.25, "c": 1.0}
    log = [(i, rng.choice("aab"), rng.random()) for i in range(1, 90)]
    topics = spark.createDataFrame(list(base.items()), "topic string, weight double")
    df = spark.createDataFrame(log, "seq long, topic string, reward double")
    whole = curriculum.replay(df, "seq", "topic", "reward", weights=topics).cache()
    for r in whole.collect():
        assert r.weight == pytest.approx(base[r.topic] if r.reset else base[r.topic] * (1 + 1.5 * (1 - r.ema)))
    for at in (0, 1, 37, 60, 88):
        left = curriculum.saved_state(curriculum.replay(df.where(F.col("seq") <= at), "seq", "topic", "reward", weights=topics), topics)
        rest = curriculum.replay(df.where(F.col("seq") > at), "seq", "topic", "reward", rows_per_part=20, weights=topics, saved=left).cache()
        want = {r.seq: r for r in whole.where(F.col("seq") > at).collect()}
        for r in rest.collect():
            w = want[r.seq]
            assert (r.run, r.reset, r.epoch) == (w.run, w.reset, w.epoch) and r.ema == pytest.approx(w.ema) and r.weight == pytest.approx(w.weight)
        states = [{r.topic: (pytest.approx(r.ema), pytest.approx(r.weight), r.resets) for r in s.collect()} for s in (curriculum.latest_state(whole, topics), curriculum.latest_state(rest, topics, saved=left))]
        assert states[0] == states[1]


def test_executions_reach_the_quality_rules(spark):
    tasks = spark.createDataFrame([("ok", "x = 1", '{"difficulty": "easy"}'), ("bad", "assert 1 == 2", None), ("slow", "while True: pass", "[1]"), ("left", "x", "{}")], "id string, p string, meta string")
    runs = generate.executed(tasks.where("id <> 'left'"), "id", F.col("p"), enabled=True, timeout=1.5).cache()
    meta = {r.id: json.loads(r.meta) for r in generate.with_execution(tasks, runs, "id", "meta").collect()}
    assert meta["left"] == {} and meta["ok"]["difficulty"] == "easy"
    assert [meta[k]["execution_status"] for k in ("ok", "bad", "slow")] == ["passed", "failed", "timeout"]
    assert quality.NO_FAILURE in meta["ok"]["observed_failure"] and "AssertionError" in meta["bad"]["observed_failure"]
    rows = generate.with_execution(tasks, runs, "id", "meta").select("id", datasets.failure_of(F.col("meta")).alias("f"))
    got = {r.id: r for r in rows.select("id", quality.error_name(F.col("f")).alias("name"), quality.prompt_context(prompts.tutor_text(F.lit("s"), F.lit("x"), F.col("f")))["status"].alias("status")).collect()}
    assert (got["ok"].status, got["bad"].status) == ("passed", "failed") and got["slow"].name == "TimeoutError" and got["bad"].name == "AssertionError"


def test_pairs_equal_but_for_layout_are_dropped(spark):
    recent = episodes(spark, [(1, "a", 0.9)])
    easy = datasets.easiest(recent, "topic", "reward", "seq")[0].first().task
    hard = spark.createDataFrame([(1, "a", "p", json.dumps(json.loads(easy), indent=2), 0.2)], "seq long, topic string, prompt string, chosen_completion string, reward double")
    none = spark.createDataFrame([], "seq long, topic string, prompt string, rejected_completion string")
    assert datasets.preference_pairs(hard, none, recent).count() == 0


def test_states_keep_the_last_whole_version_and_pointers_move(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    for n in (1, 2, 3):
        s.save_state("c", spark.range(n))
    kind = spark.range(1).schema
    assert s.load_state("c", kind).count() == 3 and len([p for p in (tmp_path / "c").iterdir() if p.is_dir()]) == 2
    (tmp_path / "c" / f"{9:012d}").mkdir()  # a version whose writing broke off
    assert s.load_state("c", kind).count() == 3
    p = spark.createDataFrame([], "name string, value string, seq long").schema
    for name, value in (("a", "x"), ("b", "y"), ("a", None)):
        s.set_pointer("p", p, name, value)
    assert {r.name: (r.value, r.seq) for r in s.pointers("p", p).collect()} == {"a": (None, 3), "b": ("y", 2)}
    datasets.export(s.pointers("p", p).coalesce(1), str(tmp_path / "out"))
    assert any('"value":null' in f.read_text() for f in (tmp_path / "out").glob("part-*"))
