"""SQL for DuckDB that gives the rows of the catalogue's queries, written from their definitions."""

from __future__ import annotations

from maieutic.functions import prompts, quality
from maieutic.functions.text import DEFAULT_HINT, WEAKNESS
from maieutic.operators import validation


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def texts(items) -> str:
    return "[" + ", ".join(map(q, items)) + "]"


EP = "ep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_id) AS copy_ FROM episodes WHERE episode_id IS NOT NULL) WHERE copy_ = 1)"
HX = "hx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id) AS copy_ FROM hard_examples WHERE example_id IS NOT NULL) WHERE copy_ = 1)"
RX = "rx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id) AS copy_ FROM red_rejections WHERE example_id IS NOT NULL) WHERE copy_ = 1)"
LOG = r"lg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_id) AS copy_ FROM episodes WHERE episode_id IS NOT NULL) WHERE copy_ = 1), s AS (SELECT *, episode_id AS seq, CAST(floor((episode_id - 1) / 4.0) AS BIGINT) AS batch_id, judge.score AS score, judge.normalized_reward AS reward FROM lg)"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def rstrip(x: str) -> str:
    return rf"regexp_replace({x}, '\s+$', '')"


def lines(x: str) -> str:
    parts = rf"string_split_regex({x}, '\r\n|[\n\r]')"
    return f"CASE WHEN {x} = '' THEN []::VARCHAR[] WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END"


def key(x: str) -> str:
    return strip(rf"regexp_replace(lower(replace({x}, '_', ' ')), '\s+', ' ', 'g')")


def js(col: str, path: str) -> str:
    return f"json_extract_string({col}, '$.{path}')"


FAILURE = f"coalesce(nullif({js('task.metadata', 'observed_failure')}, ''), 'AssertionError')"
_BODY = rstrip("coalesce(task.buggy_solution, '')")
_CHECKS = f"array_to_string(list_filter(list_transform(coalesce(task.failing_asserts, []::VARCHAR[]), lambda x: {strip('x')}), lambda x: x <> ''), chr(10))"
PROGRAM = f"CASE WHEN {_BODY} = '' THEN {_CHECKS} WHEN {_CHECKS} = '' THEN {_BODY} ELSE {rstrip(f'{_BODY} || chr(10) || chr(10) || {_CHECKS}')} END"
N_LINES = f"coalesce(len(list_filter({lines('task.buggy_solution')}, lambda x: {strip('x')} <> '')), 0)"
_T = "coalesce(hint.raw_text, '')"
_CLEAN = strip(rf"regexp_replace(regexp_replace(replace(replace(regexp_replace({strip(_T)}, '(?is)<think>.*?</think>', '', 'g'), '<think>', ''), '</think>', ''), '(?s)```.*?```', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")
_USER = "coalesce(task.statement, '')"
_SPEC = "CASE WHEN task.task_id IS NOT NULL THEN '{\"topic\": \"' || coalesce(topic, '') || '\"}' END"
_TUTOR = f"'## Task' || chr(10) || {_USER} || chr(10) || chr(10) || '## Code' || chr(10) || '```python' || chr(10) || ({PROGRAM}) || chr(10) || '```' || chr(10) || chr(10) || '## Error' || chr(10) || '```text' || chr(10) || {FAILURE} || chr(10) || '```' || chr(10) || chr(10) || '## Instruction' || chr(10) || 'Ask one or two guiding questions that help me find the bug without giving the answer.'"
_TRAIN = f"'Write a faulty Python program for topic ''' || coalesce(topic, '') || '''. Weakness to expose: ' || coalesce(nullif({{focus}}, ''), 'general weakness probing') || '. Answer with a JSON object of {', '.join(prompts.TASK_KEYS)}.'"
_SPREAD = "CASE WHEN count(score) OVER b >= 2 AND stddev_pop(score) OVER b > 1e-6 THEN greatest(CAST(0 AS DOUBLE), least(CAST(10 AS DOUBLE), score + CAST(0.3 AS DOUBLE) * (score - avg(score) OVER b) / stddev_pop(score) OVER b)) ELSE score END"


def ids(x: str) -> str:
    """All identifiers: runs of letters, marks, digits and underscores that are ASCII and do not begin with a digit."""
    return rf"list_filter(regexp_extract_all(coalesce({x}, ''), '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Za-z_][A-Za-z0-9_]*'))"


def own(x: str) -> str:
    return f"list_distinct(list_filter({ids(x)}, lambda i: NOT list_contains({texts(quality.IGNORED)}, i)))"


def any_of(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(n)})" for n in needles) + ")"


def number_of(x: str, needles) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {q(n)}) AS INTEGER)" for n in needles) + ")"


def joined(*pairs: tuple[str, str]) -> str:
    """The reasons whose condition holds, in order."""
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN {q(r)} END" for c, r in pairs) + ")"


_CONTEXT3 = f"array_to_string(list_filter(list_transform(coalesce(task.failing_asserts, []::VARCHAR[]), lambda x: {strip('x')}), lambda x: x <> '')[:3], chr(10))"
_ERRNAME = r"regexp_extract({x}, '\b([A-Za-z_][A-Za-z0-9_]*(?:Error|Exception))\b', 1)"
def quality_of(hint: str, checks: str = _CONTEXT3) -> str:
    return f"""
c AS (SELECT episode_id, {hint} AS t, lower({hint}) AS low, {own(f"({PROGRAM}) || chr(10) || {FAILURE} || chr(10) || {checks}")} AS allowed, {checks} AS checks, {_ERRNAME.format(x=FAILURE)} AS name, {FAILURE} AS failure FROM ep),
d AS (SELECT *, {own('t')} AS names, list_distinct(list_concat(flatten(list_transform(regexp_extract_all(t, '`([^`]+)`', 1), lambda m: {own('m')})), regexp_extract_all(t, '\\b([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1))) AS candidates FROM c),
g AS (SELECT *, len(list_filter(names, lambda i: list_contains(allowed, i))) AS m, list_sort(list_filter(candidates, lambda i: len(i) > 1 AND NOT list_contains(allowed, i) AND NOT list_contains({texts(quality.IGNORED)}, i))) AS alien,
  (len(t) - len(replace(t, '`', ''))) % 2 = 1 AS odd, len(list_filter({own('checks')}, lambda i: list_contains({ids('t')}, i))) AS hits, {number_of('low', quality.GENERIC)} AS generic,
  (name IN ({', '.join(map(q, quality.COMPILE_NAMES))}) OR {any_of('lower(failure)', quality.COMPILE_FAILURES)}) AS nocompile, {any_of('low', quality.COMPILE_HINTS)} AS saw FROM d)
"""


_CORRUPT = (
    ("contains(low, 'unicodeencodeerror') OR contains(low, 'traceback') AND contains(low, 'encode')", "encoding_traceback"),
    (r"regexp_matches(t, '[\x{1F300}-\x{1FAFF}]')", "emoji"),
    (r"regexp_matches(t, '[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]')", "cjk_script"),
    (r"regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '[\x{0400}-\x{04FF}]')", "latin_cyrillic_mix"),
    (r"regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '[\x{0600}-\x{06FF}]')", "latin_arabic_mix"),
    *((f"contains(t, {q(x)})", f"mojibake:{x}") for x in quality.MOJIBAKE),
)
_RAW = "coalesce(hint.raw_text, '')"
_SAID = "coalesce(nullif(hint.raw_text, ''), hint.text, '')"
_DELTA = """CAST((CASE WHEN odd THEN -1.1 ELSE 0 END) + (CASE WHEN name <> '' AND contains(t, name) THEN 0.35 ELSE 0 END) + least(0.55, 0.14 * hits) + least(0.55, 0.12 * m)
 - (CASE WHEN generic > 0 AND m < 2 THEN least(0.8, 0.25 * generic) ELSE 0 END) - (CASE WHEN len(alien) > 0 THEN least(2.6, 1.0 * len(alien)) ELSE 0 END)
 + (CASE WHEN nocompile AND name <> '' AND contains(low, lower(name)) THEN 0.25 ELSE 0 END) + (CASE WHEN nocompile AND saw THEN 0.45 ELSE 0 END) - (CASE WHEN nocompile AND NOT saw THEN 2.4 ELSE 0 END) AS DOUBLE)"""

def draw(x: str) -> str:
    """A number from 0 to below 1 out of a text's digest."""
    return f"CAST(CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"


#: Cases of answers, in SQL that both engines read.
TASK_CASES = r"""
('empty list, filled asserts', '{"buggy_solution": "x = 1", "failing_asserts": [], "asserts": ["assert x == 2"], "target_function": "f"}'),
('empty text, filled asserts', '{"buggy_solution": "x = 1", "failing_asserts": "", "asserts": ["assert x == 2", " "]}'),
('a text', '{"buggy_solution": "x = 1", "failing_asserts": "assert x == 3"}'),
('neither', '{"buggy_solution": "x = 1", "failing_asserts": null, "asserts": false}'),
('no program', '{"failing_asserts": ["assert x"]}'),
('no object', '[1]')
"""
JUDGE_CASES = r"""
('empty object', '{"items": {}, "scores": [1, 2]}'),
('zero', '{"items": 0, "results": [3, 4]}'),
('false and empty', '{"items": false, "scores": [], "results": [{"a": 1}, 5]}'),
('wrong number', '{"items": [1, 2, 3], "scores": [1, 2]}'),
('an array', '[1, 2]'),
('a text', '{"items": "x", "scores": [1, 2]}')
"""


def something(path: str) -> str:
    return f"CASE WHEN coalesce(json_extract_string(payload, '$.{path}'), '') NOT IN ('', '[]', '{{}}', '0', '0.0', '-0.0', 'false', 'null') THEN json_extract(payload, '$.{path}') END"


def task_json(t: str) -> str:
    """The JSON text of a task, as written by the engine."""
    text = lambda x: f"CAST(to_json({x}) AS VARCHAR)"
    meta = ", ".join(f"""'"{k}":' || {text(js(f'{t}.metadata', k))}""" for k in ("failure_mode", "difficulty", "observed_failure", "execution_status"))
    fields = {
        "topic": f"coalesce({t}.topic, '')",
        "target_function": f"coalesce({js(f'{t}.metadata', 'red_spec.target_function')}, '')",
        "intended_bug": f"coalesce({js(f'{t}.metadata', 'red_spec.intended_bug')}, {js(f'{t}.metadata', 'failure_mode')}, '')",
        "expected_first_failure": f"coalesce({js(f'{t}.metadata', 'red_spec.expected_first_failure')}, {FAILURE})",
        "statement": f"coalesce({t}.statement, '')",
        "buggy_solution": f"({PROGRAM})",
    }
    return "'{' || " + " || ',' || ".join(f"""'"{k}":' || {text(v)}""" for k, v in fields.items()) + f""" || ',"metadata":{{' || concat_ws(',', {meta}) || '}}}}'"""


_ITEM = {
    "topic": "coalesce(topic, '')",
    "statement": "left(coalesce(task.statement, ''), 600)",
    "buggy_code": f"left({PROGRAM}, 2200)",
    "observed_failure": f"left({FAILURE}, 1200)",
    "execution_status": f"coalesce(nullif({js('task.metadata', 'execution_status')}, ''), 'failed')",
    "assistant_response": "left(coalesce(nullif(hint.raw_text, ''), hint.text, ''), 1800)",
}
_ITEM_JSON = "'{' || " + " || ',' || ".join(f"""'"{k}":' || CAST(to_json({v}) AS VARCHAR)""" for k, v in _ITEM.items()) + " || '}'"
_BASES = "w AS (SELECT DISTINCT topic, CAST(0.5 AS DOUBLE) + (length(topic) % 4) / CAST(4 AS DOUBLE) AS base FROM s WHERE topic IS NOT NULL)"

_ISLANDS = f"""
WITH {LOG},
r AS (SELECT seq, topic, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), reward)) AS reward FROM s WHERE topic IS NOT NULL AND reward IS NOT NULL),
i AS (SELECT *, sum(brk) OVER (ORDER BY seq) AS island FROM (SELECT *, CAST(topic IS DISTINCT FROM lag(topic) OVER (ORDER BY seq) AS INTEGER) AS brk FROM r)),
p AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY seq) AS pos FROM i),
e AS (SELECT *, pos % 5 = 0 AS reset, CAST(coalesce(sum(CAST(pos % 5 = 0 AS INTEGER)) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS epoch FROM p),
l AS (SELECT *, list(reward) OVER (PARTITION BY epoch, topic ORDER BY seq) AS rs FROM e),
f AS (SELECT *, CASE WHEN reset THEN CAST(0.5 AS DOUBLE) ELSE list_reduce(list_prepend(CAST(0.5 AS DOUBLE), rs), lambda a, x: CAST(0.8 AS DOUBLE) * a + CAST(0.2 AS DOUBLE) * x) END AS ema FROM l),
z AS (SELECT seq, topic, (pos - 1) % 5 + 1 AS run, reset, epoch, ema, CASE WHEN reset THEN CAST(1 AS DOUBLE) ELSE greatest(CAST(0.001 AS DOUBLE), 1 + CAST(1.5 AS DOUBLE) * greatest(CAST(0 AS DOUBLE), 1 - ema)) END AS weight FROM f),
total AS (SELECT CAST(count(*) FILTER (WHERE reset) AS BIGINT) AS resets FROM z),
state AS (SELECT t.topic, coalesce(n.ema, CAST(0.5 AS DOUBLE)) AS ema, CASE WHEN n.ema IS NULL THEN CAST(1 AS DOUBLE) ELSE greatest(CAST(0.001 AS DOUBLE), 1 + CAST(1.5 AS DOUBLE) * greatest(CAST(0 AS DOUBLE), 1 - n.ema)) END AS weight, (SELECT resets FROM total) AS resets
  FROM (SELECT DISTINCT topic FROM s WHERE topic IS NOT NULL) t LEFT JOIN (SELECT topic, arg_max(ema, seq) AS ema FROM z WHERE epoch = (SELECT resets FROM total) GROUP BY topic) n ON t.topic = n.topic)
"""
_PARSED = r"""
p AS (SELECT line_no, regexp_extract(line, '(?s)^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3}) \| (\w+) \| (\w+) \| (.*)$', ['ts', 'level', 'event', 'raw']) AS m FROM run_log WHERE regexp_matches(line, '(?s)^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3}) \| (\w+) \| (\w+) \| (.*)$')),
v AS (SELECT line_no, replace(m.ts, ',', '.') AS ts, m.level AS level, m.event AS event, CASE WHEN json_valid(m.raw) AND starts_with(ltrim(m.raw), '{') THEN m.raw END AS payload FROM p),
u AS (SELECT min(line_no) AS line_no, ts, level, event, payload FROM v GROUP BY ts, level, event, payload)
"""
_SALVAGE_O = r"""
b AS (SELECT example_id, topic, trim(regexp_replace(coalesce(chosen_completion, ''), '^\s+|\s+$', '', 'g')) AS t FROM hx),
f AS (SELECT *, regexp_replace(replace(replace(t, '```json', ''), '```', ''), '^\s+|\s+$', '', 'g') AS bare FROM b),
k AS (SELECT *, regexp_extract(bare, '(?s)\{.*\}') AS obj, regexp_extract(bare, '(?s)\[.*\]') AS arr FROM f),
y AS (SELECT example_id, topic,
  CASE WHEN t <> '' AND json_valid(t) THEN t WHEN obj <> '' AND json_valid(obj) THEN obj WHEN arr <> '' AND json_valid(arr) THEN arr END AS o,
  CASE WHEN t <> '' AND json_valid(t) THEN t WHEN arr <> '' AND json_valid(arr) THEN arr WHEN obj <> '' AND json_valid(obj) THEN obj END AS a FROM k)
"""


def at(k: str) -> str:
    return strip(f"coalesce(json_extract_string(o, '$.{k}'), '')")


_OBJ = "coalesce(json_type(o) = 'OBJECT', false)"
_TOPIC = f"coalesce(nullif({at('topic')}, ''), coalesce(topic, ''))"
_SPEC_REASONS = f"CASE WHEN NOT {_OBJ} THEN 'non-json response' ELSE " + joined((f"{_TOPIC} = ''", "missing topic"), *((f"{at(k)} = ''", f"missing {k}") for k in ("target_function", "intended_bug", "expected_first_failure"))) + " END"

_JUDGED = r"""
j0 AS (SELECT episode_id, (episode_id - 1) % 4 AS idx, regexp_replace(judge.raw_text, '^\s+|\s+$', '', 'g') AS t FROM ep WHERE judge.raw_text IS NOT NULL),
j1 AS (SELECT *, regexp_replace(replace(replace(t, '```json', ''), '```', ''), '^\s+|\s+$', '', 'g') AS bare FROM j0),
j2 AS (SELECT *, regexp_extract(bare, '(?s)\[.*\]') AS arr, regexp_extract(bare, '(?s)\{.*\}') AS obj FROM j1),
j3 AS (SELECT episode_id, idx, CASE WHEN t <> '' AND json_valid(t) THEN t WHEN arr <> '' AND json_valid(arr) THEN arr WHEN obj <> '' AND json_valid(obj) THEN obj END AS p FROM j2),
j4 AS (SELECT episode_id, idx, CASE WHEN json_type(p) = 'ARRAY' THEN p ELSE coalesce(nullif(json_extract(p, '$.items'), '[]'), nullif(json_extract(p, '$.scores'), '[]'), nullif(json_extract(p, '$.results'), '[]')) END AS inner_ FROM j3),
j5 AS (SELECT episode_id, CASE WHEN json_type(inner_) = 'ARRAY' AND json_array_length(inner_) = 4 THEN json_extract(inner_, '$[' || idx || ']') END AS item FROM j4)
"""

_EVALUATED = f"""WITH {EP}, {_JUDGED}, {quality_of(_SAID)},
v AS (SELECT g.episode_id, CAST(floor((g.episode_id - 1) / 4.0) AS BIGINT) AS batch_id, greatest(CAST(0 AS DOUBLE), least(CAST(10 AS DOUBLE), coalesce(CAST(json_extract_string(item, '$.score') AS DOUBLE), CAST(0 AS DOUBLE)))) AS model_score,
  greatest(CAST(0 AS DOUBLE), least(CAST(10 AS DOUBLE), coalesce(CAST(json_extract_string(item, '$.task_quality') AS DOUBLE), CAST(5 AS DOUBLE)))) > 3 AS task_valid, {' OR '.join(f'({c})' for c, _ in _CORRUPT)} AS corrupt, len(alien) > 0 AND odd AS severe, {_DELTA} AS delta FROM g JOIN j5 USING (episode_id)),
s AS (SELECT *, CASE WHEN corrupt OR severe OR NOT task_valid THEN CAST(0 AS DOUBLE) ELSE greatest(CAST(0 AS DOUBLE), least(CAST(10 AS DOUBLE), model_score + delta)) END AS score FROM v)
"""

ORACLE: dict[str, str] = {
    "q_episode_count": f"WITH {EP} SELECT count(*) AS n FROM ep",
    "q_recent_episodes": f"WITH {EP} SELECT episode_id, topic, judge.normalized_reward AS reward FROM ep ORDER BY episode_id DESC LIMIT 20",
    "q_hard_buffer": f"WITH {HX} SELECT metadata.episode_id AS seq, example_id, reward FROM hx ORDER BY seq DESC NULLS LAST, example_id DESC LIMIT 64",
    "q_rejected_by_reason": f"WITH {RX} SELECT rejection_reason, count(*) AS n, count(*) FILTER (WHERE spec IS NULL) AS n_without_spec, round(avg(task_quality), 6) AS mean_quality FROM rx GROUP BY rejection_reason",
    "q_latest_pointers": "SELECT name, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq DESC) AS r FROM pointers WHERE name IS NOT NULL) WHERE r = 1",
    "q_checkpoint_names": r"SELECT DISTINCT regexp_extract(value, 'checkpoints/(\w+)/', 1) AS role, CAST(regexp_extract(value, 'step_(\d+)', 1) AS INTEGER) AS step, printf('checkpoints/%s/step_%06d', regexp_extract(value, 'checkpoints/(\w+)/', 1), CAST(regexp_extract(value, 'step_(\d+)', 1) AS INTEGER)) AS name FROM pointers WHERE value IS NOT NULL",
    "q_checkpoint_prune": r"WITH n AS (SELECT DISTINCT regexp_extract(value, 'checkpoints/(\w+)/', 1) AS role, value AS name FROM pointers WHERE value IS NOT NULL) SELECT role, name FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY name DESC) AS r FROM n) WHERE r > 2",
    "q_log_events": f"WITH {_PARSED} SELECT line_no, strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%g') AS ts, level, event, payload IS NOT NULL AS readable, CAST(json_extract_string(payload, '$.episode_id') AS BIGINT) AS episode_id FROM v",
    "q_log_event_counts": f"WITH {_PARSED} SELECT event, level, count(*) AS n, count(*) FILTER (WHERE payload IS NULL) AS unreadable FROM u GROUP BY event, level",
    "q_log_gaps": f"WITH {_PARSED}, w AS (SELECT event, epoch_us(CAST(ts AS TIMESTAMP)) - lag(epoch_us(CAST(ts AS TIMESTAMP))) OVER (PARTITION BY event ORDER BY ts, line_no) AS g FROM u) SELECT event, count(g) AS n, round(avg(g / 1e6), 6) AS mean_gap_s, max(g / 1e6) AS max_gap_s FROM w GROUP BY event",
    "q_line_counts": f"WITH {EP} SELECT episode_id, CAST({N_LINES} AS INTEGER) AS n_lines FROM ep",
    "q_combined_programs": f"WITH {EP} SELECT episode_id, len({PROGRAM}) AS n_chars, md5({PROGRAM}) AS program_md5, {FAILURE} AS failure FROM ep",
    "q_split_asserts": f"""WITH {EP}, x AS (SELECT episode_id, {lines("coalesce(task.buggy_solution, '')")} AS ls FROM ep), y AS (SELECT episode_id, list_filter(ls, lambda x: starts_with({strip("x")}, 'assert ')) AS checks, list_filter(ls, lambda x: NOT starts_with({strip("x")}, 'assert ')) AS body FROM x)
SELECT episode_id, len(checks) AS n_asserts, md5({rstrip(f"array_to_string(list_transform(body, lambda x: {rstrip('x')}), chr(10))")}) AS body_md5, md5(array_to_string(list_transform(checks, lambda x: {rstrip('x')}), chr(10))) AS asserts_md5 FROM y""",
    "q_sanitized_hints": f"WITH {EP}, a AS (SELECT episode_id, list_filter(list_transform({lines('c')}, lambda x: {strip('x')}), lambda x: x <> '') AS ls FROM (SELECT episode_id, {_CLEAN} AS c FROM ep)), b AS (SELECT episode_id, ls, {strip('array_to_string(ls[:4], chr(10))')} AS t FROM a), w AS (SELECT *, string_split_regex(t, '\\s+') AS ws FROM b) SELECT episode_id, CASE WHEN len(ls) = 0 THEN {q(DEFAULT_HINT)} WHEN len(ws) > 120 THEN array_to_string(ws[:120], ' ') ELSE t END AS hint_text FROM w",
    "q_rejected_tails": f"WITH {RX} SELECT example_id, right({strip('rejected_completion')}, 160) AS tail FROM rx",
    "q_topic_keys": f"WITH {EP} SELECT {key('topic')} AS topic_key, count(*) AS n, count(DISTINCT topic) AS n_spellings FROM ep WHERE topic IS NOT NULL GROUP BY 1",
    "q_weakness_texts": f"WITH {EP} SELECT topic, printf({q(WEAKNESS)}, topic, coalesce(round(avg(judge.normalized_reward), 6) + CAST(0.0000001 AS DOUBLE), CAST(0.5 AS DOUBLE))) AS summary FROM ep WHERE topic IS NOT NULL GROUP BY topic",
    "q_rendered_chats": f"WITH {EP}, m AS (SELECT episode_id, 'SYSTEM: Tutor' || chr(10) || chr(10) || 'USER: ' || {_USER} || chr(10) || chr(10) || 'ASSISTANT: ' || coalesce(hint.text, '') AS c FROM ep) SELECT episode_id, md5(c) AS chat_md5, md5(c || chr(10) || chr(10) || 'ASSISTANT:') AS asking_md5 FROM m",
    "q_chat_parts": f"WITH {EP} SELECT episode_id, {strip(_USER)} AS user_text, {strip('coalesce(hint.text, chr(32))')} AS completion FROM ep",
    "q_task_json": f"WITH {EP} SELECT episode_id, coalesce(task.topic, '') AS topic, coalesce({js('task.metadata', 'failure_mode')}, '') AS intended_bug, {FAILURE} AS expected_first_failure, md5({PROGRAM}) AS program_md5, {js('task.metadata', 'difficulty')} AS difficulty FROM ep",
    "q_tutor_prompts": f"WITH {EP} SELECT episode_id, md5({_TUTOR}) AS prompt_md5 FROM ep",
    "q_generator_prompts": f"""WITH {EP}, x AS (SELECT episode_id, coalesce(topic, '') AS topic, metadata.weakness_summary AS focus, {_SPEC} AS spec, CASE WHEN task.buggy_solution IS NULL THEN 'missing buggy_solution' ELSE 'unspecified issue' END AS why, {FAILURE} AS failure FROM ep),
y AS (SELECT *, {_TRAIN.format(focus='focus')} || coalesce(' Plan: ' || spec, '') AS training FROM x)
SELECT episode_id, md5('Topic: ' || topic || chr(10) || 'Focus: ' || coalesce(nullif(focus, ''), 'any weakness within the topic') || chr(10) || chr(10) || 'Plan one fault. Answer with a JSON object of {', '.join(prompts.SPEC_KEYS)}.') AS spec_md5,
md5('Write the program of this plan.' || chr(10) || coalesce(spec, '{{}}') || chr(10) || chr(10) || 'Keep the topic. Answer with a JSON object of {', '.join(prompts.TASK_KEYS)}.') AS task_md5,
md5('Write the spec for topic ''' || topic || ''' anew. Against the last one: ' || why || '. Answer with JSON only.') AS spec_repair_md5,
md5('Write the task for topic ''' || topic || ''' anew. Against the last one: ' || why || '. Answer with JSON only.' || coalesce(chr(10) || 'Keep to this plan: ' || spec, '')) AS task_repair_md5,
md5(training) AS training_md5, md5(training || ' Reproduced failure: ' || left(failure, 600)) AS hard_md5 FROM y""",
    "q_grading_prompts": f"WITH {LOG}, i AS (SELECT batch_id, count(*) AS n, string_agg({_ITEM_JSON}, ',' ORDER BY episode_id) AS items FROM s GROUP BY batch_id) SELECT batch_id, CAST(n AS INTEGER) AS n_items, CAST(n AS INTEGER) AS n_said, md5('N = ' || n || chr(10) || chr(10) || '[' || items || ']') AS prompt_md5 FROM i",
    "q_salvaged": f"WITH {HX}, {_SALVAGE_O} SELECT example_id, json_extract_string(o, '$.target_function') AS target_function, {_OBJ} AS is_object, coalesce(json_type(a) = 'ARRAY', false) AS is_array FROM y",
    "q_parsed_specs": f"WITH {HX}, {_SALVAGE_O}, r AS (SELECT *, {_SPEC_REASONS} AS reasons FROM y) SELECT example_id, CASE WHEN reasons = '' THEN {at('target_function')} END AS target_function, CASE WHEN reasons = '' THEN {at('intended_bug')} END AS intended_bug, reasons FROM r",
    "q_parsed_tasks": f"""WITH {HX}, {_SALVAGE_O}, l AS (SELECT example_id, o, {_OBJ} AS ok, {lines(at('buggy_solution'))} AS ls FROM y),
body_ AS (SELECT *, list_filter(ls, lambda x: starts_with({strip('x')}, 'assert ')) AS checks, {rstrip(f"array_to_string(list_transform(list_filter(ls, lambda x: NOT starts_with({strip('x')}, 'assert ')), lambda x: {rstrip('x')}), chr(10))")} AS body FROM l),
r AS (SELECT *, CASE WHEN NOT ok THEN 'non-json response' WHEN body = '' THEN 'missing buggy_solution' ELSE '' END AS reasons FROM body_)
SELECT example_id, CASE WHEN reasons = '' THEN len(checks) END AS n_asserts, CASE WHEN reasons = '' THEN len(body) END AS n_chars, CASE WHEN reasons = '' THEN coalesce(nullif({at('metadata.observed_failure')}, ''), 'AssertionError') END AS observed_failure, reasons FROM r""",
    "q_evaluated": _EVALUATED + f"SELECT episode_id, round(model_score, 6) AS model_score, round(score, 6) AS score, round(CASE WHEN corrupt OR severe OR NOT task_valid THEN CAST(0 AS DOUBLE) ELSE {_SPREAD} END, 6) AS adjusted_score, task_valid, NOT corrupt AND NOT severe AS hint_valid FROM s WINDOW b AS (PARTITION BY batch_id)",
    "q_judged_batches": _EVALUATED + f""", a AS (SELECT batch_id, CAST((episode_id - 1) % 4 AS INTEGER) AS idx, task_valid, CASE WHEN corrupt OR severe OR NOT task_valid THEN CAST(0 AS DOUBLE) ELSE {_SPREAD} END / 10 AS reward FROM s WINDOW b AS (PARTITION BY batch_id)),
n AS (SELECT *, row_number() OVER (ORDER BY batch_id, idx) AS episode_id FROM a WHERE task_valid),
h AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY reward, episode_id) <= greatest(1, ceil(count(*) OVER (PARTITION BY batch_id) * 0.25)) AS is_hard FROM n)
SELECT batch_id, idx, 'episode' AS goes_to, episode_id, round(reward, 6) AS reward, is_hard FROM h UNION ALL SELECT batch_id, idx, 'rejected', NULL, NULL, NULL FROM a WHERE NOT task_valid""",
    "q_judge_items": f"WITH {EP}, {_JUDGED} SELECT episode_id, CAST(json_extract_string(item, '$.task_quality') AS DOUBLE) AS task_quality, CAST(json_extract_string(item, '$.score') AS DOUBLE) AS score FROM j5",
    "q_metadata_specs": f"""WITH {RX}, x AS (SELECT example_id, topic, {strip("coalesce(spec.target_function, '')")} AS f, {strip("coalesce(spec.intended_bug, '')")} AS b, {strip("coalesce(spec.expected_first_failure, '')")} AS e, {strip("coalesce(spec.topic, '')")} AS t FROM rx)
SELECT example_id, CASE WHEN f || b || e <> '' THEN coalesce(nullif(t, ''), topic) END AS topic, CASE WHEN f || b || e <> '' THEN f END AS target_function, CASE WHEN f || b || e <> '' THEN b END AS intended_bug, CASE WHEN f || b || e <> '' THEN e END AS expected_first_failure FROM x""",
    "q_rejection_reasons": f"WITH {EP}, x AS (SELECT episode_id, {key("coalesce(task.topic, '')")} AS a, {key("coalesce(topic, '')")} AS b, {N_LINES} AS n, {js('task.metadata', 'observed_failure')} AS f, {draw("task.task_id || ':0:short'")} AS u, {draw("task.task_id || ':0:passed'")} AS v FROM ep) SELECT episode_id, {joined(('a <> b', 'wrong topic'), ('n < 15 AND u < 0.5', 'too short'), ("f = '' AND v < 0.5", validation.ALREADY_RIGHT))} AS reasons FROM x",
    "q_rejections_with_text": f"WITH {RX} SELECT example_id, len({strip('rejected_completion')}) AS n_chars FROM rx WHERE {strip('coalesce(rejected_completion, chr(32))')} <> ''",
    "q_judge_gate": f"WITH {EP} SELECT episode_id, CASE WHEN coalesce(CAST({js('judge.metadata', 'valid')} AS BOOLEAN), true) THEN 'episode' ELSE 'rejected' END AS goes_to FROM ep",
    "q_corruption": f"WITH m AS (SELECT doc_id, coalesce(text || [' \U0001f600', ' 汉字', ' Привет', ' سلام', ' â€™', ' �', ' Traceback encode'][doc_id % 7 + 1], '') AS t FROM documents), l AS (SELECT *, lower(t) AS low FROM m) SELECT doc_id, {joined(*_CORRUPT)} AS reasons FROM l",
    "q_compile_failures": f"WITH {EP}, x AS (SELECT episode_id, {FAILURE} AS f, {_ERRNAME.format(x=FAILURE)} AS error_name FROM ep) SELECT episode_id, error_name, error_name IN ({', '.join(map(q, quality.COMPILE_NAMES))}) OR {any_of('lower(f)', quality.COMPILE_FAILURES)} AS fails_to_compile FROM x",
    "q_update_gate": f"WITH {HX}, a AS (SELECT 'all' AS gate, count(*) AS n, 8 AS least FROM hx UNION ALL SELECT 'few', count(*) FILTER (WHERE reward < 0.05), 1000000 FROM hx) SELECT gate, n, n < least AS skipped, CASE WHEN n < least THEN 'need_' || least || '_chosen_examples_have_' || n END AS reason FROM a",
    "q_identifiers": f"WITH {EP} SELECT episode_id, len({ids('hint.text')}) AS n_all, array_to_string(list_sort({own('hint.text')}), ' ') AS own, md5({_CONTEXT3}) AS checks_md5 FROM ep",
    "q_foreign_identifiers": f"WITH {EP}, {quality_of(_RAW)} SELECT episode_id, array_to_string(alien, ' ') AS \"foreign\" FROM g",
    "q_hint_quality": f"WITH {EP}, {quality_of(_RAW)} SELECT episode_id, round({_DELTA}, 6) AS delta, len(alien) > 0 AND odd AS severe, " + joined(("odd", "unbalanced_backticks"), ("generic > 0 AND m < 2", "generic_hint"), ("len(alien) > 0", "hallucinated_identifiers"), ("nocompile AND NOT saw", "missed_compile_failure")) + " AS reasons FROM g",
    "q_weighted_scores": f"WITH {EP} SELECT episode_id, round(greatest(CAST(0 AS DOUBLE), least(CAST(10 AS DOUBLE), " + " + ".join(f"coalesce(judge.criteria_scores['{k}'], 0) * CAST({w} AS DOUBLE)" for k, w in {"bug_localization": 0.25, "usefulness": 0.25, "socratic_style": 0.2, "correctness": 0.2, "clarity": 0.1}.items()) + ")), 6) AS weighted FROM ep",
    "q_assessments": f"WITH {EP}, {_JUDGED}, x AS (SELECT episode_id, greatest(CAST(0 AS DOUBLE), least(CAST(10 AS DOUBLE), coalesce(CAST(json_extract_string(item, '$.task_quality') AS DOUBLE), CAST(5 AS DOUBLE)))) AS task_quality FROM j5) SELECT episode_id, task_quality, task_quality > 6 AS task_valid, true AS hint_valid FROM x",
    "q_batch_spread": f"WITH {LOG} SELECT episode_id, batch_id, round({_SPREAD}, 6) AS spread_score FROM s WHERE score IS NOT NULL WINDOW b AS (PARTITION BY batch_id)",
    "q_ema_replay": _ISLANDS + "SELECT seq, topic, run, reset, epoch, round(ema, 9) AS ema, round(weight, 9) AS weight FROM z",
    "q_curriculum_state": _ISLANDS + "SELECT topic, round(ema, 9) AS ema, round(weight, 9) AS weight, resets FROM state",
    "q_weakest_topic": _ISLANDS + "SELECT topic, round(ema, 9) AS ema FROM state ORDER BY round(ema, 9), topic LIMIT 1",
    "q_recent_topics": _ISLANDS + "SELECT seq, topic FROM z WHERE epoch = (SELECT resets FROM total) ORDER BY seq DESC LIMIT 32",
    "q_dense_batches": f"WITH {EP}, n AS (SELECT episode_id, row_number() OVER (ORDER BY episode_id) AS number FROM ep WHERE {js('judge.metadata', 'valid')} = 'true') SELECT episode_id, number, CAST(floor((number - 1) / 4.0) AS BIGINT) AS batch_id FROM n",
    "q_hard_mining": f"WITH {LOG}, r AS (SELECT batch_id, episode_id, topic, round(({_SPREAD}) / 10, 6) AS reward FROM s WHERE score IS NOT NULL WINDOW b AS (PARTITION BY batch_id)), k AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY reward, episode_id) AS rk, count(*) OVER (PARTITION BY batch_id) AS n FROM r) SELECT batch_id, episode_id, topic, reward FROM k WHERE rk <= greatest(1, ceil(n * 0.25))",
    "q_sft_texts": f"WITH {HX}, l AS (SELECT * FROM hx WHERE metadata.episode_id IS NOT NULL ORDER BY metadata.episode_id DESC LIMIT 256) SELECT row_number() OVER (ORDER BY reward NULLS LAST, metadata.episode_id) AS position, md5({q('SYSTEM: ' + prompts.ADVERSARY)} || chr(10) || chr(10) || 'USER: ' || coalesce(prompt, '') || chr(10) || chr(10) || 'ASSISTANT: ' || coalesce(chosen_completion, '')) AS text_md5 FROM l",
    "q_fallback_examples": f"WITH {LOG}, r AS (SELECT * FROM s ORDER BY seq DESC LIMIT 256) SELECT 'recent_' || episode_id AS example_id, topic, task.task_id AS task_id, reward, md5({_TRAIN.format(focus='metadata.weakness_summary')}) AS prompt_md5 FROM r ORDER BY reward DESC NULLS LAST, seq LIMIT 8",
    "q_topped_up": f"WITH {LOG}, {HX}, h AS (SELECT example_id, task.task_id AS task_id, reward FROM hx ORDER BY metadata.episode_id DESC NULLS LAST, example_id DESC LIMIT 3), r AS (SELECT * FROM s ORDER BY seq DESC LIMIT 256), f AS (SELECT 'recent_' || episode_id AS example_id, task.task_id AS task_id, reward FROM r ORDER BY reward DESC NULLS LAST, seq LIMIT 5) SELECT * FROM h UNION ALL SELECT * FROM f WHERE task_id NOT IN (SELECT task_id FROM h)",
    "q_easiest": f"WITH {LOG} SELECT topic, episode_id, reward FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY reward DESC, seq) AS rn FROM s WHERE topic IS NOT NULL AND reward IS NOT NULL) WHERE rn = 1",
    "q_tutor_dataset": f"WITH {LOG} SELECT seq, md5({strip(_TUTOR)}) AS user_md5, 2 AS n_messages FROM (SELECT * FROM s ORDER BY seq DESC LIMIT 10)",
    "q_zipped_batches": f"WITH {LOG} SELECT batch_id, CAST((episode_id - 1) % 4 AS INTEGER) AS idx, task.task_id AS task_id, task.task_id = hint.task_id AS agrees FROM s",
    "q_episode_debug": f"WITH {LOG} SELECT episode_id, batch_id, topic, task.task_id AS task_id, CAST({N_LINES} AS INTEGER) AS n_lines, {FAILURE} AS failure, len(hint.text) AS n_hint, score, round(reward, 6) AS reward, metadata.red_adapter AS red_adapter FROM s",
    "q_scored_pairs": f"""WITH {EP}, {quality_of("coalesce(hint.text, '')", "''")},
v AS (SELECT g.episode_id, CAST(floor((g.episode_id - 1) / 4.0) AS BIGINT) AS batch_id, greatest(CAST(0 AS DOUBLE), least(CAST(10 AS DOUBLE), coalesce(judge.score, CAST(0 AS DOUBLE)))) AS model_score, {' OR '.join(f'({c})' for c, _ in _CORRUPT)} AS corrupt, len(alien) > 0 AND odd AS severe, {_DELTA} AS delta, odd, generic, m, alien, nocompile, saw FROM g JOIN ep USING (episode_id)),
s AS (SELECT *, CASE WHEN corrupt OR severe THEN CAST(0 AS DOUBLE) ELSE greatest(CAST(0 AS DOUBLE), least(CAST(10 AS DOUBLE), model_score + delta)) END AS score FROM v)
SELECT episode_id, round(CASE WHEN corrupt OR severe THEN CAST(0 AS DOUBLE) ELSE {_SPREAD} END, 6) AS adjusted_score, {joined(("odd", "unbalanced_backticks"), ("generic > 0 AND m < 2", "generic_hint"), ("len(alien) > 0", "hallucinated_identifiers"), ("nocompile AND NOT saw", "missed_compile_failure"))} AS reasons FROM s WINDOW b AS (PARTITION BY batch_id)""",
    "q_weighted_replay": _ISLANDS + f", {_BASES} SELECT seq, topic, round(CASE WHEN reset THEN base ELSE base * weight END, 9) AS weight FROM z JOIN w USING (topic)",
    "q_resumed_state": _ISLANDS + f", {_BASES} SELECT topic, round(ema, 9) AS ema, round(base * weight, 9) AS weight, resets FROM state JOIN w USING (topic)",
    "q_boosted_weights": _ISLANDS + """, n AS (SELECT row_number() OVER (ORDER BY seq) AS n, seq, epoch + CAST(reset AS INTEGER) AS epoch FROM z),
g AS (SELECT n.n, n.seq, n.epoch, t.topic FROM n, (SELECT topic FROM state) t WHERE n.n % 8 = 0),
h AS (SELECT g.n, g.seq, g.topic, CASE WHEN k.epoch = g.epoch AND NOT k.reset THEN k.ema ELSE CAST(0.5 AS DOUBLE) END AS ema FROM g ASOF LEFT JOIN z k ON g.topic = k.topic AND g.seq >= k.seq),
f2 AS (SELECT seq, topic FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY ema, topic) AS r FROM h) WHERE r = 1),
since AS (SELECT max(seq) AS seq FROM z WHERE reset),
seen AS (SELECT topic, max(seq) AS seen FROM z GROUP BY topic),
b AS (SELECT f2.topic, count(*) AS n FROM f2 LEFT JOIN seen USING (topic) WHERE f2.seq >= coalesce(greatest(seen, (SELECT seq FROM since)), 0) GROUP BY 1)
SELECT state.topic, round(greatest(CAST(0.001 AS DOUBLE), weight * pow(CAST(1.15 AS DOUBLE), coalesce(b.n, 0))), 6) AS weight FROM state LEFT JOIN b USING (topic)""",
    "q_sampled_topics": _ISLANDS + f""", c AS (SELECT topic, sum(greatest(CAST(1e-6 AS DOUBLE), weight)) OVER (ORDER BY topic) AS upto FROM state),
dr AS (SELECT episode_id, {draw("episode_id || ':0'")} * (SELECT max(upto) FROM c) AS u FROM s),
pick AS (SELECT episode_id, (SELECT min(upto) FROM c WHERE upto > dr.u) AS upto FROM dr)
SELECT topic, count(*) AS n FROM pick JOIN c USING (upto) GROUP BY topic""",
    "q_preference_pairs": f"""WITH {LOG}, {HX}, {RX}, e AS (SELECT * FROM s ORDER BY seq DESC LIMIT 256),
best AS (SELECT topic, {task_json('task')} AS task FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY reward DESC, seq) AS rn FROM e WHERE topic IS NOT NULL AND reward IS NOT NULL) WHERE rn = 1),
any_ AS (SELECT {task_json('task')} AS task FROM (SELECT * FROM e WHERE reward IS NOT NULL ORDER BY reward DESC, seq LIMIT 1)),
f1 AS (SELECT topic, metadata.episode_id AS seq, reward, prompt, chosen_completion FROM hx WHERE metadata.episode_id IS NOT NULL ORDER BY reward NULLS LAST, seq LIMIT 128),
one AS (SELECT f1.*, coalesce(best.task, (SELECT task FROM any_)) AS easy FROM f1 LEFT JOIN best USING (topic)),
p1 AS (SELECT 1 AS part, row_number() OVER (ORDER BY reward NULLS LAST, seq) AS position, md5(prompt) AS prompt_md5, md5(chosen_completion) AS chosen_md5, md5(easy) AS rejected_md5 FROM one WHERE easy IS DISTINCT FROM chosen_completion),
l AS (SELECT *, row_number() OVER (ORDER BY example_id DESC) AS back FROM rx),
two AS (SELECT l.example_id, l.prompt, {strip("coalesce(rejected_completion, '')")} AS said, coalesce(best.task, (SELECT task FROM any_)) AS easy FROM l LEFT JOIN best USING (topic) WHERE back <= 128 - (SELECT count(*) FROM p1)),
p2 AS (SELECT 2 AS part, row_number() OVER (ORDER BY example_id) AS position, md5(prompt) AS prompt_md5, md5(easy) AS chosen_md5, md5(said) AS rejected_md5 FROM two WHERE said <> '' AND said <> easy)
SELECT * FROM p1 UNION ALL SELECT * FROM p2""",
    "q_task_cases": f"""WITH t AS (SELECT * FROM (VALUES {TASK_CASES}) AS v("case", payload)),
g AS (SELECT "case", payload, json_type(payload) = 'OBJECT' AS ok, trim(coalesce(json_extract_string(payload, '$.buggy_solution'), '')) AS program, coalesce({something('failing_asserts')}, {something('asserts')}) AS given FROM t),
a AS (SELECT *, CASE WHEN NOT ok THEN 'non-json response' WHEN program = '' THEN 'missing buggy_solution' ELSE '' END AS reasons, CASE WHEN json_type(given) = 'ARRAY' THEN list_filter(CAST(given AS VARCHAR[]), lambda x: trim(x) <> '') WHEN given IS NOT NULL THEN [given ->> '$'] ELSE [] END AS listed FROM g)
SELECT "case", CASE WHEN reasons = '' THEN array_to_string(listed, '|') END AS asserts, CASE WHEN reasons = '' THEN program END AS program, CASE WHEN reasons = '' THEN coalesce(json_extract_string(payload, '$.target_function'), '') END AS target, reasons FROM a""",
    "q_judge_cases": f"""WITH t AS (SELECT * FROM (VALUES {JUDGE_CASES}) AS v("case", payload)),
g AS (SELECT "case", CASE WHEN json_type(payload) = 'ARRAY' THEN CAST(payload AS JSON) ELSE coalesce({something('items')}, {something('scores')}, {something('results')}) END AS items FROM t)
SELECT "case", CASE WHEN json_type(items) = 'ARRAY' AND json_array_length(items) = 2 THEN array_to_string(list_transform(CAST(items AS JSON[]), lambda x: CAST(x AS VARCHAR)), '|') ELSE '0.0|0.0' END AS items FROM g""",
    "q_rejected_buffer": f"WITH {RX} SELECT example_id, rejection_reason FROM rx ORDER BY example_id DESC LIMIT 64",
    "q_stored_tail": f"WITH {EP} SELECT episode_id, topic, judge.normalized_reward AS reward, (SELECT count(*) FROM ep) AS n FROM ep ORDER BY episode_id DESC LIMIT 100",
    "q_grpo_examples": f"WITH {EP} SELECT episode_id, md5({_USER}) AS problem_md5, md5({PROGRAM}) AS code_md5, {FAILURE} AS observed_failure FROM ep",
    "q_fanned_out": f"""WITH {LOG}, r AS (SELECT episode_id, batch_id, judge.raw_text AS raw, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY episode_id) - 1 AS INTEGER) AS idx, count(*) OVER (PARTITION BY batch_id) AS n FROM s WHERE judge.raw_text IS NOT NULL),
t AS (SELECT batch_id, regexp_replace(arg_min(raw, episode_id), '^\\s+|\\s+$', '', 'g') AS t FROM r GROUP BY batch_id),
b AS (SELECT *, regexp_replace(replace(replace(t, '```json', ''), '```', ''), '^\\s+|\\s+$', '', 'g') AS bare FROM t),
k AS (SELECT *, regexp_extract(bare, '(?s)\\[.*\\]') AS arr, regexp_extract(bare, '(?s)\\{{.*\\}}') AS obj FROM b),
y AS (SELECT batch_id, CASE WHEN t <> '' AND json_valid(t) THEN t WHEN arr <> '' AND json_valid(arr) THEN arr WHEN obj <> '' AND json_valid(obj) THEN obj END AS payload FROM k),
g AS (SELECT batch_id, CASE WHEN json_type(payload) = 'ARRAY' THEN CAST(payload AS JSON) ELSE coalesce({something('items')}, {something('scores')}, {something('results')}) END AS items FROM y)
SELECT r.episode_id, r.idx, CASE WHEN json_type(items) = 'ARRAY' AND json_array_length(items) = r.n THEN CAST(json_extract_string(items, '$[' || r.idx || '].score') AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS score FROM r JOIN g USING (batch_id)""",
}
