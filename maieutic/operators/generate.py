"""Where models and programs come in: generators behind one interface, retries without loops over rows, and a guarded runner."""

from __future__ import annotations

import json
import os
import resource
import subprocess
import sys
import tempfile
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maieutic.session import stored

# What the outcome of a run says where the program itself says nothing.
PASSED = "Program exited successfully. No failing assertion or runtime error was reproduced."
FAILED = "Process failed with return code {}."
TIMED_OUT = "TimeoutError: task execution exceeded {} seconds."


class Generator(Protocol):
    """Answers a batch of rendered prompts of one role; made once in each Python worker."""

    def __call__(self, role: str, prompts: list[str]) -> list[str]: ...


def stub(role: str, prompts: list[str]) -> list[str]:
    """A deterministic stand-in for a model."""
    return [f"[{role}] {p.strip().splitlines()[-1][:80] if p.strip() else ''}" for p in prompts]


def generated(requests: DataFrame, key: str, prompt: str, role: str, make: Callable[[], Generator] = lambda: stub, batch: int = 32) -> DataFrame:
    """key, answer for each request; the generator is made once a task and asked for `batch` prompts at a time."""
    rows = requests.select(key, F.coalesce(F.col(prompt), F.lit("")).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            for part in (b.slice(i, batch) for i in range(0, b.num_rows, batch)):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model(role, part.column(1).to_pylist()), pa.string())], names=[key, "answer"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, answer string")


def replayed(requests: DataFrame, recorded: DataFrame, key: str, prompt: str) -> DataFrame:
    """key, answer from recorded answers (prompt, answer), matched on the prompt; null without one."""
    known = recorded.select(F.col("prompt").alias("_p"), "answer").dropDuplicates(["_p"])
    return requests.join(known, F.col(prompt) == F.col("_p"), "left").select(key, "answer")


def with_retries(requests: DataFrame, key: str, attempt: Callable[[DataFrame, int], DataFrame], accepts: Column, attempts: int = 4) -> tuple[DataFrame, DataFrame]:
    """The first accepted answer of each request, and all rejected ones, each with its attempt.

    attempt(requests, number) answers the requests that are still open; `attempts`
    rounds at most, whatever the number of requests. Each round is stored, so that no
    answer is generated twice.
    """
    left, done, failed = requests, None, None
    for i in range(1, attempts + 1):
        answers = stored(attempt(left, i).withColumn("attempt", F.lit(i)))
        good, bad = answers.where(accepts), answers.where(~F.coalesce(accepts, F.lit(False)))
        done = good if done is None else done.unionByName(good)
        failed = bad if failed is None else failed.unionByName(bad)
        left = left.join(good.select(key), key, "left_anti")
    return done, failed


def run_program(program: str, timeout: float = 12.0, most: int = 1600) -> tuple[str, int, str, str, str, float]:
    """status, returncode, error_message, stdout, stderr, duration of a program in a process of its own: isolated mode, an empty environment, bounded memory, output files and time."""

    def limits() -> None:
        resource.setrlimit(resource.RLIMIT_AS, (1 << 30, 1 << 30))
        resource.setrlimit(resource.RLIMIT_FSIZE, (1 << 20, 1 << 20))
        resource.setrlimit(resource.RLIMIT_CPU, (int(timeout) + 1, int(timeout) + 1))
        resource.setrlimit(resource.RLIMIT_NPROC, (256, 256))

    end = lambda s: (s or "").strip()[-most:]
    began = time.monotonic()
    with tempfile.TemporaryDirectory() as d:
        path = os.path.join(d, "task.py")
        with open(path, "w", encoding="utf-8") as f:
            f.write(program)
        try:
            p = subprocess.run([sys.executable, "-I", "-B", path], cwd=d, env={}, capture_output=True, text=True, errors="replace", timeout=timeout, preexec_fn=limits, check=False)
        except subprocess.TimeoutExpired as e:
            text = lambda b: b.decode("utf-8", "replace") if isinstance(b, bytes) else b or ""
            return "timeout", -9, TIMED_OUT.format(timeout), end(text(e.stdout)), end(text(e.stderr)), time.monotonic() - began
    out, err = end(p.stdout), end(p.stderr)
    if p.returncode == 0:
        return "passed", 0, PASSED, out, err, time.monotonic() - began
    return "failed", p.returncode, err or out or FAILED.format(p.returncode), out, err, time.monotonic() - began


def executed(tasks: DataFrame, key: str, program: Column, enabled: bool = False, timeout: float = 12.0, most: int = 1600) -> DataFrame:
    """key and the outcome of running each program. It runs code that nobody has read: off unless enabled."""
    if not enabled:
        raise PermissionError("running programs is off; pass enabled=True on a machine made for it")
    rows = tasks.select(key, F.coalesce(program, F.lit("")).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64())
        names = ["status", "returncode", "error_message", "stdout", "stderr", "duration_seconds"]
        for b in batches:
            out = [run_program(p, timeout, most) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))], names=[key, *names])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, status string, returncode int, error_message string, stdout string, stderr string, duration_seconds double")


def with_execution(tasks: DataFrame, outcomes: DataFrame, key: str, metadata: str) -> DataFrame:
    """tasks with execution, execution_status and observed_failure in their metadata, JSON text; outcomes as of executed.

    Metadata that is null or no JSON object starts empty; a task without an outcome stays as it is.
    """
    names = ["status", "returncode", "error_message", "stdout", "stderr", "duration_seconds"]
    found = outcomes.select(F.col(key).alias("_k"), F.to_json(F.struct(*names)).alias("_run"))

    @F.pandas_udf("string")
    def merged(meta, run):
        def one(m, r):
            if r is None:
                return m
            try:
                known = json.loads(m) if m else {}
            except ValueError:
                known = {}
            known = known if isinstance(known, dict) else {}
            run = json.loads(r)
            return json.dumps(known | {"execution": run, "execution_status": run["status"], "observed_failure": run["error_message"]}, ensure_ascii=False)

        return meta.combine(run, one)

    joined = tasks.join(found, tasks[key] == F.col("_k"), "left")
    return joined.withColumn(metadata, merged(F.col(metadata), F.col("_run"))).select(*tasks.columns)
