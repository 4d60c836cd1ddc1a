"""Prompts rendered from columns. The wording is a parameter; each function's default is this engine's own."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from maieutic.functions.text import or_default

TUTOR = "You tutor Python debugging. Ask one or two short guiding questions that name the failing check, error, function or variable. Give no solution and no corrected code."
ADVERSARY = "You write faulty Python programs for debugging practice. Plan the fault first, then write the whole program with its checks at the end. Answer with JSON only."
GRADER = "You grade debugging hints from 0 to 10. Judge the task and the hint apart. Answer with a JSON array of one object an item, in the order of the items."
SPEC_KEYS = ("topic", "target_function", "intended_bug", "expected_first_failure", "metadata")
TASK_KEYS = (*SPEC_KEYS[:4], "statement", "buggy_solution", "metadata")


def chat(*messages: tuple[str, Column | str]) -> Column:
    """An array of role and content."""
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.array(*(F.struct(F.lit(r).alias("role"), text(c).alias("content")) for r, c in messages))


def tutor_text(statement: Column, program: Column, failure: Column, ask: str = "Ask one or two guiding questions that help me find the bug without giving the answer.") -> Column:
    """Task, code, error and instruction under headings; the code and error blocks are those that prompt_context reads."""
    block = lambda head, kind, body: F.concat(F.lit(f"## {head}\n```{kind}\n"), F.coalesce(body, F.lit("")), F.lit("\n```\n\n"))
    return F.concat(F.lit("## Task\n"), F.coalesce(statement, F.lit("")), F.lit("\n\n"), block("Code", "python", program), block("Error", "text", failure), F.lit(f"## Instruction\n{ask}"))


def tutor_chat(statement: Column, program: Column, failure: Column) -> Column:
    return chat(("system", TUTOR), ("user", tutor_text(statement, program, failure)))


def spec_text(topic: Column, focus: Column) -> Column:
    """Asks for the plan of a faulty program; without a focus, for any fault of the topic."""
    return F.concat(F.lit("Topic: "), F.coalesce(topic, F.lit("")), F.lit("\nFocus: "), or_default(focus, "any weakness within the topic"), F.lit(f"\n\nPlan one fault. Answer with a JSON object of {', '.join(SPEC_KEYS)}."))


def spec_chat(topic: Column, focus: Column) -> Column:
    return chat(("system", ADVERSARY), ("user", spec_text(topic, focus)))


def task_text(spec: Column) -> Column:
    """Asks for the program of an approved plan, given as JSON text."""
    return F.concat(F.lit("Write the program of this plan.\n"), F.coalesce(spec, F.lit("{}")), F.lit(f"\n\nKeep the topic. Answer with a JSON object of {', '.join(TASK_KEYS)}."))


def repair_text(what: str, topic: Column, reasons: Column, spec: Column | None = None) -> Column:
    """Asks for a new spec or task, with the reasons against the last one, and the plan to keep to where there is one."""
    why = F.when(F.coalesce(F.size(reasons), F.lit(0)) > 0, F.array_join(reasons, ", ")).otherwise(F.lit("unspecified issue"))
    text = F.concat(F.lit(f"Write the {what} for topic '"), F.coalesce(topic, F.lit("")), F.lit("' anew. Against the last one: "), why, F.lit(". Answer with JSON only."))
    return text if spec is None else F.concat(text, F.coalesce(F.concat(F.lit("\nKeep to this plan: "), spec), F.lit("")))


def grading_text(items: Column) -> Column:
    """The number of items, and the items as a JSON array; items: an array of structs in order."""
    return F.concat(F.lit("N = "), F.size(items).cast("string"), F.lit("\n\n"), F.to_json(items, {"ignoreNullFields": "false"}))


def grading_chat(items: Column, weights: Mapping[str, float]) -> Column:
    return chat(("system", f"{GRADER} Weights: {json.dumps(dict(weights))}"), ("user", grading_text(items)))


def training_text(topic: Column, focus: Column, spec: Column | None = None) -> Column:
    """The prompt under which a task is kept as a training example."""
    text = F.concat(F.lit("Write a faulty Python program for topic '"), F.coalesce(topic, F.lit("")), F.lit("'. Weakness to expose: "), or_default(focus, "general weakness probing"), F.lit(f". Answer with a JSON object of {', '.join(TASK_KEYS)}."))
    return text if spec is None else F.concat(text, F.coalesce(F.concat(F.lit(" Plan: "), spec), F.lit("")))


def hard_example_text(topic: Column, focus: Column, failure: Column, spec: Column | None = None, most: int = 600) -> Column:
    return F.concat(training_text(topic, focus, spec), F.lit(" Reproduced failure: "), F.left(failure, F.lit(most)))
