"""Scalar text functions over columns; all of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line breaks of text, the question that stands in for an empty hint, the failure that stands in for none, and the sentence on a topic's reward.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
DEFAULT_HINT = "Which assertion fails first, and what concrete value do you see right before it?"
DEFAULT_FAILURE = "AssertionError"
WEAKNESS = "Recent normalized Socratic reward for '%s' is %.3f. Generate a task that is likely to expose the same weakness more clearly."


def let(body: Callable[[Column], Column], **values: Column) -> Column:
    """body of a struct of the values, each computed once a row, however often body uses it.

    Without it, an expression that occurs in several branches is evaluated in each of them.
    """
    return F.get(F.transform(F.array(F.struct(*(c.alias(k) for k, c in values.items()))), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def lines(text: Column) -> Column:
    """The lines of a text; none for an empty one, and none behind a closing line break."""
    def cut(v: Column) -> Column:
        parts = v["parts"]
        return F.when(v["t"] == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)

    return F.when(text.isNotNull(), let(cut, t=text, parts=F.split(text, LINE_BREAK)))


def or_default(text: Column, default: str | Column) -> Column:
    """text, unless it is null or empty."""
    d = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(text, F.lit("")), d)


def filled_lines(text: Column) -> Column:
    return F.filter(lines(text), lambda x: strip(x) != "")


def filled_line_count(text: Column) -> Column:
    """Lines that hold more than white space; 0 for null."""
    return F.coalesce(F.size(filled_lines(text)), F.lit(0))


def combined_program(body: Column, asserts: Column) -> Column:
    """The program, a blank line, and the stripped checks that are not blank; either part alone where the other is empty."""
    b = rstrip(F.coalesce(body, F.lit("")))
    t = F.array_join(F.filter(F.transform(F.coalesce(asserts, F.array().cast("array<string>")), strip), lambda x: x != ""), "\n")
    return let(lambda v: F.when(v["b"] == "", v["t"]).when(v["t"] == "", v["b"]).otherwise(rstrip(F.concat(v["b"], F.lit("\n\n"), v["t"]))), b=b, t=t)


def observed_failure(recorded: Column) -> Column:
    return or_default(recorded, DEFAULT_FAILURE)


def split_asserts(program: Column) -> tuple[Column, Column]:
    """The program without its assert lines, and those lines; both stripped on the right."""
    own = lines(F.coalesce(program, F.lit("")))
    check = lambda x: F.startswith(strip(x), F.lit("assert "))
    body = F.array_join(F.transform(F.filter(own, lambda x: ~check(x)), rstrip), "\n")
    return rstrip(body), F.transform(F.filter(own, check), rstrip)


def sanitized_hint(raw: Column, most_lines: int = 4, most_words: int = 120) -> Column:
    """A hint without thoughts, code blocks and blank lines, of at most so many lines and words; a standard question for one of nothing else."""
    t = strip(F.coalesce(raw, F.lit("")))
    t = F.regexp_replace(t, r"(?is)<think>.*?</think>", "")
    t = F.replace(F.replace(t, F.lit("<think>"), F.lit("")), F.lit("</think>"), F.lit(""))
    t = F.regexp_replace(t, r"(?s)```.*?```", "")
    t = strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))
    kept = F.filter(F.transform(lines(t), strip), lambda x: x != "")
    short = lambda v: F.when(F.size(v["words"]) > most_words, F.array_join(F.slice(v["words"], 1, most_words), " ")).otherwise(v["joined"])
    joined = lambda v: let(short, joined=v["joined"], words=F.split(v["joined"], r"(?U)\s+"))
    return let(lambda v: F.when(F.size(v["kept"]) == 0, F.lit(DEFAULT_HINT)).otherwise(let(joined, joined=strip(F.array_join(F.slice(v["kept"], 1, most_lines), "\n")))), kept=kept)


def tail(text: Column, n: int) -> Column:
    """The last n characters of the stripped text."""
    return F.right(strip(text), F.lit(n))


def topic_key(topic: Column) -> Column:
    """Lower case, underscores as blanks, runs of blanks as one, trimmed."""
    return strip(F.regexp_replace(F.lower(F.replace(topic, F.lit("_"), F.lit(" "))), r"(?U)\s+", " "))


def weakness_summary(topic: Column, reward: Column) -> Column:
    """A sentence on a topic's reward; three decimals, halves away from zero; 0.5 where there is no reward yet."""
    return F.format_string(WEAKNESS, topic, F.coalesce(reward, F.lit(0.5)))


def grpo_example(statement: Column, program: Column, recorded: Column) -> Column:
    """problem, code and observed_failure of a task: a struct."""
    return F.struct(F.coalesce(statement, F.lit("")).alias("problem"), program.alias("code"), observed_failure(recorded).alias("observed_failure"))


def rendered_chat(messages: Column, ask: bool = False) -> Column:
    """ROLE: content of each message, with a blank line between; a missing role is a user's. ask: ends in ASSISTANT:."""
    said = F.transform(messages, lambda m: F.concat(F.upper(or_default(m["role"], "user")), F.lit(": "), F.coalesce(m["content"], F.lit(""))))
    return F.array_join(F.concat(said, F.array(F.lit("ASSISTANT:"))) if ask else said, "\n\n")


def user_text(messages: Column) -> Column:
    """The last user message, else the last message, else an empty text; stripped."""
    users = F.filter(messages, lambda m: m["role"] == "user")
    last = lambda a: F.get(a, F.size(a) - 1)["content"]
    return strip(F.coalesce(F.when(F.size(users) > 0, F.coalesce(last(users), F.lit(""))), F.when(F.size(messages) > 0, last(messages)), F.lit("")))


def completion_text(messages: Column) -> Column:
    """The first message's content, stripped; an empty text without one."""
    return strip(F.coalesce(F.get(messages, F.lit(0))["content"], F.lit("")))


def unit_draw(text: Column) -> Column:
    """A number from 0 to below 1 that a text determines: the first 32 bits of its MD5 digest."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
