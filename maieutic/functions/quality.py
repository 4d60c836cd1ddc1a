"""What can be told of a hint from its text and its task's, by built-in functions alone."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maieutic.functions.text import let, strip

# Traces of a text decoded with the wrong character set.
MOJIBAKE = ("вЂ", "â€™", "â€œ", "â€", "Ã", "�")
# Words that are never names of the task's own: keywords, built-ins, and words of tutoring.
KEYWORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
BUILTINS = (
    "ArithmeticError AssertionError AttributeError BaseException BaseExceptionGroup BlockingIOError BrokenPipeError BufferError BytesWarning ChildProcessError ConnectionAbortedError ConnectionError ConnectionRefusedError ConnectionResetError DeprecationWarning EOFError Ellipsis EncodingWarning EnvironmentError Exception ExceptionGroup FileExistsError FileNotFoundError FloatingPointError FutureWarning GeneratorExit IOError ImportError ImportWarning IndentationError IndexError InterruptedError IsADirectoryError KeyError KeyboardInterrupt LookupError MemoryError ModuleNotFoundError NameError NotADirectoryError NotImplemented NotImplementedError OSError OverflowError PendingDeprecationWarning PermissionError ProcessLookupError RecursionError ReferenceError ResourceWarning RuntimeError RuntimeWarning StopAsyncIteration StopIteration SyntaxError SyntaxWarning SystemError SystemExit TabError TimeoutError TypeError UnboundLocalError UnicodeDecodeError UnicodeEncodeError UnicodeError UnicodeTranslateError UnicodeWarning UserWarning ValueError Warning ZeroDivisionError "
    "__build_class__ __debug__ __doc__ __import__ __loader__ __name__ __package__ __spec__ abs aiter all anext any ascii bin bool breakpoint bytearray bytes callable chr classmethod compile complex copyright credits delattr dict dir divmod enumerate eval exec exit filter float format frozenset getattr globals hasattr hash help hex id input int isinstance issubclass iter len license list locals map max memoryview min next object oct open ord pow print property quit range repr reversed round set setattr slice sorted staticmethod str sum super tuple type vars zip"
).split()
TUTORING = "python task code error debugging debug student assistant hint question value values result results issue problem logic function variable branch state print repr type".split()
IGNORED = list(dict.fromkeys([*KEYWORDS, *BUILTINS, *TUTORING]))
# Phrases that fit any program, and words that show that a failure to compile, or a passing run, was noticed.
GENERIC = ("what do you expect", "trace through", "step by step", "small experiment", "what do you notice", "what happens if", "try printing")
COMPILE_NAMES = ("SyntaxError", "IndentationError", "TabError")
COMPILE_FAILURES = ("syntaxerror", "indentationerror", "taberror", "invalid syntax", "unexpected indent", "expected an indented block", "unindent does not match", "can't compile", "does not compile")
COMPILE_HINTS = ("syntaxerror", "indentationerror", "taberror", "does not compile", "doesn't compile", "compile", "compiles", "parser", "parsing", "syntax", "indent", "indentation", "unexpected indent", "invalid syntax", "expected an indented block", "line ", "colon")
PASSED_HINTS = ("no failing assertion", "no runtime error", "program exited successfully", "code already runs", "code already passes", "the code passes", "the asserts pass", "no reproduced error", "it passes")
NO_FAILURE = "No failing assertion or runtime error was reproduced."

IDENTIFIER = r"(?U)\b[A-Za-z_][A-Za-z0-9_]*\b"
_TEXTS = "array<string>"


def _any(text: Column, needles: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out


def _number(text: Column, needles: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for n in needles:
        out = out + F.contains(text, F.lit(n)).cast("int")
    return out


def kept(*reasons: Column) -> Column:
    """The reasons that are not null, each once, in order."""
    return F.array_distinct(F.filter(F.array(*reasons), lambda x: x.isNotNull()))


def corruption(text: Column) -> Column:
    """Reasons to take a text for damaged, in a fixed order; an empty array for a sound or null one."""
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    has = lambda p: F.rlike(t, F.lit(p))
    latin = has("[A-Za-z]")
    return kept(
        F.when(F.contains(low, F.lit("unicodeencodeerror")) | F.contains(low, F.lit("traceback")) & F.contains(low, F.lit("encode")), F.lit("encoding_traceback")),
        F.when(has(r"[\x{1F300}-\x{1FAFF}]"), F.lit("emoji")),
        F.when(has(r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]"), F.lit("cjk_script")),
        F.when(latin & has(r"[\x{0400}-\x{04FF}]"), F.lit("latin_cyrillic_mix")),
        F.when(latin & has(r"[\x{0600}-\x{06FF}]"), F.lit("latin_arabic_mix")),
        *(F.when(F.contains(t, F.lit(m)), F.lit(f"mojibake:{m}")) for m in MOJIBAKE),
    )


def identifiers(text: Column) -> Column:
    """All identifiers of a text, in order, with repetitions."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(0))


def ignored() -> Column:
    """IGNORED as one literal, folded before a query runs."""
    return F.split(F.lit(" ".join(IGNORED)), " ")


def own_identifiers(text: Column) -> Column:
    """The different identifiers of a text that are no keyword, built-in or word of tutoring."""
    return F.array_except(identifiers(text), ignored())


def error_name(text: Column) -> Column:
    """The first name of an error or exception in a text, or an empty text."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(?U)\b([A-Za-z_][A-Za-z0-9_]*(?:Error|Exception))\b", 1)


def assert_context(asserts: Column) -> Column:
    """The first three checks that are not blank, a line each."""
    full = F.filter(F.transform(F.coalesce(asserts, F.array().cast(_TEXTS)), strip), lambda x: x != "")
    return F.array_join(F.slice(full, 1, 3), "\n")


def fails_to_compile(name: Column, failure: Column) -> Column:
    return name.isin(*COMPILE_NAMES) | _any(F.lower(F.coalesce(failure, F.lit(""))), COMPILE_FAILURES)


def foreign_identifiers(hint: Column, allowed: Column) -> Column:
    """Names in code marks or before a bracket that the task does not have, sorted; single letters do not count."""
    t = F.coalesce(hint, F.lit(""))
    marked = F.flatten(F.transform(F.regexp_extract_all(t, F.lit("`([^`]+)`"), F.lit(1)), identifiers))
    called = F.regexp_extract_all(t, F.lit(r"(?U)\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))
    foreign = F.array_except(F.array_except(F.concat(marked, called), allowed), ignored())
    return F.array_sort(F.filter(foreign, lambda x: F.length(x) > 1))


def hint_context(program: Column, failure: Column, asserts: Column, target: Column, status: Column) -> Column:
    """What hint_quality has to know of a task: a struct. Parts that several fields share are worked out once a row by compiled code."""
    checks, goal, name = assert_context(asserts), strip(F.coalesce(target, F.lit(""))), error_name(failure)
    return F.struct(
        F.array_union(own_identifiers(F.concat_ws("\n", program, failure, checks)), F.when(goal != "", F.array(goal)).otherwise(F.array().cast(_TEXTS))).alias("allowed"),
        goal.alias("target"),
        checks.alias("checks"),
        name.alias("error_name"),
        F.coalesce(F.nullif(F.lower(strip(status)), F.lit("")), F.lit("failed")).alias("status"),
        fails_to_compile(name, failure).alias("compile_failure"),
    )


def prompt_context(prompt: Column) -> Column:
    """The same struct, read from the code and error blocks of a rendered prompt, or from all of a prompt without them."""
    p = F.coalesce(prompt, F.lit(""))
    block = lambda head, kind: F.regexp_extract(p, rf"(?s)## {head}\n```{kind}\n(.*?)\n```", 1)
    part = lambda head, kind: F.when(F.rlike(p, F.lit(rf"(?s)## {head}\n```{kind}\n.*?\n```")), block(head, kind)).otherwise(p)
    code, failure = part("Code", "python"), part("Error", "text")
    name = error_name(failure)
    return F.struct(
        own_identifiers(F.concat_ws("\n", code, failure)).alias("allowed"),
        F.lit("").alias("target"),
        F.lit("").alias("checks"),
        name.alias("error_name"),
        F.when(F.contains(p, F.lit(NO_FAILURE)), F.lit("passed")).otherwise(F.lit("failed")).alias("status"),
        fails_to_compile(name, failure).alias("compile_failure"),
    )


def hint_signs(hint: Column, context: Column) -> dict[str, Column]:
    """What is counted in a hint, by name: as columns of their own, so that each is worked out once before rated reads it."""
    t = F.coalesce(hint, F.lit(""))
    low, ids = F.lower(t), identifiers(t)
    return {
        "mentioned": F.array_except(F.array_intersect(ids, context["allowed"]), ignored()),
        "foreign": foreign_identifiers(t, context["allowed"]),
        "odd": (F.length(t) - F.length(F.replace(t, F.lit("`"), F.lit("")))) % 2 == 1,
        "named": F.size(F.array_intersect(own_identifiers(context["checks"]), ids)),
        "generic": _number(low, GENERIC),
        "saw_pass": _any(low, PASSED_HINTS),
        "saw_compile": _any(low, COMPILE_HINTS),
    }


def rated(hint: Column, context: Column, signs: Mapping[str, Column]) -> Column:
    """delta, severe, reasons, mentioned, foreign out of what hint_signs counted: a struct."""
    d = lambda c, x: F.when(c, x if isinstance(x, Column) else F.lit(x)).otherwise(F.lit(0.0))
    reason = lambda c, x: F.when(c, F.lit(x))
    t = F.coalesce(hint, F.lit(""))
    low, n, name, target = F.lower(t), F.size(signs["mentioned"]), context["error_name"], context["target"]
    odd, generic, foreign, saw_compile, saw_pass = (signs[k] for k in ("odd", "generic", "foreign", "saw_compile", "saw_pass"))
    passed, broken = context["status"] == "passed", context["compile_failure"]
    is_generic, is_foreign, missed, missed_compile = (generic > 0) & (n < 2), F.size(foreign) > 0, passed & ~saw_pass, broken & ~saw_compile
    delta = (
        d(odd, -1.1)
        + d((target != "") & F.contains(t, target), 0.45)
        + d((name != "") & F.contains(t, name), 0.35)
        + F.least(F.lit(0.55), 0.14 * signs["named"])
        + F.least(F.lit(0.55), 0.12 * n)
        - d(is_generic, F.least(F.lit(0.8), 0.25 * generic))
        - d(is_foreign, F.least(F.lit(2.6), 1.0 * F.size(foreign)))
        + d(passed & saw_pass, 0.35)
        - d(missed, 3.0)
        + d(broken & (name != "") & F.contains(low, F.lower(name)), 0.25)
        + d(broken & saw_compile, 0.45)
        - d(missed_compile, 2.4)
    )
    return F.struct(
        delta.alias("delta"),
        (missed | is_foreign & odd).alias("severe"),
        kept(reason(odd, "unbalanced_backticks"), reason(is_generic, "generic_hint"), reason(is_foreign, "hallucinated_identifiers"), reason(missed, "missed_passed_execution"), reason(missed_compile, "missed_compile_failure")).alias("reasons"),
        F.array_sort(signs["mentioned"]).alias("mentioned"),
        foreign.alias("foreign"),
    )


def hint_quality(hint: Column, context: Column) -> Column:
    """rated in one expression: how well a hint keeps to its task, by counting. Over many rows with_quality is quicker."""
    return let(lambda v: rated(v["t"], v["c"], {k: v[k] for k in hint_signs(v["t"], v["c"])}), t=hint, c=context, **hint_signs(hint, context))


def with_quality(rows: DataFrame, hint: str, context: Column, name: str) -> DataFrame:
    """rows with rated as a column of that name, in three projections, each of which reads what the one before worked out once."""
    own = {k: f"_{name}_{k}" for k in ("context", "mentioned", "foreign", "odd", "named", "generic", "saw_pass", "saw_compile")}
    read = rows.withColumn(own["context"], context)
    signs = hint_signs(F.col(hint), F.col(own["context"]))
    read = read.withColumns({own[k]: c for k, c in signs.items()})
    return read.withColumn(name, rated(F.col(hint), F.col(own["context"]), {k: F.col(own[k]) for k in signs})).drop(*own.values())
