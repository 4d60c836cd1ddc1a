"""How a text ends: complete, cut, or open to doubt."""

from __future__ import annotations

import json
import re

#: A text that says itself that it was cut.
_MARK = re.compile(r"(?:…|\.\.\.\s*\[?\(?(?:cut|clipped|truncated|output clipped|snip|more)\]?\)?|<snip>?|\[(?:cut|truncated|clipped|snip)\]|\((?:output )?(?:clipped|truncated|cut)\)|�)\s*$", re.I)
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_FENCE = re.compile(r"^[ \t]*(```|~~~)", re.M)
_OPEN_TAG = re.compile(r"<([a-z][a-z_\-]*)>")
_HALF_TAG = re.compile(r"</?[a-z_\-]*$")
_LABEL = re.compile(r"^(?:-- ?\S.*|[^\W\d][\w ]*: ?\S.*|[A-Z]{2,}|[A-Z]\w* \d[\d.,%]*)$")
_LIST = re.compile(r"^\s*(?:\d+[.)]|[-*•])(?:\s|$)")
_KEYWORDS = re.compile(r"(?:^|[.?!)\"»”]\s)([^\W\d]\w{2,}: ?[\w\-]+(?:, ?[\w\-]+)*,?)$")
_WORDLIKE = re.compile(r"\w")
_NAME = re.compile(r"(?<=\s)[A-ZÀ-Þ]\w*")
_DIGITS = re.compile(r"\d+")
_DECODER = json.JSONDecoder()

#: Verdicts. DOUBT: complete in form, but its last word or number may have lost its end.
BLANK, COMPLETE, CUT, DOUBT = "blank", "complete", "cut", "doubt"


def _json_end(text: str, at: int) -> int:
    """Where the JSON value that begins at `at` ends; -1 if it does not."""
    try:
        return _DECODER.raw_decode(text, at)[1]
    except (ValueError, RecursionError):
        pass
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c == '"':
            m = _STRING.match(text, i)
            if not m:
                return -1
            i = m.end()
            continue
        if c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth <= 0:
                return i + 1
        i += 1
    return -1


def json_start(text: str) -> int:
    """Where a text's JSON begins: at its first character, or on a line of its own behind a lead-in or a fence; -1 without."""
    m = re.search(r"(?:\A|\n)\s*(?=[\[{]\s*(?:[\"'{\[\]}\d-]|true|false|null|\Z))", text)
    return m.end() if m else -1


def tail_shape(line: str) -> str:
    """The line with numbers and names made equal."""
    return _DIGITS.sub("9", _NAME.sub("N", line))


def _prose(text: str, may_end_bare: bool) -> tuple[str, str | None]:
    s = text.rstrip()
    if _MARK.search(s) or _HALF_TAG.search(s):
        return CUT, None
    fences = len(_FENCE.findall(s))
    if fences % 2:
        return CUT, None
    if fences and re.search(r"(?:^|\n)[ \t]*(?:```|~~~)$", s):
        return COMPLETE, None
    for tag in set(_OPEN_TAG.findall(s)):
        if s.rfind(f"<{tag}>") > s.rfind(f"</{tag}>"):
            return CUT, None
    last = s[s.rfind("\n") + 1 :]
    if re.search(r"</[a-z_\-]+>$", last):
        return COMPLETE, None
    plain = re.sub(r"`[^`\n]*`", "x", last)
    if "`" in plain or plain.count("(") > plain.count(")"):
        return CUT, None
    if plain.count('"') % 2 and s.count('"') % 2:
        return CUT, None
    if _LIST.match(last) and re.match(r"^\s*(?:\d+[.)]|[-*•])\s*$", last):
        return CUT, None
    core = s.rstrip(")]\"'»”’*_ ")
    own_line = "\n" in s
    if own_line and not _LIST.match(last) and _LABEL.match(last.strip()) and len(last.split()) <= 5 and not (core[-1:] in ".?!" and " " in last.strip() and ":" not in last):
        shape = tail_shape(last.strip())
        return (DOUBT if re.search(r"\sN$|9$", shape) else COMPLETE), shape
    if own_line and len(last.split()) <= 3 and re.search(r"\d\.$", last):
        return CUT, None
    if core[-1:] in ".?!。":
        return COMPLETE, None
    if m := _KEYWORDS.search(plain):
        return COMPLETE, tail_shape(m[1])
    if may_end_bare:
        return (CUT if core.endswith(("-", ",", ":", ";")) else DOUBT), tail_shape(last)
    return CUT, None


def ending(text: str | None) -> tuple[str, str | None]:
    """The verdict on a text's end, and for an ending without a sentence mark the shape of its last line.

    Cut: inside a JSON value, a code block, a tagged block, quotation marks, brackets
    or code marks; behind a marker of cutting; or inside a sentence. A short label
    line, a signature, a keyword list, and prose behind a JSON value need no mark;
    where such an ending closes with a name or number, the verdict is doubt.
    """
    if text is None or not _WORDLIKE.search(text):
        return BLANK, None
    at = json_start(text)
    if at < 0:
        return _prose(text, False)
    head = text[:at]
    end = _json_end(text, at)
    if end < 0:
        return CUT, None
    rest = text[end:]
    if len(_FENCE.findall(head)) % 2:
        m = re.match(r"\s*(?:```|~~~)", rest)
        if not m:
            return CUT, None
        rest = rest[m.end() :]
    if not rest.strip():
        return COMPLETE, None
    return _prose(rest, True)
