"""Syntax checks for the languages that source files are tried against.

Each grammar is a function that returns None for a text it accepts, or a short
reason. Python, JSON, TOML and XML use the parsers of the standard library; the
others are recursive-descent parsers over a token list, written for the common
core of each language.
"""

from __future__ import annotations

import ast
import json
import re
import tomllib
import warnings
import xml.parsers.expat
from collections.abc import Callable

warnings.filterwarnings("ignore", category=SyntaxWarning)
warnings.filterwarnings("ignore", category=DeprecationWarning)


class Rejected(Exception):
    pass


#: The reason of a parser that ran out of stack or memory: the text may be sound all the same.
BEYOND = "beyond the limits of the parser"


def python3(text: str) -> str | None:
    try:
        ast.parse(text)
    except SyntaxError as e:
        return f"{type(e).__name__}: {e.msg}"
    except (RecursionError, MemoryError):
        return BEYOND
    except (ValueError, UnicodeError) as e:
        return f"{type(e).__name__}: {str(e)[:80]}"
    return None


_PRINT = re.compile(r"^(\s*)print\s+(?!\()(?:>>\s*\w+\s*,)?(.*?),?\s*$", re.M)
_EXCEPT = re.compile(r"^(\s*except\s+[\w.()\s,]+?)\s*,\s*(\w+)\s*:", re.M)
_RAISE = re.compile(r"^(\s*raise\s+[\w.]+)\s*,\s*(.+)$", re.M)


def python2(text: str) -> str | None:
    """Python 2 by rewriting its own statements into those of Python 3."""
    new = _PRINT.sub(r"\1print(\2)", text)
    new = _EXCEPT.sub(r"\1 as \2:", new)
    new = _RAISE.sub(r"\1(\2)", new)
    new = re.sub(r"\b(0[0-7]+)\b", lambda m: "0o" + m[1][1:], new) if re.search(r"\b0[0-7]+\b", new) else new
    new = re.sub(r"(\d)[lL]\b", r"\1", new).replace("<>", "!=")
    if new == text:
        return "nothing of Python 2 in it"
    return python3(new)


def json_text(text: str) -> str | None:
    try:
        json.loads(text)
    except (ValueError, RecursionError) as e:
        return str(e)[:80]
    return None


def json_comments(text: str) -> str | None:
    """JSON with comments and trailing commas."""
    out, i, string = [], 0, re.compile(r'"(?:[^"\\\n]|\\.)*"')
    while i < len(text):
        if text[i] == '"' and (m := string.match(text, i)):
            out.append(m[0])
            i = m.end()
        elif m := re.compile(r"//[^\n]*|/\*.*?\*/", re.S).match(text, i):
            i = m.end()
        else:
            out.append(text[i])
            i += 1
    return json_text(re.sub(r",(\s*[}\]])", r"\1", "".join(out)))


def toml(text: str) -> str | None:
    try:
        tomllib.loads(text)
    except (ValueError, RecursionError) as e:
        return str(e)[:80]
    return None


def xml_text(text: str) -> str | None:
    try:
        xml.parsers.expat.ParserCreate().Parse(text.strip(), True)
    except (xml.parsers.expat.ExpatError, ValueError) as e:
        return str(e)[:80]
    return None


class Tokens:
    """A cursor over (kind, text, preceded by a line break)."""

    def __init__(self, items: list[tuple[str, str, bool]]):
        self.items, self.i = [*items, ("end", "", True)], 0

    @property
    def kind(self) -> str:
        return self.items[self.i][0]

    @property
    def text(self) -> str:
        return self.items[self.i][1]

    @property
    def fresh(self) -> bool:
        return self.items[self.i][2]

    def ahead(self, k: int = 1) -> tuple[str, str, bool]:
        return self.items[min(self.i + k, len(self.items) - 1)]

    def next(self) -> str:
        t = self.text
        self.i = min(self.i + 1, len(self.items) - 1)
        return t

    def at(self, *texts: str) -> bool:
        return self.kind not in ("string", "end") and self.text in texts

    def take(self, *texts: str) -> bool:
        if self.at(*texts):
            self.next()
            return True
        return False

    def need(self, *texts: str) -> None:
        if not self.take(*texts):
            raise Rejected(f"expected {' or '.join(texts)}, found {self.text[:20] or 'the end'}")

    def name(self) -> str:
        if self.kind != "word":
            raise Rejected(f"expected a name, found {self.text[:20] or 'the end'}")
        return self.next()


def scan(text: str, pattern: re.Pattern) -> Tokens:
    items, i, fresh = [], 0, True
    while i < len(text):
        m = pattern.match(text, i)
        if not m:
            raise Rejected(f"stray {text[i]!r}")
        kind = m.lastgroup
        if kind == "skip":
            fresh |= "\n" in m[0]
        else:
            items.append((kind, m[0], fresh))
            fresh = False
        i = m.end()
    return Tokens(items)


_CLIKE = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)
    |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)
    |(?P<number>0[xXbBoO][\da-fA-F_]+[nL]?|(?:\d[\d_]*\.?[\d_]*|\.\d+)(?:[eE][+-]?\d+)?[nLfFdD]?)
    |(?P<word>[^\W\d][\w$]*|\$[\w$]*|[#@][^\W\d]\w*)
    |(?P<punct>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|->|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|::|[-{}()\[\];,<>+*/%&|^!~?:=.])
    """,
    re.X | re.S,
)
_BINARY = {
    "||": 1, "??": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "===": 6, "!==": 6,
    "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "in": 7, "<<": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "**": 11,
}
_ASSIGN = ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "**=", "&&=", "||=", "??=")
_RESERVED = {"if", "else", "for", "while", "do", "return", "switch", "case", "break", "continue", "try", "catch", "finally", "throw", "const", "var", "import", "export", "default", "in", "instanceof"}


class CLike:
    """What JavaScript and Java have in common: expressions, blocks and control flow."""

    def __init__(self, t: Tokens):
        self.t = t

    def expression(self) -> None:
        self.assignment()
        while self.t.take(","):
            self.assignment()

    def assignment(self) -> None:
        t = self.t
        if self.arrow():
            return
        self.binary(1)
        if t.take("?"):
            self.assignment()
            t.need(":")
            self.assignment()
        if t.at(*_ASSIGN):
            t.next()
            self.assignment()

    def arrow(self) -> bool:
        """x => ..., (a, b) => ..., (a, b) -> ..."""
        t, k = self.t, 0
        if t.at("async") and t.ahead()[1] in ("(",):
            t.next()
        if t.kind == "word" and t.ahead()[1] in ("=>", "->"):
            t.next()
        elif t.at("("):
            depth = 0
            while True:
                kind, x, _ = t.ahead(k)
                if kind == "end":
                    return False
                depth += (x == "(") - (x == ")") if kind == "punct" else 0
                k += 1
                if not depth:
                    break
            if t.ahead(k)[1] not in ("=>", "->"):
                return False
            self.parameters()
        else:
            return False
        t.next()
        self.block() if t.at("{") else self.assignment()
        return True

    def parameters(self) -> None:
        t = self.t
        t.need("(")
        while not t.at(")"):
            t.take("...")
            self.target()
            if t.take("="):
                self.assignment()
            if not t.take(","):
                break
        t.need(")")

    def target(self) -> None:
        if self.t.at("[", "{"):
            self.primary()
        else:
            self.t.name()

    def binary(self, least: int) -> None:
        t = self.t
        self.unary()
        while t.kind in ("punct", "word") and (p := _BINARY.get(t.text, 0)) >= least:
            op = t.next()
            if op == ">" and t.at(">", ">="):
                t.next()
            if op == "instanceof" and self.t.kind == "word" and self.t.ahead()[0] == "word":
                t.next()
            self.binary(p + 1)

    def unary(self) -> None:
        t = self.t
        while t.at("!", "~", "+", "-", "++", "--", "typeof", "void", "delete", "await"):
            t.next()
        self.postfix()

    def postfix(self) -> None:
        t = self.t
        self.primary()
        while True:
            if t.take(".", "?.", "::"):
                if t.at("(", "["):
                    continue
                t.name()
            elif t.at("("):
                self.arguments()
            elif t.take("["):
                self.expression()
                t.need("]")
            elif t.kind == "string" and t.text[0] == "`":
                t.next()
            elif t.at("++", "--") and not t.fresh:
                t.next()
            else:
                return

    def arguments(self) -> None:
        t = self.t
        t.need("(")
        while not t.at(")"):
            t.take("...")
            self.assignment()
            if not t.take(","):
                break
        t.need(")")

    def primary(self) -> None:
        t = self.t
        if t.kind in ("string", "number"):
            t.next()
        elif t.take("("):
            self.expression()
            t.need(")")
        elif t.take("["):
            while not t.at("]"):
                if t.take(","):
                    continue
                t.take("...")
                self.assignment()
                if not t.at("]"):
                    t.need(",")
            t.need("]")
        elif t.at("{"):
            self.literal()
        elif t.kind == "word" and t.text not in _RESERVED:
            self.word()
        else:
            raise Rejected(f"unexpected {t.text[:20] or 'end'}")

    def word(self) -> None:
        self.t.next()

    def literal(self) -> None:
        raise Rejected("unexpected {")

    def block(self) -> None:
        t = self.t
        t.need("{")
        while not t.at("}"):
            if t.kind == "end":
                raise Rejected("a block is not closed")
            self.statement()
        t.need("}")

    def end(self) -> None:
        self.t.need(";")

    def condition(self) -> None:
        self.t.need("(")
        self.expression()
        self.t.need(")")

    def statement(self) -> None:
        t = self.t
        if t.take(";"):
            return
        if t.at("{"):
            return self.block()
        if t.take("if"):
            self.condition()
            self.statement()
            if t.take("else"):
                self.statement()
        elif t.take("while"):
            self.condition()
            self.statement()
        elif t.take("do"):
            self.statement()
            t.need("while")
            self.condition()
            t.take(";")
        elif t.take("for"):
            t.take("await")
            t.need("(")
            self.for_head()
            t.need(")")
            self.statement()
        elif t.take("return", "throw"):
            if not t.at(";", "}") and not t.fresh:
                self.expression()
            self.end()
        elif t.take("break", "continue"):
            if t.kind == "word" and not t.fresh:
                t.next()
            self.end()
        elif t.take("try"):
            if t.at("("):
                t.next()
                self.declaration()
                t.need(")")
            self.block()
            while t.take("catch"):
                if t.take("("):
                    while not t.at(")"):
                        if t.kind == "end":
                            raise Rejected("catch is not closed")
                        t.next()
                    t.next()
                self.block()
            if t.take("finally"):
                self.block()
        elif t.take("switch"):
            self.condition()
            t.need("{")
            while not t.take("}"):
                if t.take("default"):
                    pass
                else:
                    t.need("case")
                    self.expression()
                t.need(":", "->")
                while not t.at("case", "default", "}"):
                    if t.kind == "end":
                        raise Rejected("switch is not closed")
                    self.statement()
        else:
            self.other()

    def for_head(self) -> None:
        t = self.t
        if not t.at(";"):
            self.declaration() if self.declares() else self.expression()
        if t.take("of", "in", ":"):
            return self.expression()
        t.need(";")
        if not t.at(";"):
            self.expression()
        t.need(";")
        if not t.at(")"):
            self.expression()

    def declares(self) -> bool:
        raise NotImplementedError

    def declaration(self) -> None:
        raise NotImplementedError

    def other(self) -> None:
        if self.declares():
            self.declaration()
        else:
            self.expression()
        self.end()

    def unit(self) -> None:
        while self.t.kind != "end":
            self.statement()


class JavaScript(CLike):
    def end(self) -> None:
        t = self.t
        if not (t.take(";") or t.at("}") or t.fresh or t.kind == "end"):
            raise Rejected(f"unexpected {t.text[:20]}")

    def declares(self) -> bool:
        return self.t.at("var", "const") or self.t.at("let") and self.t.ahead()[1] not in ("=", ".", "(")

    def declaration(self) -> None:
        t = self.t
        t.next()
        while True:
            self.target()
            if t.take("="):
                self.assignment()
            if not t.take(","):
                return

    def literal(self) -> None:
        t = self.t
        t.need("{")
        while not t.at("}"):
            if t.take("..."):
                self.assignment()
            else:
                if t.at("get", "set", "async", "static", "*") and t.ahead()[1] not in (",", ":", "(", "}"):
                    t.next()
                if t.take("["):
                    self.assignment()
                    t.need("]")
                elif t.kind in ("word", "string", "number"):
                    t.next()
                else:
                    raise Rejected(f"unexpected {t.text[:20] or 'end'}")
                if t.at("("):
                    self.parameters()
                    self.block()
                elif t.take(":", "="):
                    self.assignment()
            if not t.take(","):
                break
        t.need("}")

    def word(self) -> None:
        t = self.t
        if t.at("function"):
            self.function()
        elif t.at("class"):
            self.klass()
        elif t.at("async") and t.ahead()[1] == "function":
            t.next()
            self.function()
        elif t.take("new"):
            if t.take("."):
                t.name()
                return
            t.name()
            while t.take("."):
                t.name()
            if t.at("("):
                self.arguments()
        else:
            t.next()

    def function(self) -> None:
        t = self.t
        t.need("function")
        t.take("*")
        if t.kind == "word":
            t.next()
        self.parameters()
        self.block()

    def klass(self) -> None:
        t = self.t
        t.need("class")
        if t.kind == "word" and not t.at("extends"):
            t.next()
        if t.take("extends"):
            self.postfix()
        t.need("{")
        while not t.take("}"):
            if t.take(";"):
                continue
            while t.at("static", "async", "get", "set", "*") and t.ahead()[1] not in ("(", "=", ";"):
                t.next()
            if t.take("["):
                self.assignment()
                t.need("]")
            elif t.kind in ("word", "string", "number"):
                t.next()
            else:
                raise Rejected("the class body is not closed")
            if t.at("("):
                self.parameters()
                self.block()
            else:
                if t.take("="):
                    self.assignment()
                self.end()

    def other(self) -> None:
        t = self.t
        if t.at("function") or t.at("async") and t.ahead()[1] == "function":
            t.take("async")
            return self.function()
        if t.at("class"):
            return self.klass()
        if t.take("export"):
            t.take("default")
            return self.statement()
        if t.take("import"):
            while not (t.kind == "string" or t.kind == "end"):
                t.next()
            if t.kind == "end":
                raise Rejected("import without a module")
            t.next()
            return self.end()
        super().other()


_PRIMITIVE = {"int", "long", "short", "byte", "char", "float", "double", "boolean", "void", "var", "final"}
_MODIFIER = {"public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "default", "transient", "volatile", "strictfp", "sealed"}


class Java(CLike):
    def type(self) -> None:
        t = self.t
        t.take("final")
        t.name()
        while True:
            if t.take("."):
                t.name()
            elif t.at("<"):
                self.generics()
            elif t.at("[") and t.ahead()[1] == "]":
                t.next()
                t.next()
            elif t.take("..."):
                return
            else:
                return

    def generics(self) -> None:
        t, depth = self.t, 0
        while True:
            if t.take("<"):
                depth += 1
            elif t.take(">"):
                depth -= 1
            elif t.kind == "word" or t.at(",", "?", ".", "&", "[", "]"):
                t.next()
            else:
                raise Rejected("type arguments are not closed")
            if not depth:
                return

    def declares(self) -> bool:
        t = self.t
        if t.kind != "word" or t.at("new", "this", "super"):
            return False
        if t.text in _PRIMITIVE:
            return True
        keep = t.i
        try:
            self.type()
            return t.kind == "word" and t.ahead()[1] in ("=", ";", ",", ":")
        except Rejected:
            return False
        finally:
            t.i = keep

    def declaration(self) -> None:
        t = self.t
        self.type()
        while True:
            t.name()
            if t.take("="):
                self.initial()
            if not t.take(","):
                return

    def initial(self) -> None:
        t = self.t
        if not t.take("{"):
            return self.assignment()
        while not t.at("}"):
            self.initial()
            if not t.take(","):
                break
        t.need("}")

    def word(self) -> None:
        t = self.t
        if not t.take("new"):
            t.next()
            return
        t.name()
        while t.take("."):
            t.name()
        if t.at("<"):
            self.generics()
        if t.at("["):
            while t.take("["):
                if not t.at("]"):
                    self.expression()
                t.need("]")
            if t.at("{"):
                self.initial()
            return
        self.arguments()
        if t.at("{"):
            self.body("")

    def parameters(self) -> None:
        t = self.t
        t.need("(")
        while not t.at(")"):
            if t.kind == "word" and t.ahead()[1] in (",", ")"):
                t.next()
            else:
                self.type()
                t.name()
            if not t.take(","):
                break
        t.need(")")

    def modifiers(self) -> None:
        t = self.t
        while t.text in _MODIFIER or t.kind == "word" and t.text[0] == "@":
            at = t.next()[0] == "@"
            if at and t.at("("):
                self.arguments()

    def klass(self) -> None:
        t = self.t
        kind = t.next()
        name = t.name()
        if t.at("<"):
            self.generics()
        if kind == "record":
            self.parameters()
        while t.take("extends", "implements", "permits"):
            self.type()
            while t.take(","):
                self.type()
        self.body(name, kind)

    def body(self, name: str, kind: str = "class") -> None:
        t = self.t
        t.need("{")
        if kind == "enum":
            while t.kind == "word":
                t.next()
                if t.at("("):
                    self.arguments()
                if not t.take(","):
                    break
            t.take(";")
        while not t.take("}"):
            if t.kind == "end":
                raise Rejected("the class body is not closed")
            if t.take(";"):
                continue
            self.modifiers()
            if t.at("{"):
                self.block()
                continue
            if t.at("class", "interface", "enum", "record"):
                self.klass()
                continue
            if t.at("<"):
                self.generics()
            if t.at(name) and t.ahead()[1] == "(":
                t.next()
            else:
                self.type()
                t.name()
            if t.at("("):
                self.parameters()
                if t.take("throws"):
                    self.type()
                    while t.take(","):
                        self.type()
                if not t.take(";"):
                    self.block()
            else:
                if t.take("="):
                    self.initial()
                while t.take(","):
                    t.name()
                    if t.take("="):
                        self.initial()
                t.need(";")

    def other(self) -> None:
        if self.t.at("class", "final") and self.t.ahead()[0] == "word" and self.t.at("class"):
            return self.klass()
        super().other()

    def unit(self) -> None:
        t, found = self.t, False
        while t.kind != "end":
            if t.take("package", "import"):
                t.take("static")
                while not t.at(";"):
                    if t.kind == "end":
                        raise Rejected("; is missing")
                    t.next()
                t.next()
                continue
            self.modifiers()
            if not t.at("class", "interface", "enum", "record"):
                raise Rejected("expected a class")
            self.klass()
            found = True
        if not found:
            raise Rejected("no class")


_SQL = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<string>'(?:[^']|'')*')
    |(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<word>"(?:[^"]|"")*"|[^\W\d]\w*)
    |(?P<punct>\|\||<>|!=|<=|>=|::|[-+*/%(),.;=<>])""",
    re.X | re.S,
)
_CLAUSE = {"FROM", "WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "UNION", "JOIN", "ON", "LEFT", "RIGHT", "INNER", "FULL", "CROSS", "SET", "VALUES", "AS", "AND", "OR", "NOT", "IN", "IS", "LIKE", "BETWEEN", "DESC", "ASC", "THEN", "ELSE", "END", "WHEN", "OFFSET", "BY", "USING"}


class Sql:
    def __init__(self, t: Tokens):
        self.t = t
        self.t.items = [(k, x.upper() if k == "word" and x[0] != '"' else x, f) for k, x, f in self.t.items]

    def list_of(self, one: Callable[[], None]) -> None:
        one()
        while self.t.take(","):
            one()

    def table(self) -> None:
        self.t.name()
        while self.t.take("."):
            self.t.name()

    def expression(self) -> None:
        t = self.t
        t.take("NOT")
        self.operand()
        while True:
            if t.take("+", "-", "*", "/", "%", "||", "=", "<>", "!=", "<", ">", "<=", ">=", "AND", "OR", "LIKE"):
                t.take("NOT")
                self.operand()
            elif t.take("IS"):
                t.take("NOT")
                t.need("NULL", "TRUE", "FALSE")
            elif t.take("BETWEEN"):
                self.operand()
                t.need("AND")
                self.operand()
            elif t.take("NOT"):
                continue
            elif t.take("IN"):
                t.need("(")
                self.select() if t.at("SELECT") else self.list_of(self.expression)
                t.need(")")
            else:
                return

    def operand(self) -> None:
        t = self.t
        t.take("-", "+")
        if t.kind in ("number", "string"):
            t.next()
        elif t.take("("):
            self.select() if t.at("SELECT") else self.list_of(self.expression)
            t.need(")")
        elif t.take("CASE"):
            if not t.at("WHEN"):
                self.expression()
            while t.take("WHEN"):
                self.expression()
                t.need("THEN")
                self.expression()
            if t.take("ELSE"):
                self.expression()
            t.need("END")
        elif t.take("*"):
            pass
        elif t.kind == "word" and t.text not in _CLAUSE:
            t.next()
            while t.take("."):
                if not t.take("*"):
                    t.name()
            if t.take("("):
                t.take("DISTINCT")
                if not t.at(")"):
                    self.list_of(self.expression)
                t.need(")")
                if t.take("OVER"):
                    t.need("(")
                    depth = 1
                    while depth:
                        if t.kind == "end":
                            raise Rejected("OVER is not closed")
                        depth += t.at("(") - t.at(")")
                        t.next()
        else:
            raise Rejected(f"unexpected {t.text[:20] or 'end'}")

    def named(self) -> None:
        t = self.t
        self.expression()
        if t.take("AS"):
            t.name()
        elif t.kind == "word" and t.text not in _CLAUSE:
            t.next()

    def select(self) -> None:
        t = self.t
        t.need("SELECT")
        t.take("DISTINCT", "ALL")
        self.list_of(self.named)
        if t.take("FROM"):
            self.list_of(self.named)
            while t.at("JOIN", "LEFT", "RIGHT", "INNER", "FULL", "CROSS"):
                while not t.take("JOIN"):
                    if t.kind != "word":
                        raise Rejected("expected JOIN")
                    t.next()
                self.named()
                if t.take("ON"):
                    self.expression()
                elif t.take("USING"):
                    t.need("(")
                    self.list_of(t.name)
                    t.need(")")
        if t.take("WHERE"):
            self.expression()
        if t.take("GROUP"):
            t.need("BY")
            self.list_of(self.expression)
        if t.take("HAVING"):
            self.expression()
        if t.take("UNION"):
            t.take("ALL")
            return self.select()
        if t.take("ORDER"):
            t.need("BY")
            self.list_of(self.sorted_by)
        if t.take("LIMIT"):
            self.operand()
        if t.take("OFFSET"):
            self.operand()

    def sorted_by(self) -> None:
        self.expression()
        self.t.take("DESC", "ASC")

    def column(self) -> None:
        t, depth = self.t, 0
        t.name()
        if t.kind != "word" and not t.at("("):
            raise Rejected("a column without a type")
        while depth or not t.at(",", ")"):
            if t.kind == "end":
                raise Rejected("the column list is not closed")
            depth += t.at("(") - t.at(")")
            t.next()

    def row(self) -> None:
        self.t.need("(")
        self.list_of(self.expression)
        self.t.need(")")

    def change(self) -> None:
        self.t.name()
        self.t.need("=")
        self.expression()

    def statement(self) -> None:
        t = self.t
        if t.at("SELECT"):
            self.select()
        elif t.take("WITH"):
            while True:
                t.name()
                t.need("AS")
                t.need("(")
                self.select()
                t.need(")")
                if not t.take(","):
                    break
            self.select()
        elif t.take("CREATE"):
            while t.take("TEMP", "TEMPORARY", "OR", "REPLACE"):
                pass
            if t.take("VIEW"):
                self.table()
                t.need("AS")
                return self.select()
            t.need("TABLE")
            if t.take("IF"):
                t.need("NOT")
                t.need("EXISTS")
            self.table()
            if t.take("AS"):
                return self.select()
            t.need("(")
            self.list_of(self.column)
            t.need(")")
        elif t.take("INSERT"):
            t.need("INTO")
            self.table()
            if t.take("("):
                self.list_of(t.name)
                t.need(")")
            if t.take("VALUES"):
                self.list_of(self.row)
            else:
                self.select()
        elif t.take("UPDATE"):
            self.table()
            t.need("SET")
            self.list_of(self.change)
            if t.take("WHERE"):
                self.expression()
        elif t.take("DELETE"):
            t.need("FROM")
            self.table()
            if t.take("WHERE"):
                self.expression()
        elif t.take("DROP"):
            t.need("TABLE", "VIEW")
            if t.take("IF"):
                t.need("EXISTS")
            self.table()
        else:
            raise Rejected(f"no statement begins with {t.text[:20]}")

    def unit(self) -> None:
        while self.t.kind != "end":
            if self.t.take(";"):
                continue
            self.statement()
            if self.t.kind != "end":
                self.t.need(";")


_SHELL = re.compile(
    r"""(?P<skip>[ \t]+|\\\n|(?<![^\s;])\#[^\n]*)
    |(?P<word>(?:\$\(\((?:[^()]|\([^()]*\))*\)\)|\$\((?:[^()]|\([^()]*\))*\)|\$\{[^{}]*\}|`[^`]*`|'[^']*'|"(?:[^"\\]|\\.)*"|\\.|[^\s;&|<>()"'`\\])+)
    |(?P<punct>\n|;;|&&|\|\||<<<|>>|>&|<&|&>|\(\(|\)\)|[;&|<>()])""",
    re.X,
)


class Shell:
    """Commands, pipelines, redirections, functions and the compound commands of a POSIX shell."""

    def __init__(self, t: Tokens):
        self.t = t

    def lines(self, *stop: str) -> None:
        t, some = self.t, False
        while True:
            while t.kind == "punct" and t.text in ("\n", ";"):
                t.next()
            if t.kind == "end" or t.text in stop:
                if stop and t.kind == "end":
                    raise Rejected(f"expected {stop[0]}")
                if stop and not some:
                    raise Rejected("an empty list of commands")
                return
            self.pipeline()
            some = True
            if not (t.kind == "end" or t.text in ("\n", ";", "&", ";;") or t.text in stop):
                raise Rejected(f"unexpected {t.text[:20]}")
            if t.text == "&":
                t.next()

    def pipeline(self) -> None:
        self.command()
        while self.t.kind == "punct" and self.t.text in ("|", "&&", "||"):
            self.t.next()
            while self.t.text == "\n":
                self.t.next()
            self.command()

    def command(self) -> None:
        t = self.t
        t.take("!")
        if t.take("if"):
            self.lines("then")
            t.need("then")
            self.lines("fi", "else", "elif")
            while t.take("elif"):
                self.lines("then")
                t.need("then")
                self.lines("fi", "else", "elif")
            if t.take("else"):
                self.lines("fi")
            t.need("fi")
        elif t.take("while", "until"):
            self.lines("do")
            t.need("do")
            self.lines("done")
            t.need("done")
        elif t.take("for"):
            if t.take("(("):
                while not t.take("))"):
                    if t.kind == "end":
                        raise Rejected("(( is not closed")
                    t.next()
            else:
                t.name()
                if t.take("in"):
                    while t.kind == "word":
                        t.next()
            while t.text in ("\n", ";") and t.kind == "punct":
                t.next()
            t.need("do")
            self.lines("done")
            t.need("done")
        elif t.take("case"):
            t.name()
            t.need("in")
            while not t.take("esac"):
                if t.kind == "end":
                    raise Rejected("expected esac")
                if t.text in ("\n", ";;", ";"):
                    t.next()
                    continue
                t.take("(")
                t.name()
                while t.take("|"):
                    t.name()
                t.need(")")
                if t.text != ";;":
                    self.lines(";;", "esac")
        elif t.take("{"):
            self.lines("}")
            t.need("}")
        elif t.take("("):
            self.lines(")")
            t.need(")")
        elif t.kind == "word" and t.text not in ("then", "fi", "do", "done", "else", "elif", "esac", "}"):
            words = 0
            while True:
                if t.kind == "word":
                    t.next()
                    words += 1
                elif t.kind == "punct" and t.text in (">", ">>", "<", ">&", "<&", "&>", "<<<"):
                    t.next()
                    t.name()
                elif t.at("(") and words == 1 and t.ahead()[1] == ")":
                    t.next()
                    t.next()
                    while t.text == "\n":
                        t.next()
                    return self.command()
                else:
                    return
        else:
            raise Rejected(f"unexpected {t.text[:20] or 'end'}")
        while self.t.kind == "punct" and self.t.text in (">", ">>", "<"):
            self.t.next()
            self.t.name()

    def unit(self) -> None:
        self.lines()


def _by(parser: type, pattern: re.Pattern) -> Callable[[str], str | None]:
    def accept(text: str) -> str | None:
        try:
            parser(scan(text, pattern)).unit()
        except Rejected as e:
            return str(e)
        except RecursionError:
            return "nested too deep"
        return None

    return accept


GRAMMARS: dict[str, Callable[[str], str | None]] = {
    "python": python3,
    "python2": python2,
    "json": json_text,
    "jsonc": json_comments,
    "javascript": _by(JavaScript, _CLIKE),
    "java": _by(Java, _CLIKE),
    "sql": _by(Sql, _SQL),
    "shell": _by(Shell, _SHELL),
    "toml": toml,
    "xml": xml_text,
}

#: Tokens that speak for a language; a weight for each occurrence, at most three counted.
_SIGNS: dict[str, re.Pattern] = {
    "python": re.compile(r"^\s*(?:def|class|import|from|elif|except|with|assert|async def)\b|:\s*$|\bself\b|\bNone\b|\blambda\b|\bin range\b", re.M),
    "python2": re.compile(r"^\s*print\s+[^(\s]|^\s*except\s+\w+\s*,\s*\w+\s*:|\bxrange\b|\bunicode\(|<>|\bexec\s+['\"]", re.M),
    "json": re.compile(r'^\s*[{\[]\s*$|^\s*"[^"\n]*"\s*:|^\s*[}\]],?\s*$', re.M),
    "jsonc": re.compile(r'^\s*"[^"\n]*"\s*:|^\s*//|,\s*[}\]]', re.M),
    "javascript": re.compile(r"\b(?:function|const|let|var|typeof|undefined|console|async|await)\b|=>|===|!==|;\s*$", re.M),
    "java": re.compile(r"\b(?:public|private|protected|static|void|final|int|boolean|String|new)\b|;\s*$|\{\s*$", re.M),
    "sql": re.compile(r"\b(?:SELECT|INSERT INTO|CREATE TABLE|UPDATE|DELETE FROM|WHERE|GROUP BY|ORDER BY|VALUES|JOIN)\b", re.I),
    "shell": re.compile(r"^#!.*sh\b|\b(?:then|fi|done|esac|echo)\b|\$\{?\w+\}?|\[ .* \]|^\s*\w+\(\)\s*\{", re.M),
    "toml": re.compile(r"^\[[\w.\-\"]+\]\s*$|^[\w\-]+\s*=\s*[\[\"\d]", re.M),
    "xml": re.compile(r"^\s*<\?xml|</\w+>|<\w+[^>]*/>", re.M),
}


#: Signs a line that a foreign language needs at least for its successful parse to count.
FOREIGN_SIGNS = 0.2


def language_signs(text: str) -> dict[str, float]:
    """Signs a line for each grammar."""
    lines = text.count("\n") + 1
    return {k: len(p.findall(text)) / lines + (0.5 if k == "python2" and p.search(text) else 0) for k, p in _SIGNS.items()}


def rank_languages(text: str) -> list[str]:
    """All grammars, those first whose tokens cover more of the text's lines; ties in the order of GRAMMARS."""
    order, score = list(GRAMMARS), language_signs(text)
    return sorted(order, key=lambda k: (-score[k], order.index(k)))


def damage(text: str, reason: str) -> str:
    """What a text that no grammar accepts seems to have suffered."""
    if re.search(r"^(?:<{7}|\|{7}|={7}|>{7})(?:\s|$)", text, re.M):
        return "merge_conflict"
    if re.search(r"^@@ .*@@|^[+-](?:def|class|    |\t)", text, re.M):
        return "diff"
    if re.search(r"^(?:```|~~~)", text, re.M):
        return "markdown_fence"
    if "\n" not in text.strip() and "\\n" in text:
        return "escaped"
    if re.search(r"^\s*\d+\s{2}", text, re.M) and len(re.findall(r"^\s*\d+(?:\s{2}|$)", text, re.M)) > text.count("\n") / 2:
        return "line_numbers"
    if re.search("[\u2018\u2019\u201c\u201d]", text) and "invalid character" in reason:
        return "typographic_quotes"
    if reason.startswith(("TabError", "IndentationError")):
        return "indentation"
    if "never closed" in reason or "unterminated" in reason or "EOF" in reason or "was never" in reason:
        return "unclosed"
    return "syntax"


def classify(text: str, expected: str = "python") -> tuple[bool | None, str | None, str | None, str | None]:
    """Whether the expected grammar accepts text; else the foreign grammar that does, the damage, and the reason.

    A text that the expected grammar refuses goes through all others, in the order of
    rank_languages. The first that accepts it, and for whose language the text has
    FOREIGN_SIGNS, is its language (a fence alone is a shell script too, but not meant as one);
    where there is none, the text is damaged. Null instead of a verdict where the
    expected grammar's parser came to its limits.
    """
    reason = GRAMMARS[expected](text)
    if reason is None:
        return True, None, None, None
    if reason == BEYOND:
        return None, None, None, reason
    signs = language_signs(text)
    accepted = [name for name in rank_languages(text) if name != expected and GRAMMARS[name](text) is None]
    meant = next((name for name in accepted if signs[name] >= FOREIGN_SIGNS), None)
    return (False, meant, None, reason) if meant else (False, None, damage(text, reason), reason)
