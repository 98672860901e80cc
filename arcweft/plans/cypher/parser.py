"""Tokens and grammar.  Whatever the grammar has no place for is refused with its reason.

    query    := MATCH pattern [WHERE cond {AND cond}] [SET var '.' prop '=' value {',' ...} | [DETACH] DELETE var {',' var}]
                [RETURN ...] [ORDER BY ...] [SKIP n] [LIMIT n]
              | CREATE pattern

Without RETURN all named variables are returned.
    pattern  := node {rel node}
    node     := '(' [var] {':' label} [map] ')'
    rel      := '-' '[' [var] [':' type {'|' type}] [map] ']' '->' | '<-' '[...]' '-' | '-' '[...]' '-'
    cond     := var '.' prop (= <> != > >= < <= CONTAINS, STARTS WITH, ENDS WITH, IN) value
              | var '.' prop IS [NOT] NULL
    RETURN   := [DISTINCT] item {',' item}
    item     := (var | var '.' prop | count(*) | fn '(' [DISTINCT] var ['.' prop] ')') [AS alias]
"""

from __future__ import annotations

import re
from typing import Any, NoReturn

from .ast import Comparison, Create, Item, Match, NodePattern, Order, Pattern, RelPattern

TOKEN = re.compile(
    r"\s+|//[^\n]*|(?P<number>\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)|(?P<name>[^\W\d]\w*)|`(?P<quoted>(?:[^`]|``)+)`"
    r"|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<op><>|!=|>=|<=|->|<-|[()\[\]{}:,.=<>*|$+/;-])",
    re.S,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
AGGREGATES = ("count", "sum", "avg", "min", "max")
REFUSED = ("optional", "with", "unwind", "merge", "union", "call", "foreach", "remove", "load", "using")


class QueryRefused(ValueError):
    """A query outside the grammar, with the reason."""

    def __init__(self, query: str, why: str) -> None:
        super().__init__(f"{why}: {query if len(query) <= 200 else query[:197] + '...'}")
        self.query, self.why = query, why


class Parser:
    def __init__(self, query: str) -> None:
        self.query, self.at = query, 0
        self.tokens: list[tuple[str, Any]] = []
        end = 0
        while end < len(query):
            m = TOKEN.match(query, end)
            if m is None:
                self.refuse(f"can't read {query[end]!r} at {end}")
            end = m.end()
            if m.lastgroup == "string":
                text = re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], e[1]), m["string"][1:-1], flags=re.S)
                self.tokens.append(("string", text))
            elif m.lastgroup == "quoted":
                self.tokens.append(("quoted", m["quoted"].replace("``", "`")))
            elif m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
        while self.tokens and self.tokens[-1] == ("op", ";"):
            self.tokens.pop()
        if not self.tokens:
            self.refuse("the query is empty")

    def refuse(self, why: str) -> NoReturn:
        raise QueryRefused(self.query, why)

    def peek(self, k: int = 0) -> tuple[str, Any]:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", "the end")

    def op(self, *ops: str) -> str | None:
        kind, text = self.peek()
        if kind == "op" and text in ops:
            self.at += 1
            return text
        return None

    def need(self, op: str) -> None:
        if not self.op(op):
            self.refuse(f"{op!r} is missing before {self.peek()[1]!r}")

    def word(self, *words: str) -> bool:
        """The keywords, one after another, in any case."""
        for k, w in enumerate(words):
            kind, text = self.peek(k)
            if kind != "name" or text.lower() != w:
                return False
        self.at += len(words)
        return True

    def name(self, what: str) -> str:
        kind, text = self.peek()
        if kind not in ("name", "quoted"):
            self.refuse(f"{what} is missing before {text!r}")
        self.at += 1
        return text

    def value(self) -> Any:
        if self.op("["):
            out = []
            while not self.op("]"):
                out.append(self.value())
                if not self.op(","):
                    self.need("]")
                    break
            return out
        sign = -1 if self.op("-") else 1
        kind, text = self.peek()
        self.at += 1
        if kind == "number":
            return sign * (int(text) if text.isdigit() else float(text))
        if sign == 1 and kind == "string":
            return text
        if sign == 1 and kind == "name" and text.lower() in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[text.lower()]
        if text == "$":
            self.refuse("parameters aren't supported")
        self.refuse(f"{text!r} is no literal; quote text")

    def map(self) -> dict[str, Any]:
        out: dict[str, Any] = {}
        if self.op("{"):
            while not self.op("}"):
                key = self.name("a property name")
                self.need(":")
                out[key] = self.value()
                if not self.op(","):
                    self.need("}")
                    break
        return out

    def node(self) -> NodePattern:
        self.need("(")
        variable = self.name("a variable") if self.peek()[0] in ("name", "quoted") else None
        labels = []
        while self.op(":"):
            labels.append(self.name("a label"))
        if self.peek() == ("op", "|"):
            self.refuse("alternative labels aren't supported")
        props = self.map()
        self.need(")")
        return NodePattern(variable, tuple(labels), props)

    def rel(self) -> RelPattern:
        left = self.op("<-") is not None
        if not left:
            self.need("-")
        if not self.op("["):
            self.refuse("a relationship needs brackets, as in -[:TYPE]->")
        variable = self.name("a variable") if self.peek()[0] in ("name", "quoted") else None
        types = []
        if self.op(":"):
            types.append(self.name("a type"))
            while self.op("|"):
                self.op(":")
                types.append(self.name("a type"))
        if self.peek() == ("op", "*"):
            self.refuse("paths of variable length aren't supported")
        props = self.map()
        self.need("]")
        right = self.op("->") is not None
        if not right:
            self.need("-")
        if left and right:
            self.refuse("a relationship can't point both ways")
        return RelPattern(variable, tuple(types), "incoming" if left else "outgoing" if right else "both", props)

    def pattern(self) -> Pattern:
        start, hops = self.node(), []
        while self.peek() in (("op", "-"), ("op", "<-")):
            rel = self.rel()
            hops.append((rel, self.node()))
        if self.peek() == ("op", ","):
            self.refuse("several patterns aren't supported")
        return Pattern(start, tuple(hops))

    def property(self) -> tuple[str, str]:
        variable = self.name("a variable")
        self.need(".")
        return variable, self.name("a property")

    def condition(self) -> Comparison:
        if self.word("not") or self.peek() == ("op", "("):
            self.refuse("NOT, OR and brackets aren't supported in WHERE")
        variable, prop = self.property()
        if op := self.op("=", "<>", "!=", ">=", "<=", ">", "<"):
            name = {"=": "eq", "<>": "neq", "!=": "neq", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}[op]
            return Comparison(variable, prop, name, self.value())
        if self.word("is", "not", "null"):
            return Comparison(variable, prop, "exists", True)
        if self.word("is", "null"):
            return Comparison(variable, prop, "exists", False)
        for words, name in ((("contains",), "contains"), (("starts", "with"), "startsWith"), (("ends", "with"), "endsWith"), (("in",), "in")):
            if self.word(*words):
                value = self.value()
                if isinstance(value, list) != (name == "in"):
                    self.refuse(f"{' '.join(words).upper()} takes {'a list' if name == 'in' else 'a text'}")
                return Comparison(variable, prop, name, value)
        self.refuse(f"no comparison before {self.peek()[1]!r}")

    def item(self) -> Item:
        start = self.at
        name = self.name("what to return")
        aggregate, distinct, prop, variable = None, False, None, name
        if self.op("("):
            aggregate = name.lower()
            if aggregate not in AGGREGATES:
                self.refuse(f"there is no function {name!r}")
            if aggregate == "count" and self.op("*"):
                variable = None
            else:
                distinct = self.word("distinct")
                variable = self.name("a variable")
                prop = self.name("a property") if self.op(".") else None
                if prop is None and aggregate != "count":
                    self.refuse(f"{name} takes a property")
            self.need(")")
        elif self.op("."):
            prop = self.name("a property")
        text = "".join(str(t[1]) for t in self.tokens[start : self.at])
        alias = self.name("an alias") if self.word("as") else text
        return Item(variable, prop, alias, aggregate, distinct)

    def number(self, what: str) -> int:
        kind, text = self.peek()
        if kind != "number" or not text.isdigit():
            self.refuse(f"{what} takes a whole number")
        self.at += 1
        return int(text)

    def parse(self) -> Match | Create:
        if self.word("create"):
            found: Match | Create = Create(self.pattern())
        elif self.word("match"):
            found = self.match()
        else:
            self.refuse(f"a query starts with MATCH or CREATE, not {self.peek()[1]!r}")
        if self.at < len(self.tokens):
            text = self.peek()[1]
            known = isinstance(text, str) and text.lower() in REFUSED
            self.refuse(f"{text.upper()} isn't supported" if known else f"{text!r} is unexpected here")
        return found

    def match(self) -> Match:
        pattern = self.pattern()
        where: list[Comparison] = []
        if self.word("where"):
            where.append(self.condition())
            while self.word("and"):
                where.append(self.condition())
            if self.word("or") or self.word("xor"):
                self.refuse("OR isn't supported in WHERE")
        sets, deletes = [], []
        if self.word("set"):
            while True:
                variable, prop = self.property()
                self.need("=")
                sets.append((variable, prop, self.value()))
                if not self.op(","):
                    break
        elif self.word("detach", "delete") or self.word("delete"):
            deletes.append(self.name("a variable"))
            while self.op(","):
                deletes.append(self.name("a variable"))
        distinct, items = False, []
        if self.word("return"):
            distinct = self.word("distinct")
            items.append(self.item())
            while self.op(","):
                items.append(self.item())
        order = []
        if self.word("order", "by"):
            while True:
                name = self.name("a name to order by")
                if self.op("."):
                    name += "." + self.name("a property")
                descending = self.word("desc") or self.word("descending")
                _ = descending or self.word("asc") or self.word("ascending")
                order.append(Order(name, descending))
                if not self.op(","):
                    break
        skip = self.number("SKIP") if self.word("skip") else None
        limit = self.number("LIMIT") if self.word("limit") else None
        return Match(pattern, tuple(where), tuple(items), distinct, tuple(order), skip, limit, tuple(sets), tuple(deletes))


def parse(query: str) -> Match | Create:
    return Parser(query).parse()
