"""Lexer and parser of the read-only Cypher subset.

    query   := MATCH node {rel node} [WHERE or] [RETURN [DISTINCT] item {"," item}
               [ORDER BY key {"," key}] [LIMIT n]]
    node    := "(" [var] [":" Label] ["{" key ":" value {"," ...} "}"] ")"
    rel     := ["<"] "-" ["[" [var] [":" T {"|" T}] ["*" [hops]] "]"] "-" [">"]
    hops    := n ".." m | n ".." | ".." m | n
    or      := and {OR and};  and := not {AND not};  not := NOT not | "(" or ")" | cond
    cond    := var "." prop (op value | IS [NOT] NULL)
    op      := = | <> | =~ | < | > | <= | >= | CONTAINS | STARTS WITH | ENDS WITH | IN
    item    := COUNT "(" ["DISTINCT"] (var ["." prop] | "*") ")" [AS a] | var ["." prop] [AS a]

A single number of hops, *3, means one to three. Keywords are case-insensitive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

KEYWORDS = frozenset("MATCH WHERE RETURN ORDER BY LIMIT AND OR NOT AS DISTINCT COUNT CONTAINS STARTS ENDS WITH ASC DESC IS NULL IN TRUE FALSE".split())
_TOKEN = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<string>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<number>\d+(?:\.(?!\.)\d+)?)"
    r"|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<quoted>`[^`]+`)|(?P<sign>\.\.|=~|<>|<=|>=|[()\[\]{}:,.|*<>=\-])",
    re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class CypherError(ValueError):
    """A query that can't be read or bound, with the place in its text."""

    def __init__(self, message: str, at: int | None = None):
        super().__init__(message if at is None else f"{message} (at character {at})")
        self.at = at


@dataclass(frozen=True)
class Token:
    kind: str  # keyword, word, string, number, sign, end
    text: str  # keywords in upper case
    at: int
    raw: str = ""


def lex(query: str) -> list[Token]:
    out, at = [], 0
    while at < len(query):
        m = _TOKEN.match(query, at)
        if not m:
            raise CypherError(f"unexpected character {query[at]!r}", at)
        kind, text = m.lastgroup, m.group()
        if kind == "string":
            out.append(Token("string", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), text[1:-1], flags=re.S), at))
        elif kind == "quoted":
            out.append(Token("word", text[1:-1], at))
        elif kind == "word":
            out.append(Token("keyword", text.upper(), at, text) if text.upper() in KEYWORDS else Token("word", text, at))
        elif kind != "skip":
            out.append(Token(kind, text, at))
        at = m.end()
    return [*out, Token("end", "", at)]


@dataclass(frozen=True)
class NodePattern:
    var: str | None
    label: str | None
    props: tuple[tuple[str, object], ...] = ()


@dataclass(frozen=True)
class RelPattern:
    var: str | None
    types: tuple[str, ...]
    direction: str  # out, in, any
    low: int = 1
    high: int | None = 1  # None: as far as the cap
    variable: bool = False


@dataclass(frozen=True)
class Property:
    var: str
    name: str | None = None


@dataclass(frozen=True)
class Condition:
    prop: Property
    op: str
    value: object = None


@dataclass(frozen=True)
class Logic:
    op: str  # AND, OR, NOT
    parts: tuple


@dataclass(frozen=True)
class Item:
    prop: Property | None  # None: *
    count: bool = False
    distinct: bool = False
    alias: str | None = None

    @property
    def source(self) -> str:
        inner = "*" if self.prop is None else self.prop.var + (f".{self.prop.name}" if self.prop.name else "")
        return f"COUNT({'DISTINCT ' * self.distinct}{inner})" if self.count else inner

    @property
    def column(self) -> str:
        return self.alias or self.source


@dataclass(frozen=True)
class Query:
    nodes: tuple[NodePattern, ...]
    rels: tuple[RelPattern, ...]
    where: Condition | Logic | None = None
    items: tuple[Item, ...] = ()
    distinct: bool = False
    order: tuple[tuple[Item, bool], ...] = field(default=())  # key, descending
    limit: int | None = None


class _Parser:
    def __init__(self, query: str):
        self.tokens, self.at = lex(query), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def take(self, *texts: str) -> bool:
        """Go on if the next tokens are these keywords or signs."""
        part = self.tokens[self.at : self.at + len(texts)]
        if [t.text for t in part if t.kind in ("keyword", "sign")] == list(texts):
            self.at += len(texts)
            return True
        return False

    def need(self, *texts: str) -> None:
        if not self.take(*texts):
            raise CypherError(f"expected {' '.join(texts)}, found {self.now.text or 'the end'!r}", self.now.at)

    def name(self, what: str) -> str:
        token = self.now
        if token.kind not in ("word", "keyword") or token.kind == "keyword" and what == "a variable":
            raise CypherError(f"expected {what}, found {token.text or 'the end'!r}", token.at)
        self.at += 1
        return token.raw or token.text

    def integer(self) -> int | None:
        if self.now.kind == "number" and self.now.text.isdigit():
            self.at += 1
            return int(self.tokens[self.at - 1].text)
        return None

    def value(self) -> object:
        token, negative = self.now, self.take("-")
        token = self.now
        self.at += 1
        if token.kind == "number":
            number = float(token.text) if "." in token.text else int(token.text)
            return -number if negative else number
        if token.kind == "string" and not negative:
            return token.text
        if token.text in ("TRUE", "FALSE") and token.kind == "keyword" and not negative:
            return token.text == "TRUE"
        raise CypherError("expected a string, a number, true or false", token.at)

    def query(self) -> Query:
        self.need("MATCH")
        nodes, rels = [self.node()], []
        while self.now.text in ("-", "<") and self.now.kind == "sign":
            rels.append(self.rel())
            nodes.append(self.node())
        where = self.either() if self.take("WHERE") else None
        items, distinct, order, limit = [], False, [], None
        if self.take("RETURN"):
            distinct = self.take("DISTINCT")
            items.append(self.item())
            while self.take(","):
                items.append(self.item())
            if self.take("ORDER", "BY"):
                order.append(self.key())
                while self.take(","):
                    order.append(self.key())
            if self.take("LIMIT"):
                at = self.now.at
                if (limit := self.integer()) is None:
                    raise CypherError("expected a number of rows", at)
        if self.now.kind != "end":
            raise CypherError(f"unexpected {self.now.text!r}", self.now.at)
        return Query(tuple(nodes), tuple(rels), where, tuple(items), distinct, tuple(order), limit)

    def node(self) -> NodePattern:
        self.need("(")
        var = self.name("a variable") if self.now.kind == "word" else None
        label = self.name("a label") if self.take(":") else None
        props = []
        if self.take("{"):
            while True:
                key = self.name("a property")
                self.need(":")
                props.append((key, self.value()))
                if not self.take(","):
                    break
            self.need("}")
        self.need(")")
        return NodePattern(var, label, tuple(props))

    def rel(self) -> RelPattern:
        left = self.take("<")
        self.need("-")
        var, types, low, high, variable = None, [], 1, 1, False
        if self.take("["):
            var = self.name("a variable") if self.now.kind == "word" else None
            if self.take(":"):
                types.append(self.name("a type"))
                while self.take("|"):
                    self.take(":")
                    types.append(self.name("a type"))
            if self.take("*"):
                variable, first = True, self.integer()
                if self.take(".."):
                    low, high = 1 if first is None else first, self.integer()
                else:
                    high = first
            self.need("]")
        self.need("-")
        right = self.take(">")
        if high is not None and high < low:
            raise CypherError(f"no number of hops is from {low} to {high}", self.now.at)
        return RelPattern(var, tuple(types), "any" if left == right else "in" if left else "out", low, high, variable)

    def either(self):
        parts = [self.all_of()]
        while self.take("OR"):
            parts.append(self.all_of())
        return parts[0] if len(parts) == 1 else Logic("OR", tuple(parts))

    def all_of(self):
        parts = [self.negated()]
        while self.take("AND"):
            parts.append(self.negated())
        return parts[0] if len(parts) == 1 else Logic("AND", tuple(parts))

    def negated(self):
        if self.take("NOT"):
            return Logic("NOT", (self.negated(),))
        if self.take("("):
            inner = self.either()
            self.need(")")
            return inner
        return self.condition()

    def condition(self) -> Condition:
        var = self.name("a variable")
        self.need(".")
        prop = Property(var, self.name("a property"))
        if self.take("IS", "NOT", "NULL"):
            return Condition(prop, "IS NOT NULL")
        if self.take("IS", "NULL"):
            return Condition(prop, "IS NULL")
        for words in (("STARTS", "WITH"), ("ENDS", "WITH"), ("CONTAINS",), ("=~",), ("<>",), ("<=",), (">=",), ("=",), ("<",), (">",)):
            if self.take(*words):
                return Condition(prop, " ".join(words), self.value())
        if self.take("IN"):
            self.need("[")
            values = [self.value()]
            while self.take(","):
                values.append(self.value())
            self.need("]")
            return Condition(prop, "IN", tuple(values))
        raise CypherError(f"expected a comparison, found {self.now.text or 'the end'!r}", self.now.at)

    def expression(self) -> Item:
        if self.take("COUNT"):
            self.need("(")
            distinct = self.take("DISTINCT")
            prop = None
            if not self.take("*"):
                var = self.name("a variable")
                prop = Property(var, self.name("a property") if self.take(".") else None)
            self.need(")")
            return Item(prop, True, distinct)
        var = self.name("a variable")
        return Item(Property(var, self.name("a property") if self.take(".") else None))

    def item(self) -> Item:
        found = self.expression()
        return Item(found.prop, found.count, found.distinct, self.name("a name")) if self.take("AS") else found

    def key(self) -> tuple[Item, bool]:
        found = self.expression()
        down = self.take("DESC")
        if not down:
            self.take("ASC")
        return found, down


def parse(query: str) -> Query:
    return _Parser(query).query()
