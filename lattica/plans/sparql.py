"""SPARQL text to a tree: a tokenizer and a recursive-descent parser. What cannot be read raises SyntaxError.

Read: PREFIX and BASE; SELECT (DISTINCT, expressions AS), ASK, CONSTRUCT; groups with triples (a ; ,), OPTIONAL, UNION of any
number of groups, MINUS, GRAPH, FILTER (also EXISTS and NOT EXISTS), BIND, VALUES, nested SELECT; property paths
(/ | ^ + * ?); GROUP BY, HAVING, ORDER BY, LIMIT, OFFSET; aggregates; the usual operators and functions. Beside IRIs, bare
names (paris, in, nation:7) stand for entities and relations where no prefix of that name is declared.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<iri><[^<>"{}|^`\\\s]*>)
    |(?P<var>[?$]\w+)
    |(?P<str>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')(?:\^\^(?:<[^>]*>|[\w-]*:[\w-]+)|@[A-Za-z-]+)?
    |(?P<num>\d+\.\d*(?:[eE][+-]?\d+)?|\.?\d+(?:[eE][+-]?\d+)?)(?![\w:])
    |(?P<op>\|\||&&|!=|<=|>=|[{}()\[\].;,=<>!*/|^+?-])
    |(?P<name>[^\W]?(?:[\w:%@#]|[.-](?=[\w:]))*)""",
    re.X,
)
ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT")
FUNCTIONS = {
    "STR": (1, 1), "STRSTARTS": (2, 2), "STRENDS": (2, 2), "CONTAINS": (2, 2), "REGEX": (2, 3), "LCASE": (1, 1), "UCASE": (1, 1), "STRLEN": (1, 1), "SUBSTR": (2, 3),
    "REPLACE": (3, 4), "CONCAT": (0, 99), "BOUND": (1, 1), "IF": (3, 3), "COALESCE": (1, 99), "ABS": (1, 1), "ROUND": (1, 1), "CEIL": (1, 1), "FLOOR": (1, 1),
    "STRBEFORE": (2, 2), "STRAFTER": (2, 2), "ISIRI": (1, 1), "ISURI": (1, 1), "ISLITERAL": (1, 1), "SAMETERM": (2, 2), "ENCODE_FOR_URI": (1, 1),
}


@dataclass
class Group:
    """parts: ("triple", s, path, o) | ("optional", Group) | ("union", [Group]) | ("minus", Group) | ("graph", term, Group) |
    ("bind", expr, name) | ("values", names, rows) | ("select", Query); filters apply to the whole group."""

    parts: list = field(default_factory=list)
    filters: list = field(default_factory=list)


@dataclass
class Query:
    kind: str
    where: Group
    columns: list = field(default_factory=list)  # (name, expression or None); empty: all
    template: list = field(default_factory=list)
    distinct: bool = False
    group: list = field(default_factory=list)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)  # (expression, descending)
    limit: int | None = None
    offset: int = 0


class Parser:
    def __init__(self, text: str):
        self.tokens, self.prefixes, self.base, at = [], {}, "", 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m or m.end() == at:
                raise SyntaxError(f"cannot read {text[at : at + 20]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at = 0

    # tokens

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[min(self.at + k, len(self.tokens) - 1)]

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def word(self, *names: str) -> str | None:
        """Take the next token if it is one of these keywords."""
        kind, text = self.peek()
        if kind == "name" and text.upper() in names:
            self.at += 1
            return text.upper()
        return None

    def sign(self, *signs: str) -> str | None:
        kind, text = self.peek()
        if kind == "op" and text in signs:
            self.at += 1
            return text
        return None

    def need(self, sign: str) -> None:
        if not self.sign(sign):
            raise SyntaxError(f"expected {sign!r}, found {self.peek()[1]!r}")

    # queries

    def query(self) -> Query:
        while w := self.word("PREFIX", "BASE"):
            if w == "PREFIX":
                name = self.take()[1]
                self.prefixes[name.rstrip(":")] = self.take()[1].strip("<>")
            else:
                self.base = self.take()[1].strip("<>")
        out = self.select() if self.word("SELECT") else self.ask() if self.word("ASK") else self.construct() if self.word("CONSTRUCT") else None
        if out is None:
            raise SyntaxError(f"expected SELECT, ASK or CONSTRUCT, found {self.peek()[1]!r}")
        if self.peek()[0] != "end":
            raise SyntaxError(f"unread: {self.peek()[1]!r}")
        return out

    def ask(self) -> Query:
        self.word("WHERE")
        return self.modifiers(Query("ASK", self.group()))

    def construct(self) -> Query:
        self.need("{")
        template = self.triples([])
        self.need("}")
        self.word("WHERE")
        return self.modifiers(Query("CONSTRUCT", self.group(), template=template))

    def select(self) -> Query:
        distinct, columns = bool(self.word("DISTINCT", "REDUCED")), []
        if not self.sign("*"):
            while True:
                if self.peek()[0] == "var":
                    columns.append((self.take()[1][1:], None))
                elif self.sign("("):
                    e = self.expression()
                    if not self.word("AS"):
                        raise SyntaxError("expected AS")
                    columns.append((self.take()[1][1:], e))
                    self.need(")")
                else:
                    break
            if not columns:
                raise SyntaxError("SELECT without columns")
        self.word("WHERE")
        return self.modifiers(Query("SELECT", self.group(), columns, distinct=distinct))

    def modifiers(self, q: Query) -> Query:
        while w := self.word("GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET"):
            if w in ("GROUP", "ORDER") and not self.word("BY"):
                raise SyntaxError("expected BY")
            if w == "GROUP":
                while self.peek()[0] == "var" or self.peek() == ("op", "("):
                    if self.sign("("):
                        e = self.expression()
                        name = self.take()[1][1:] if self.word("AS") else f"_g{len(q.group)}"
                        self.need(")")
                        q.group.append((name, e))
                    else:
                        name = self.take()[1][1:]
                        q.group.append((name, ("var", name)))
            elif w == "HAVING":
                while self.peek() == ("op", "("):
                    q.having.append(self.primary())
            elif w == "ORDER":
                while self.peek()[0] == "var" or self.peek() == ("op", "(") or self.peek()[1].upper() in ("ASC", "DESC", *FUNCTIONS):
                    way = self.word("ASC", "DESC")
                    q.order.append((self.primary(), way == "DESC"))
            else:
                kind, n = self.take()
                if kind != "num" or not n.isdigit():
                    raise SyntaxError(f"{w} needs a number")
                if w == "LIMIT":
                    q.limit = int(n)
                else:
                    q.offset = int(n)
        return q

    # groups

    def group(self) -> Group:
        self.need("{")
        g = Group()
        if self.word("SELECT"):
            g.parts.append(("select", self.select()))
            self.need("}")
            return g
        while not self.sign("}"):
            if self.word("OPTIONAL"):
                g.parts.append(("optional", self.group()))
            elif self.word("MINUS"):
                g.parts.append(("minus", self.group()))
            elif self.word("GRAPH"):
                g.parts.append(("graph", self.term("source"), self.group()))
            elif self.word("FILTER"):
                g.filters.append(self.constraint())
            elif self.word("BIND"):
                self.need("(")
                e = self.expression()
                if not self.word("AS"):
                    raise SyntaxError("expected AS")
                g.parts.append(("bind", e, self.take()[1][1:]))
                self.need(")")
            elif self.word("VALUES"):
                g.parts.append(self.values())
            elif self.peek() == ("op", "{"):
                options = [self.group()]
                while self.word("UNION"):
                    options.append(self.group())
                g.parts.append(("union", options))
            elif self.sign("."):
                continue
            elif self.peek()[0] == "end":
                raise SyntaxError("unclosed {")
            else:
                before = self.at
                self.triples(g.parts)
                if self.at == before:
                    raise SyntaxError(f"unread in a group: {self.peek()[1]!r}")
        return g

    def values(self) -> tuple:
        many = bool(self.sign("("))
        names = []
        while self.peek()[0] == "var":
            names.append(self.take()[1][1:])
        if many:
            self.need(")")
        self.need("{")
        rows = []
        while not self.sign("}"):
            if many:
                self.need("(")
            row = [None if self.word("UNDEF") else self.term("entity") for _ in names]
            if many:
                self.need(")")
            rows.append([t[1] if t else None for t in row])
        return ("values", names, rows)

    def triples(self, out: list) -> list:
        """Triples up to what cannot start one."""
        while self.peek()[0] in ("var", "iri", "name", "str", "num") and not (self.peek()[0] == "name" and self.peek()[1].upper() in ("OPTIONAL", "MINUS", "GRAPH", "FILTER", "BIND", "VALUES", "UNION")):
            s = self.term("entity")
            while True:
                p = self.path()
                while True:
                    out.append(("triple", s, p, self.term("entity")))
                    if not self.sign(","):
                        break
                if not self.sign(";"):
                    break
                if self.peek() in (("op", "."), ("op", ";"), ("op", "}")):  # a closing ;
                    break
            if not self.sign("."):
                break
        return out

    def path(self) -> tuple:
        out = [self.sequence()]
        while self.sign("|"):
            out.append(self.sequence())
        return out[0] if len(out) == 1 else ("alt", out)

    def sequence(self) -> tuple:
        out = [self.step()]
        while self.sign("/"):
            out.append(self.step())
        return out[0] if len(out) == 1 else ("seq", out)

    def step(self) -> tuple:
        if self.sign("^"):
            return ("inv", self.step())
        if self.sign("("):
            out = self.path()
            self.need(")")
        else:
            out = ("rel", "is_a") if self.word("A") else self.term("relation")
            if out[0] == "is":
                out = ("rel", out[1])
        while True:
            nxt = self.peek(1)
            if self.peek() == ("op", "?") and nxt[0] in ("op", "end"):
                pass
            if mark := self.sign("+", "*", "?"):
                out = ("many", mark, out)
            else:
                return out

    def term(self, kind: str) -> tuple:
        """("var", name) or ("is", value)."""
        t, text = self.take()
        if t == "var":
            return ("var", text[1:])
        if t == "iri":
            return ("is", self.named(text[1:-1]))
        if t == "str":
            return ("is", self.unquoted(text))
        if t == "num":
            return ("is", text)
        if t == "op" and text == "-" and self.peek()[0] == "num":
            return ("is", "-" + self.take()[1])
        if t == "name" and text:
            prefix, colon, rest = text.partition(":")
            if colon and prefix in self.prefixes:
                return ("is", self.named(self.prefixes[prefix] + rest))
            return ("is", text)
        raise SyntaxError(f"expected a term, found {text!r}")

    def named(self, iri: str) -> str:
        from lattica.sources.triples import name_of

        return name_of(iri if "://" in iri or not self.base else self.base + iri)

    @staticmethod
    def unquoted(text: str) -> str:
        return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1])

    # expressions

    def constraint(self):
        if self.word("EXISTS"):
            return ("exists", self.group(), True)
        if self.peek()[1].upper() == "NOT" and self.peek(1)[1].upper() == "EXISTS":
            self.at += 2
            return ("exists", self.group(), False)
        return self.primary()

    def expression(self):
        out = self.conjunction()
        while self.sign("||"):
            out = ("||", out, self.conjunction())
        return out

    def conjunction(self):
        out = self.comparison()
        while self.sign("&&"):
            out = ("&&", out, self.comparison())
        return out

    def comparison(self):
        left = self.sum()
        if op := self.sign("=", "!=", "<=", ">=", "<", ">"):
            return (op, left, self.sum())
        negated = self.peek()[1].upper() == "NOT" and self.peek(1)[1].upper() == "IN"
        if negated:
            self.at += 1
        if self.word("IN"):
            self.need("(")
            items = []
            while not self.sign(")"):
                items.append(self.expression())
                self.sign(",")
            return ("in", left, items, not negated)
        return left

    def sum(self):
        out = self.product()
        while op := self.sign("+", "-"):
            out = (op, out, self.product())
        return out

    def product(self):
        out = self.unary()
        while op := self.sign("*", "/"):
            out = (op, out, self.unary())
        return out

    def unary(self):
        if self.sign("!"):
            return ("!", self.unary())
        if self.sign("-"):
            return ("neg", self.unary())
        return self.primary()

    def primary(self):
        if self.sign("("):
            out = self.expression()
            self.need(")")
            return out
        if self.word("EXISTS") or (self.peek()[1].upper() == "NOT" and self.peek(1)[1].upper() == "EXISTS"):
            self.at -= self.tokens[self.at - 1][1].upper() == "EXISTS"
            return self.constraint()
        kind, text = self.peek()
        if kind == "num":
            self.at += 1
            return ("num", float(text) if not text.isdigit() else int(text))
        if kind == "name":
            up = text.upper()
            if up in ("TRUE", "FALSE"):
                self.at += 1
                return ("bool", up == "TRUE")
            if self.peek(1) == ("op", "("):
                if up in AGGREGATES:
                    return self.aggregate()
                if up not in FUNCTIONS:
                    raise SyntaxError(f"no function {text}")
                self.at += 2
                args = []
                while not self.sign(")"):
                    args.append(self.expression())
                    if not self.sign(",") and self.peek() != ("op", ")"):
                        raise SyntaxError("expected , or )")
                least, most = FUNCTIONS[up]
                if not least <= len(args) <= most:
                    raise SyntaxError(f"{up} takes {least} to {most} arguments")
                return ("call", up, args)
        return self.term("entity")

    def aggregate(self):
        name = self.take()[1].upper()
        self.need("(")
        distinct = bool(self.word("DISTINCT"))
        what = None if self.sign("*") else self.expression()
        sep = " "
        if self.sign(";"):
            if not self.word("SEPARATOR"):
                raise SyntaxError("expected SEPARATOR")
            self.need("=")
            sep = self.unquoted(self.take()[1])
        self.need(")")
        return ("agg", name, distinct, what, sep)


def parse(text: str) -> Query:
    return Parser(text).query()
