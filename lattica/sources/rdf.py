"""RDF text: N-Quads and Turtle out and in. Names, their underscores and all letters survive the round trip."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.sources.triples import BASE, RDF_TYPE, from_uri, name_of, normalized, uri

PREFIXES = {"e": f"{BASE}entity/", "r": f"{BASE}relation/"}
OWL_SAME = "http://www.w3.org/2002/07/owl#equivalentProperty"


def node(c: str, kind: str = "entity"):
    return F.concat(F.lit("<"), uri(c, kind), F.lit(">"))


def to_nquads(facts: DataFrame) -> DataFrame:
    """(value): one line per fact, its source as the graph where facts have one."""
    graph = [node("source", "source")] if "source" in facts.columns else []
    return facts.select(F.concat_ws(" ", node("subject"), node("relation", "relation"), node("object"), *graph, F.lit(".")).alias("value"))


def from_nquads(lines: DataFrame) -> DataFrame:
    """(subject, relation, object, source) of N-Triples or N-Quads lines (value); source is null without a graph; other lines are left out."""
    line = r"^\s*<([^>]*)>\s+<([^>]*)>\s+<([^>]*)>\s*(?:<([^>]*)>\s*)?\.\s*$"
    part = lambda i: F.regexp_extract("value", line, i)
    ok = lines.filter(F.col("value").rlike(line))
    rows = ok.select(from_uri(part(1)).alias("subject"), from_uri(part(2)).alias("relation"), from_uri(part(3)).alias("object"), F.when(part(4) != "", from_uri(part(4))).alias("source"))
    return rows.filter("length(subject) > 0 and length(relation) > 0 and length(object) > 0").distinct()


def to_turtle(facts: DataFrame, source: str | None = None) -> DataFrame:
    """(value): Turtle statements, one per fact, each whole by itself, so that any split of the lines is Turtle; of one source or of all."""
    rows = facts.filter(F.col("source") == source) if source is not None else facts
    rows = rows.select("subject", "relation", "object").distinct()
    verb = F.when(F.col("relation") == "is_a", "a").otherwise(node("relation", "relation"))
    return rows.select(F.concat_ws(" ", node("subject"), verb, node("object"), F.lit(".")).alias("value"))


def write_turtle(facts: DataFrame, path: str, source: str | None = None) -> None:
    to_turtle(facts, source).write.mode("overwrite").text(path)


def equivalent_properties(synonyms: DataFrame) -> DataFrame:
    """(value): one statement per relation that is not its group's canonical one; synonyms has (relation, canonical)."""
    rows = synonyms.filter("relation <> canonical")
    return rows.select(F.concat_ws(" ", node("relation", "relation"), F.lit(f"<{OWL_SAME}>"), node("canonical", "relation"), F.lit(".")).alias("value"))


TURTLE = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^>]*>)|(?P<str>\"\"\"(?:[^\\]|\\.)*?\"\"\"|"(?:[^"\\\n]|\\.)*")(?:\^\^\S+|@[\w-]+)?|(?P<dir>@prefix|@base|PREFIX\b|BASE\b)|(?P<op>[;,.\[\]()])|(?P<name>[\w-]*:(?:[\w%-]|[.:/](?=\S))*|[\w.+-]*\w|_:\w+)""",
    re.X,
)


class Turtle:
    """Reads one Turtle text: prefixes, base, ; and , lists, a, literals and comments. Collections and blank node lists are errors."""

    def __init__(self, text: str):
        self.text, self.at, self.prefixes, self.base = text, 0, {}, ""

    def token(self) -> tuple[str, str]:
        while self.at < len(self.text):
            m = TURTLE.match(self.text, self.at)
            if not m or m.end() == self.at:
                raise SyntaxError(f"cannot read {self.text[self.at : self.at + 20]!r}")
            self.at = m.end()
            if m.lastgroup:
                return m.lastgroup, m[m.lastgroup]
        return "end", ""

    def value(self, kind: str, text: str) -> str:
        if kind == "iri":
            iri = text[1:-1]
            return name_of(iri if ":" in iri else self.base + iri)
        if kind == "str":
            q = 3 if text.startswith('"""') else 1
            return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), text[q:-q])
        if kind == "name":
            if text == "a":
                return name_of(RDF_TYPE)
            prefix, colon, rest = text.partition(":")
            if colon and prefix in self.prefixes:
                return name_of(self.prefixes[prefix] + rest)
            if colon and prefix != "_":
                raise SyntaxError(f"no prefix {prefix}")
            return text
        raise SyntaxError(f"expected a term, found {text!r}")

    def triples(self) -> Iterator[tuple[str, str, str]]:
        while True:
            kind, text = self.token()
            if kind == "end":
                return
            if kind == "dir":
                if text.lower().endswith("prefix"):
                    name = self.token()[1].rstrip(":")
                    self.prefixes[name] = self.token()[1][1:-1]
                else:
                    self.base = self.token()[1][1:-1]
                if text.startswith("@") and self.token() != ("op", "."):
                    raise SyntaxError("a directive needs a full stop")
                continue
            s, sign = self.value(kind, text), ";"
            while sign != ".":
                kind, text = self.token()
                if sign == ";":
                    if (kind, text) in (("op", "."), ("op", ";")):
                        sign = text
                        continue
                    p = self.value(kind, text)
                    kind, text = self.token()
                yield s, p, self.value(kind, text)
                kind, sign = self.token()
                if kind != "op" or sign not in ".;,":
                    raise SyntaxError(f"expected . ; or , after an object, found {sign!r}")


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """(subject, relation, object) of Turtle files. A file is read by one task, as its prefixes hold for all of it."""

    def run(batches):
        for pdf in batches:
            for text in pdf["value"]:
                rows = []
                for t in Turtle(text).triples():
                    rows.append(t)
                    if len(rows) >= 100_000:
                        yield pd.DataFrame(rows, columns=["subject", "relation", "object"])
                        rows = []
                yield pd.DataFrame(rows, columns=["subject", "relation", "object"])

    files = spark.read.text(path, wholetext=True)
    return normalized(files.mapInPandas(run, "subject string, relation string, object string"))
