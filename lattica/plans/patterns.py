"""Runs SPARQL (see `sparql` for what is read) over facts (subject, relation, object, and source where graphs are named).

Variables are bound to names: an entity's, a relation's or a source's; STR gives the IRI of that name. The default graph
is all facts, each once. Groups become joins, left joins, unions, semi and anti joins, which the optimizer orders; triples of
a group are joined so that each meets one it shares a variable with. A path of one or more steps from or to a known name walks
only what that name reaches. Patterns without a common variable would make a cross join and are an error, as are
unreadable queries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.operators.graph import closure, entities, reachable
from lattica.plans.sparql import Group, Query, parse
from lattica.sources.triples import uri


class Bindings:
    """A table of bindings (one column per variable) and what kind of name each holds: entity, relation, source or value."""

    def __init__(self, table: DataFrame | None, kinds: dict[str, str], guards: tuple = ()):
        self.table, self.kinds, self.guards = table, kinds, guards

    def frame(self) -> DataFrame | None:
        """The table behind its guards: conditions without variables, each a table that must not be empty."""
        out = self.table
        for g in self.guards:
            out = g if out is None else out.join(F.broadcast(g), F.lit(True), "left_semi")
        return out


def ends(facts: DataFrame, path: tuple, s: tuple, o: tuple) -> DataFrame:
    """(subject, object) that a path without variables joins."""
    kind = path[0]
    if kind == "rel":
        return facts.filter(F.col("relation") == path[1]).select("subject", "object")
    if kind == "inv":
        e = ends(facts, path[1], o, s)
        return e.select(F.col("object").alias("subject"), F.col("subject").alias("object"))
    free = ("var", "")
    if kind == "alt":
        return reduce(DataFrame.unionByName, [ends(facts, p, s, o) for p in path[1]])
    if kind == "seq":
        steps = [ends(facts, p, s if i == 0 else free, o if i == len(path[1]) - 1 else free) for i, p in enumerate(path[1])]
        out = steps[0]
        for e in steps[1:]:
            out = out.withColumnRenamed("object", "mid").join(e.withColumnRenamed("subject", "mid"), "mid").select("subject", "object")
        return out
    if kind == "many":
        base = ends(facts, path[2], free, free).distinct()
        mark = path[1]
        if mark != "?":
            if s[0] == "is":
                base = reachable(base, s[1]).select(F.lit(s[1]).alias("subject"), F.col("node").alias("object"))
            elif o[0] == "is":
                back = base.select(F.col("object").alias("subject"), F.col("subject").alias("object"))
                base = reachable(back, o[1]).select(F.col("node").alias("subject"), F.lit(o[1]).alias("object"))
            else:
                base = closure(base, reflexive=True)
        if mark != "+":
            here = entities(facts).select(F.col("entity").alias("subject"), F.col("entity").alias("object"))
            base = base.union(here).distinct()
        return base
    raise ValueError("a variable cannot stand in a path")


def triple(facts: DataFrame, s: tuple, path: tuple, o: tuple, graph: str | None) -> Bindings:
    if not graph and "source" in facts.columns:
        facts = facts.select("subject", "relation", "object").distinct()
    if path[0] == "var":
        rows, places = facts, [("subject", s, "entity"), ("relation", path, "relation"), ("object", o, "entity")]
    elif path[0] == "rel":
        rows, places = facts.filter(F.col("relation") == path[1]), [("subject", s, "entity"), ("object", o, "entity")]
    else:
        rows, places = ends(facts, path, s, o), [("subject", s, "entity"), ("object", o, "entity")]
    if graph:
        if "source" not in rows.columns:
            raise ValueError("a path cannot be asked of a variable graph")
        places.append(("source", ("var", graph), "source"))
    seen, kinds = {}, {}
    for c, term, kind in places:
        if term[0] == "is":
            rows = rows.filter(F.col(c) == term[1])
        elif term[1] in seen:
            rows = rows.filter(F.col(c) == F.col(seen[term[1]]))
        else:
            seen[term[1]], kinds[term[1]] = c, kind
    if not seen:
        return Bindings(None, {}, (rows.select(F.lit(1).alias("_g")).limit(1),))
    return Bindings(rows.select(*[F.col(c).alias(v) for v, c in seen.items()]), kinds)


def joined(a: Bindings, b: Bindings, how: str = "inner", on: Column | None = None) -> Bindings:
    if a.table is None and how == "inner":
        return Bindings(b.table, a.kinds | b.kinds, a.guards + b.guards)
    if b.table is None and how == "inner":
        return Bindings(a.table, a.kinds, a.guards + b.guards)
    left, right = a.frame(), b.frame()
    if a.table is None or b.table is None:
        raise ValueError("OPTIONAL needs variables on both sides")
    shared = [c for c in right.columns if c in left.columns]
    if not shared:
        raise ValueError("patterns without a common variable would make a cross join")
    if on is None:
        return Bindings(left.join(right, shared, how), a.kinds | b.kinds)
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in shared else F.col(c) for c in right.columns])
    cond = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"_r_{c}") for c in shared]) & on
    return Bindings(left.join(r, cond, how).drop(*[f"_r_{c}" for c in shared]), a.kinds | b.kinds)


def connected(parts: list[Bindings], have: Bindings | None) -> Bindings | None:
    """The join of parts, each taken up once it shares a variable with what is there."""
    left, out = list(parts), have
    while left:
        at = next((i for i, p in enumerate(left) if out is None or out.table is None or p.table is None or set(p.kinds) & set(out.kinds)), None)
        if at is None:
            raise ValueError("patterns without a common variable would make a cross join")
        p = left.pop(at)
        out = p if out is None else joined(out, p)
    return out


def group(facts: DataFrame, g: Group, graph: str | None = None, filters: bool = True) -> Bindings:
    out, block = None, []

    def flush():
        nonlocal out, block
        if block:
            out, block = connected(block, out), []

    for part in g.parts:
        kind = part[0]
        if kind == "triple":
            block.append(triple(facts, part[1], part[2], part[3], graph))
        elif kind == "graph":
            if part[1][0] == "is":
                block.append(group(by_source(facts, part[1][1]), part[2]))
            else:
                block.append(group(facts, part[2], part[1][1]))
        elif kind == "union":
            block.append(union([group(facts, x, graph) for x in part[1]]))
        elif kind == "select":
            table, kinds = select(facts, part[1])
            block.append(Bindings(table, kinds))
        elif kind == "values":
            schema = T.StructType([T.StructField(n, T.StringType()) for n in part[1]])
            block.append(Bindings(F.broadcast(facts.sparkSession.createDataFrame(part[2], schema)), {n: "value" for n in part[1]}))
        else:
            flush()
            if kind == "optional":
                inner = group(facts, part[1], graph, filters=False)
                both = Bindings(None, (out.kinds if out else {}) | inner.kinds)
                tests = [expression(e, both) for e in part[1].filters]
                out = joined(out, inner, "left", reduce(lambda x, y: x & y, tests) if tests else None) if out else inner
            elif kind == "minus":
                inner = group(facts, part[1], graph)
                shared = [c for c in inner.kinds if c in out.kinds]
                out = Bindings(out.frame().join(inner.frame(), shared, "left_anti"), out.kinds) if shared else out
            elif kind == "bind":
                if out is None:
                    out = Bindings(facts.sparkSession.range(1).select(), {})
                out = Bindings(out.frame().withColumn(part[2], expression(part[1], out)), out.kinds | {part[2]: "value"})
    flush()
    if out is None:
        raise ValueError("an empty group")
    if filters:
        for e in g.filters:
            out = tested(facts, out, e, graph)
    return out


def by_source(facts: DataFrame, source: str) -> DataFrame:
    if "source" not in facts.columns:
        raise ValueError("GRAPH needs facts with a source")
    return facts.filter(F.col("source") == source).drop("source")


def union(options: list[Bindings]) -> Bindings:
    kinds = reduce(lambda a, b: a | b, [x.kinds for x in options])
    if not kinds:
        return Bindings(None, {}, (reduce(DataFrame.union, [x.frame() for x in options]).limit(1),))
    tables = [x.frame().drop("_g") if x.table is not None else x.frame().select() for x in options]
    return Bindings(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables), kinds)


def tested(facts: DataFrame, b: Bindings, e: tuple, graph: str | None) -> Bindings:
    """b where the filter holds. EXISTS is a semi join and may stand in a conjunction."""
    if e[0] == "&&":
        return tested(facts, tested(facts, b, e[1], graph), e[2], graph)
    if e[0] == "!" and e[1][0] == "exists":
        e = ("exists", e[1][1], not e[1][2])
    if e[0] == "exists":
        inner = group(facts, e[1], graph, filters=False)
        both = Bindings(None, b.kinds | inner.kinds)
        shared = [c for c in inner.kinds if c in b.kinds]
        if not shared:
            raise ValueError("EXISTS needs a variable of the group")
        r = inner.frame().select(*[F.col(c).alias(f"_r_{c}") if c in shared else F.col(c) for c in inner.kinds])
        on = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"_r_{c}") for c in shared] + [expression(f, both) for f in e[1].filters])
        return Bindings(b.frame().join(r, on, "left_semi" if e[2] else "left_anti"), b.kinds)
    return Bindings(b.frame().filter(expression(e, b)), b.kinds)


def text_of(e: tuple, b: Bindings) -> Column:
    """STR: the IRI of an entity, relation or source; values as they are."""
    if e[0] == "var" and b.kinds.get(e[1]) in ("entity", "relation", "source"):
        return uri(F.col(e[1]), b.kinds[e[1]])
    return expression(e, b).cast("string")


def expression(e: tuple, b: Bindings) -> Column:
    kind = e[0]
    sub = lambda x: expression(x, b)
    if kind == "var":
        if e[1] not in b.kinds:
            return F.lit(None).cast("string")
        return F.col(e[1])
    if kind == "is":
        return F.lit(e[1])
    if kind in ("num", "bool"):
        return F.lit(e[1])
    if kind == "||":
        return sub(e[1]) | sub(e[2])
    if kind == "&&":
        return sub(e[1]) & sub(e[2])
    if kind == "!":
        return ~sub(e[1])
    if kind == "neg":
        return -sub(e[1])
    if kind in ("=", "!=", "<", ">", "<=", ">="):
        x, y = sub(e[1]), sub(e[2])
        if "num" in (e[1][0], e[2][0]):
            x, y = x.try_cast("double"), y.try_cast("double")
        return {"=": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[kind]
    if kind in ("+", "-", "*", "/"):
        x, y = sub(e[1]).try_cast("double"), sub(e[2]).try_cast("double")
        return {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y)}[kind]
    if kind == "in":
        found = reduce(lambda x, y: x | y, [sub(e[1]) == sub(x) for x in e[2]]) if e[2] else F.lit(False)
        return found if e[3] else ~found
    if kind == "call":
        return called(e[1], e[2], b)
    raise ValueError(f"{kind} cannot stand here")


def called(name: str, args: list, b: Bindings) -> Column:
    x = [expression(a, b) for a in args]
    plain = lambda i: x[i].cast("string")
    if name == "STR":
        return text_of(args[0], b)
    if name == "REGEX":
        flags = "(?i)" if len(args) > 2 and "i" in args[2][1] else ""
        return F.rlike(plain(0), F.concat(F.lit(flags), plain(1)))
    if name == "SUBSTR":
        return plain(0).substr(x[1].cast("int"), x[2].cast("int") if len(x) > 2 else F.length(plain(0)))
    if name == "REPLACE":
        return F.regexp_replace(plain(0), plain(1), plain(2))
    if name in ("STRBEFORE", "STRAFTER"):
        at = F.instr(plain(0), plain(1))
        cut = plain(0).substr(F.lit(1), at - 1) if name == "STRBEFORE" else plain(0).substr(at + F.length(plain(1)), F.length(plain(0)))
        return F.when(at > 0, cut).otherwise("")
    if name == "SAMETERM":
        return x[0] == x[1]
    if name in ("ISIRI", "ISURI", "ISLITERAL"):
        named = args[0][0] == "var" and b.kinds.get(args[0][1]) in ("entity", "relation", "source")
        return F.lit(named == (name != "ISLITERAL"))
    simple = {
        "STRSTARTS": lambda: F.startswith(plain(0), plain(1)), "STRENDS": lambda: F.endswith(plain(0), plain(1)), "CONTAINS": lambda: F.contains(plain(0), plain(1)),
        "LCASE": lambda: F.lower(plain(0)), "UCASE": lambda: F.upper(plain(0)), "STRLEN": lambda: F.length(plain(0)), "CONCAT": lambda: F.concat(*[c.cast("string") for c in x]),
        "BOUND": lambda: x[0].isNotNull(), "IF": lambda: F.when(x[0], x[1]).otherwise(x[2]), "COALESCE": lambda: F.coalesce(*x), "ABS": lambda: F.abs(x[0].try_cast("double")),
        "ROUND": lambda: F.round(x[0].try_cast("double")), "CEIL": lambda: F.ceil(x[0].try_cast("double")), "FLOOR": lambda: F.floor(x[0].try_cast("double")), "ENCODE_FOR_URI": lambda: F.replace(F.url_encode(plain(0)), F.lit("+"), F.lit("%20")),
    }
    return simple[name]()


def aggregates_in(e) -> list:
    if isinstance(e, tuple):
        return [e] if e and e[0] == "agg" else [a for x in e for a in aggregates_in(x)]
    return [a for x in e for a in aggregates_in(x)] if isinstance(e, list) else []


def aggregated(e: tuple, b: Bindings) -> Column:
    _, name, distinct, what, sep = e
    if what is None:
        return F.countDistinct(F.struct(*b.kinds)) if distinct else F.count(F.lit(1))
    c = expression(what, b)
    if name == "COUNT":
        return F.countDistinct(c) if distinct else F.count(c)
    if name == "GROUP_CONCAT":
        items = F.collect_set(c.cast("string")) if distinct else F.collect_list(c.cast("string"))
        return F.array_join(F.sort_array(items), sep)
    if name in ("SUM", "AVG"):
        n = c.try_cast("double")
        return {"SUM": F.sum_distinct if distinct else F.sum, "AVG": F.avg}[name](n)
    return {"MIN": F.min, "MAX": F.max, "SAMPLE": F.min}[name](c)


def select(facts: DataFrame, q: Query) -> tuple[DataFrame, dict[str, str]]:
    b = group(facts, q.where)
    out, kinds = b.frame(), dict(b.kinds)
    if b.table is None:
        raise ValueError("SELECT needs variables")
    aggs = aggregates_in([e for _, e in q.columns if e] + q.having + [e for e, _ in q.order])
    if q.group or aggs:
        for name, e in q.group:
            if e != ("var", name):
                out, kinds[name] = out.withColumn(name, expression(e, b)), "value"
        names = {i: f"_a{i}" for i in range(len(aggs))}
        out = out.groupBy(*[n for n, _ in q.group]).agg(*[aggregated(a, b).alias(names[i]) for i, a in enumerate(aggs)]) if aggs else out.select(*[n for n, _ in q.group]).distinct()
        kinds = {n: kinds[n] for n, _ in q.group} | {n: "value" for n in names.values()}

        def swapped(e):
            for i, a in enumerate(aggs):
                if e == a:
                    return ("var", names[i])
            return tuple(swapped(x) for x in e) if isinstance(e, tuple) else [swapped(x) for x in e] if isinstance(e, list) else e
    else:
        swapped = lambda e: e
    b = Bindings(out, kinds)
    for e in q.having:
        out = out.filter(expression(swapped(e), b))
    for name, e in q.columns:
        if e:
            out, kinds[name] = out.withColumn(name, expression(swapped(e), Bindings(out, kinds))), "value"
    b = Bindings(out, kinds)
    keep = [n for n, _ in q.columns] or [c for c in out.columns if not c.startswith("_")]
    order = [(F.desc if down else F.asc)(f"_o{i}") for i, (_, down) in enumerate(q.order)]
    out = out.withColumns({f"_o{i}": expression(swapped(e), b) for i, (e, _) in enumerate(q.order)}) if order else out
    out = out.select(*[F.col(n) if n in out.columns else F.lit(None).cast("string").alias(n) for n in keep], *[f"_o{i}" for i in range(len(order))])
    if q.distinct:
        out = out.distinct()
    if order:
        out = out.orderBy(*order)
    if q.offset:
        out = out.offset(q.offset)
    if q.limit is not None:
        out = out.limit(q.limit)
    return out.select(*keep), {n: kinds.get(n, "value") for n in keep}


def run(facts: DataFrame, query: str) -> DataFrame:
    """The result of a query: SELECT one column per variable (null: unbound), ASK one row (found), CONSTRUCT (subject, relation, object)."""
    q = parse(query)
    keep = ["subject", "relation", "object"] + (["source"] if "source" in facts.columns else [])
    rows = facts.select(*keep)
    if uses_graph(q.where):
        rows = rows.distinct()
    elif "source" in keep:
        rows = rows.drop("source").distinct()
    if q.kind == "SELECT":
        return select(rows, q)[0]
    b = group(rows, q.where)
    if q.kind == "ASK":
        return b.frame().limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))
    made = []
    out = b.frame() if q.limit is None else b.frame().limit(q.limit)
    for _, s, p, o in q.template:
        p = ("is", p[1]) if p[0] == "rel" else p
        cols = [expression(t, b).cast("string").alias(n) for t, n in ((s, "subject"), (p, "relation"), (o, "object"))]
        made.append(out.select(*cols).filter("subject is not null and relation is not null and object is not null"))
    return reduce(DataFrame.union, made).distinct()


def uses_graph(g: Group) -> bool:
    return any(p[0] == "graph" or any(isinstance(x, Group) and uses_graph(x) for x in p) or (p[0] == "union" and any(map(uses_graph, p[1]))) for p in g.parts)
