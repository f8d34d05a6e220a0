"""Small finite domains: assignments that meet constraints, as joins of ranges that are filtered as they grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def solve(spark: SparkSession, domains: dict[str, range], constraints: list[tuple[tuple[str, ...], str]], limit: int | None = None, max_cells: int = 100_000_000) -> DataFrame:
    """All assignments of the variables that satisfy the constraints (the variables used, a SQL predicate).

    Variables join one at a time; each constraint is applied as soon as its variables are there. Domains are ranges, stated by the
    caller; a search space above max_cells is an error before it starts. limit keeps the least assignments.
    """
    size = 1
    for d in domains.values():
        size *= max(1, len(d))
    if size > max_cells:
        raise ValueError(f"{size} cells: give smaller domains")
    left, have, out = list(constraints), set(), None
    for name, d in domains.items():
        column = spark.range(d.start, d.stop, d.step).select(F.col("id").alias(name))
        have.add(name)
        ready = [c for c in left if set(c[0]) <= have]
        left = [c for c in left if c not in ready]
        test = F.expr(" and ".join(f"({p})" for _, p in ready)) if ready else F.lit(True)
        out = column.filter(test) if out is None else out.join(F.broadcast(column), test)
    out = out.select(*domains)
    return out.orderBy(*domains).limit(limit) if limit else out


def all_different(names: list[str]) -> list[tuple[tuple[str, ...], str]]:
    return [((a, b), f"{a} <> {b}") for i, a in enumerate(names) for b in names[i + 1 :]]


# --- named constraints

LARGEST = 100


def chained(names: list[str], text: str) -> list[tuple[tuple[str, ...], str]]:
    """text over each name {a} and the next {b}."""
    return [((a, b), text.format(a=a, b=b)) for a, b in zip(names, names[1:], strict=False)]


def every_pair(names: list[str], text: str) -> list[tuple[tuple[str, ...], str]]:
    return [((a, b), text.format(a=a, b=b)) for i, a in enumerate(names) for b in names[i + 1 :]]


def summed(names: list[str], sign: str, value: int) -> list[tuple[tuple[str, ...], str]]:
    return [(tuple(names), f"{' + '.join(names)} {sign} {value}")] if names else []


def true_ones(names: list[str], sign: str, value: int) -> list[tuple[tuple[str, ...], str]]:
    """How many of some variables are not 0."""
    return [(tuple(names), " + ".join(f"cast({n} <> 0 as int)" for n in names) + f" {sign} {value}")] if names else []


SIGNS = {"eq": "=", "geq": ">=", "leq": "<=", "sum_eq": "=", "sum_geq": ">=", "sum_leq": "<="}


def excluded(names: list[str], p: dict) -> list:
    if len(names) == 2:
        return chained(names, "{a} <> {b}")
    return [((n,), f"{n} <> {p.get('exclude_value', 0)}") for n in names[:1]]


def grouped(names: list[str], p: dict) -> list:
    kind, limit, out = p.get("group_constraint", "sum_leq"), p.get("limit"), []
    for g in p.get("groups", [names]):
        if kind == "distinct":
            out += all_different(g)
        elif limit is not None:
            out += summed(g, SIGNS[kind], limit)
    return out


#: The named constraints: each gives predicates from its variables and parameters. `optimized` is an order, not a predicate.
PRIMITIVES = {
    "all_different": lambda v, p: all_different(v),
    "ordered": lambda v, p: chained(v, "{a} < {b}" if p.get("order", "ascending") == "ascending" else "{a} > {b}"),
    "bounded": lambda v, p: [((n,), f"{n} between {p.get('min', 0)} and {p.get('max', LARGEST)}") for n in v],
    "excluded": excluded,
    "grouped": grouped,
    "optimized": lambda v, p: [],
    "sum_eq": lambda v, p: summed(v, "=", p.get("target", 0)),
    "sum_leq": lambda v, p: summed(v, "<=", p.get("limit", 0)),
    "sum_geq": lambda v, p: summed(v, ">=", p.get("limit", 0)),
    "count": lambda v, p: true_ones(v, SIGNS[p.get("condition", "eq")], p.get("target", 0)),
    "ratio": lambda v, p: chained(v[:2], "{a} = " + str(p.get("ratio", 1)) + " * {b}"),
    "implies": lambda v, p: chained(v, "({a} = 0 or {b} <> 0)"),
    "equivalent": lambda v, p: chained(v, "{a} = {b}"),
    "at_least": lambda v, p: true_ones(v, ">=", p.get("n", 1)),
    "at_most": lambda v, p: true_ones(v, "<=", p.get("n", 1)),
    "exactly": lambda v, p: true_ones(v, "=", p.get("n", 1)),
    "no_overlap": lambda v, p: every_pair(v, "({a} + " + str(p.get("duration", 1)) + " <= {b} or {b} + " + str(p.get("duration", 1)) + " <= {a})"),
    "precedence": lambda v, p: chained(v, "{a} + " + str(p.get("min_gap", 1)) + " <= {b}"),
}


def satisfy(spark: SparkSession, domains: dict[str, range], primitives: list[dict], limit: int | None = None, **options) -> DataFrame:
    """All assignments that meet the primitives (type, subjects, parameters); with an `optimized` one the best of them, least names first on ties."""
    made, best = [], None
    for p in primitives:
        names = [s for s in p.get("subjects", []) if s in domains]
        if p["type"] not in PRIMITIVES:
            raise ValueError(f"no constraint {p['type']!r}")
        made += PRIMITIVES[p["type"]](names, p)
        if p["type"] == "optimized" and names:
            if p.get("objective", "maximize_min") == "maximize_min":
                best = F.desc(F.least(*names) if len(names) > 1 else F.col(names[0]))
            else:
                total = F.expr(" + ".join(names))
                best = total.desc() if p.get("direction", "maximize") == "maximize" else total.asc()
    out = solve(spark, domains, made, None, **options)
    if best is not None:
        return out.orderBy(best, *domains).limit(limit or 1)
    return out.orderBy(*domains).limit(limit) if limit else out


def formatted(row, domains: dict[str, range], primitives: list[dict]) -> dict:
    """A found assignment (a row, or None) as text, with the primitives that made it."""
    if row is None:
        return {"type": "unsat", "formatted": "No solution exists -- constraints are contradictory."}
    kinds = [p["type"] for p in primitives]
    return {"type": "generic_csp", "method": "enumerated_" + ("+".join(kinds) or "generic"), "formatted": "\n".join(f"  {n}: {row[n]}" for n in domains), "primitives_applied": kinds}


# --- constraints read off a problem: entities (id, text) and relations (src, kind, tgt)


def numbers_in(text: str) -> list[int]:
    return [int(w) for w in text.split() if w.isdigit()]


def order_of(relations: list[tuple[str, str]]) -> list[str]:
    """All nodes with every source before its target, names first seen first; nothing where they go round."""
    nodes = list(dict.fromkeys(x for r in relations for x in r))
    left = {n: sum(t == n for _, t in relations) for n in nodes}
    ready, out = [n for n in nodes if not left[n]], []
    while ready:
        n = ready.pop(0)
        out.append(n)
        for s, t in relations:
            if s == n:
                left[t] -= 1
                if not left[t]:
                    ready.append(t)
    return out if len(out) == len(nodes) else []


def groups_of(relations: list[tuple[str, str]]) -> list[list[str]]:
    """The nodes that relations tie together, each group and the groups as first seen."""
    out: list[list[str]] = []
    for pair in relations:
        hit = [g for g in out if set(pair) & set(g)]
        joined = list(dict.fromkeys([x for g in hit for x in g] + list(pair)))
        if hit:
            out[out.index(hit[0])] = joined
            out = [g for g in out if g is joined or g not in hit[1:]]
        else:
            out.append(joined)
    return out


def bounds_of(entities: list[tuple[str, str]]) -> dict:
    return {"min": 0, "max": max([LARGEST] + [2 * max(n) for _, t in entities if (n := numbers_in(t))])}


def total_of(entities: list[tuple[str, str]]) -> int | None:
    return next((max(n) for _, t in entities if (n := numbers_in(t))), None)


def count_of(relations: list[tuple[str, str]]) -> int:
    return next((max(n) for s, t in relations if (n := numbers_in(s) + numbers_in(t))), 1)


def inferred(entities: list[tuple[str, str]], relations: list[tuple[str, str, str]]) -> list[dict]:
    """The primitives that a problem's relations stand for."""
    ids = [i for i, _ in entities]
    of = lambda *kinds: [(s, t) for k in kinds for s, kind, t in relations if kind == k]
    nodes = lambda pairs: list(dict.fromkeys(x for p in pairs for x in p))
    out: list[dict] = []
    if d := of("different", "distinct"):
        out.append({"type": "all_different", "subjects": nodes(d)})
    for kind, order in (("before", "ascending"), ("after", "descending")):
        if chain := order_of(of(kind)):
            out.append({"type": "ordered", "subjects": chain, "order": order})
    out += [{"type": "excluded", "subjects": [s, t]} for s, t in of("excludes")]
    if of("limited"):
        out.append({"type": "bounded", "subjects": ids, **bounds_of(entities)})
    if g := of("grouped", "partitioned"):
        out.append({"type": "grouped", "subjects": [], "groups": groups_of(g)})
    if of("optimize", "maximize", "minimize"):
        out.append({"type": "optimized", "subjects": ids, "direction": "maximize" if of("optimize", "maximize") else "minimize", "objective": "maximize_min"})
    if of("sum_to", "total") and (t := total_of(entities)) is not None:
        out.append({"type": "sum_eq", "subjects": ids, "target": t})
    out += [{"type": k, "subjects": ids, "n": count_of(r)} for k in ("at_least", "at_most", "exactly") if (r := of(k))]
    for kind, names, more in (("implies", ("implies", "if_then"), {}), ("equivalent", ("equivalent", "same"), {}), ("no_overlap", ("overlap", "conflict"), {"duration": 1})):
        if r := of(*names):
            out.append({"type": kind, "subjects": nodes(r), **more})
    if chain := order_of(of("precedence", "chain")):
        out.append({"type": "precedence", "subjects": chain, "min_gap": 1})
    out += [{"type": "ratio", "subjects": [s, t], "ratio": 2} for s, t in of("ratio", "proportional")]
    if r := of("count"):
        out.append({"type": "count", "subjects": ids, "condition": "eq", "target": count_of(r)})
    return out


def from_constraint(subjects: list[str], params: dict) -> dict:
    return {"type": params.get("primitive_type", "bounded"), "subjects": subjects, **{k: v for k, v in params.items() if k != "primitive_type"}}


def from_template(template: list[dict], entities: list[tuple[str, str]], similar: dict[str, list[str]] | None = None) -> list[dict]:
    """A template's primitives over a problem's entities: the first ones as many as it names, or those its selector is like, best first."""
    out = []
    for p in template:
        ids = (similar or {}).get(p["selector"], []) if p.get("selector") else [i for i, _ in entities[: len(p.get("subjects", []))]]
        if ids:
            out.append({**{k: v for k, v in p.items() if k != "selector"}, "subjects": ids})
    return out


def is_boolean(entity: str, constraints: list[dict]) -> bool:
    return any(entity in c["subjects"] and c.get("params", {}).get("type") == "bool" for c in constraints)


# --- models of some kinds of problems


def schedule(spark: SparkSession, people: list[str], days: int = 5, slots: int = 3) -> DataFrame:
    """(who, day, slot): people get different places of days x slots, the earliest, in their order; more people than places is an error."""
    if len(people) > days * slots:
        raise ValueError("more people than places")
    return spark.createDataFrame([(p, i // slots, i % slots) for i, p in enumerate(people)], "who string, day int, slot int")


def budget(total: int, minima: dict[str, int]) -> dict[str, int]:
    """Shares of total that are at least minima and whose least is as large as can be; odd units go to the first of the least."""
    if sum(minima.values()) > total:
        raise ValueError("the minima exceed the total")
    out, spare = dict(minima), total - sum(minima.values())
    while spare and out:
        least = min(out.values())
        low = [k for k in out if out[k] == least]
        above = min((v for v in out.values() if v > least), default=least + spare)
        step = min(above - least, spare // len(low))
        for k in low if step else low[:spare]:
            out[k] += step or 1
        spare -= step * len(low) if step else min(spare, len(low))
    return out


def knapsack(items: DataFrame, capacity: int) -> DataFrame:
    """(chosen array<string>, value, weight): items (name, value, weight) of the greatest value within capacity; of equal ones the lighter, then by
    names. One row; states are merged by weight after every item, so there are at most capacity + 1 of them."""
    rows = items.orderBy("name").collect()
    best: dict[int, tuple] = {0: (0, ())}
    for r in rows:
        for w, (v, names) in sorted(best.items(), reverse=True):
            if (w2 := w + r["weight"]) <= capacity:
                cand = (v + r["value"], (*names, r["name"]))
                if w2 not in best or (-cand[0], cand[1]) < (-best[w2][0], best[w2][1]):
                    best[w2] = cand
    w, (v, names) = min(best.items(), key=lambda x: (-x[1][0], x[0], x[1][1]))
    return items.sparkSession.createDataFrame([(list(names), v, w)], "chosen array<string>, value long, weight long")
