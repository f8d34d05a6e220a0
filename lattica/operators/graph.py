"""Lookups, neighbours, paths and closure over (subject, relation, object)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.plans.rounds import cut, cut_counted, discard


def facts_for_relation(facts: DataFrame, relation: str) -> DataFrame:
    return facts.filter(F.col("relation") == relation).select("subject", "object")


def objects(facts: DataFrame, subject: str, relation: str) -> DataFrame:
    return facts.filter((F.col("subject") == subject) & (F.col("relation") == relation)).select("object")


def subjects(facts: DataFrame, relation: str, obj: str) -> DataFrame:
    """Inverse lookup."""
    return facts.filter((F.col("relation") == relation) & (F.col("object") == obj)).select("subject")


def neighbors(facts: DataFrame, entity: str, direction: str = "both") -> DataFrame:
    """(relation, neighbor, direction) of rows that touch entity."""
    out = facts.filter(F.col("subject") == entity).select("relation", F.col("object").alias("neighbor"), F.lit("out").alias("direction"))
    into = facts.filter(F.col("object") == entity).select("relation", F.col("subject").alias("neighbor"), F.lit("in").alias("direction"))
    return out if direction == "out" else into if direction == "in" else out.unionByName(into)


def exists(facts: DataFrame, entity: str) -> bool:
    return bool(facts.filter((F.col("subject") == entity) | (F.col("object") == entity)).limit(1).count())


def entities(facts: DataFrame) -> DataFrame:
    return facts.select(F.col("subject").alias("entity")).union(facts.select(F.col("object").alias("entity"))).distinct()


def relations(facts: DataFrame) -> DataFrame:
    return facts.select("relation").distinct()


def two_hop(facts: DataFrame, first: str, second: str) -> DataFrame:
    """(subject, mid, object) for subject -first-> mid -second-> object."""
    a = facts_for_relation(facts, first).select("subject", F.col("object").alias("mid"))
    b = facts_for_relation(facts, second).select(F.col("subject").alias("mid"), "object")
    return a.join(b, "mid").select("subject", "mid", "object")


def closure(edges: DataFrame, max_rounds: int = 60, reflexive: bool = True) -> DataFrame:
    """(subject, object): the transitive closure of edges, semi-naive with doubling.

    The pairs found last are joined to all pairs on both sides' common end, so paths of length n take about log2(n) rounds. A
    round's new pairs are written once, to a table of their own; all pairs are the union of those tables. More rounds than
    max_rounds are an error. reflexive: keep pairs (x, x) that cycles give.
    """
    delta, n = cut_counted(edges.select("subject", "object").filter("subject is not null and object is not null").distinct(), "closure")
    parts = [delta]
    for _ in range(max_rounds):
        if not n:
            break
        known = reduce(DataFrame.union, parts)
        # new pairs, then all pairs; and older pairs, then new ones
        found = delta.select("subject", F.col("object").alias("mid")).join(known.select(F.col("subject").alias("mid"), "object"), "mid").select("subject", "object")
        if len(parts) > 1:
            older = reduce(DataFrame.union, parts[:-1])
            found = found.union(older.select("subject", F.col("object").alias("mid")).join(delta.select(F.col("subject").alias("mid"), "object"), "mid").select("subject", "object"))
        delta, n = cut_counted(found.distinct().join(known, ["subject", "object"], "left_anti"), "closure")
        if n:
            parts.append(delta)
        else:
            discard(delta)
    else:
        raise RuntimeError(f"no fixpoint in {max_rounds} rounds")
    known = reduce(DataFrame.union, parts)
    return known if reflexive else known.filter("subject <> object")


def reachable(edges: DataFrame, start: str, max_rounds: int = 10_000) -> DataFrame:
    """(node): what one or more edges (subject, object) lead to from start; only its surroundings are walked. start itself is there if
    a cycle leads back to it."""
    e = edges.select("subject", "object")
    front, n = cut_counted(e.filter(F.col("subject") == start).select(F.col("object").alias("node")).distinct(), "reach")
    parts = [front]
    for _ in range(max_rounds):
        if not n:
            break
        seen = reduce(DataFrame.union, parts)
        step = e.join(front.select(F.col("node").alias("subject")), "subject").select(F.col("object").alias("node")).distinct()
        front, n = cut_counted(step.join(seen, "node", "left_anti"), "reach")
        if n:
            parts.append(front)
    else:
        raise RuntimeError(f"no end in {max_rounds} rounds")
    return reduce(DataFrame.union, parts)


def paths(facts: DataFrame, start: str, end: str, max_hops: int = 6, symmetric: list[str] = ()) -> DataFrame:
    """(hops, relations, nodes): all simple paths from start to end of at most max_hops edges.

    Edges of symmetric relations are walked both ways. Nodes from which end cannot be reached in the hops left are pruned
    first, so the frontier holds only useful paths; both searches stop when their frontier is empty.
    """
    edges = facts.select("subject", "relation", "object")
    back = edges.filter(F.col("relation").isin(list(symmetric))).select(F.col("object").alias("subject"), "relation", F.col("subject").alias("object"))
    edges = edges.unionByName(back).distinct() if symmetric else edges.distinct()
    spark = facts.sparkSession
    none = spark.createDataFrame([], "hops int, relations array<string>, nodes array<string>")
    if start == end:
        return none
    far = [spark.createDataFrame([(end, 0)], "node string, d int")]
    for d in range(1, max_hops + 1):
        step = edges.join(far[-1].select(F.col("node").alias("object")), "object").select(F.col("subject").alias("node")).distinct()
        new, n = cut_counted(step.join(reduce(DataFrame.union, far), "node", "left_anti").select("node", F.lit(d).alias("d")), "reach")
        if not n:
            break
        far.append(new)
    useful = cut(edges.join(reduce(DataFrame.union, far).select(F.col("node").alias("object"), "d"), "object"), "useful")
    front = spark.createDataFrame([(start, [], [start])], "node string, relations array<string>, nodes array<string>")
    hits = [none]
    for hop in range(1, max_hops + 1):
        step = front.join(useful, F.col("node") == F.col("subject")).filter((F.col("d") <= max_hops - hop) & ~F.array_contains("nodes", F.col("object")))
        step = step.select(F.col("object").alias("node"), F.concat("relations", F.array("relation")).alias("relations"), F.concat("nodes", F.array("object")).alias("nodes"))
        front, n = cut_counted(step, "front")
        if not n:
            break
        hits.append(front.filter(F.col("node") == end).select(F.lit(hop).alias("hops"), "relations", "nodes"))
        front = front.filter(F.col("node") != end)
    return reduce(DataFrame.union, hits)


def best_path(facts: DataFrame, start: str, end: str, max_hops: int, symmetric: list[str], fits: Column) -> DataFrame:
    """Of the paths of fewest hops that fit (an expression over relations and nodes) the least by nodes: one row or none. The
    search goes hop by hop and stops at the first that has one."""
    edges = facts.select("subject", "relation", "object")
    back = edges.filter(F.col("relation").isin(list(symmetric))).select(F.col("object").alias("subject"), "relation", F.col("subject").alias("object"))
    edges = edges.unionByName(back).distinct() if symmetric else edges
    spark = facts.sparkSession
    front = spark.createDataFrame([(start, [], [start])], "node string, relations array<string>, nodes array<string>")
    for hop in range(1, max_hops + 1):
        step = front.join(edges, F.col("node") == F.col("subject")).filter(~F.array_contains("nodes", F.col("object")))
        step = step.select(F.col("object").alias("node"), F.concat("relations", F.array("relation")).alias("relations"), F.concat("nodes", F.array("object")).alias("nodes"))
        front, n = cut_counted(step.distinct(), "front")
        if not n:
            break
        hit = cut(front.filter((F.col("node") == end) & fits).orderBy(F.array_join("nodes", "|"), F.array_join("relations", "|")).limit(1).select(F.lit(hop).alias("hops"), "relations", "nodes"), "hit")
        if hit.count():
            return hit
        front = front.filter(F.col("node") != end)
    return spark.createDataFrame([], "hops int, relations array<string>, nodes array<string>")


def path_text(relations: str, nodes: str) -> Column:
    """a --r--> b , b --r--> c"""
    return F.array_join(F.transform(F.expr(f"sequence(1, size({relations}))"), lambda i: F.concat(F.get(nodes, i - 1), F.lit(" --"), F.get(relations, i - 1), F.lit("--> "), F.get(nodes, i))), " , ")
