"""Rule-based derivation, property detection, chain confidence and identity tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.graph import closure
from lattica.plans.rounds import cut, cut_counted

KEY = ["subject", "relation", "object"]


def composed(first: DataFrame, second: DataFrame, live: DataFrame) -> DataFrame:
    """(subject, relation, object): x r1 y of first with y r2 z of second under the rules live (rel1, rel2, target), z not x."""
    a = first.select("subject", F.col("relation").alias("rel1"), F.col("object").alias("mid"))
    b = second.select(F.col("subject").alias("mid"), F.col("relation").alias("rel2"), F.col("object"))
    # the rules narrow each side before they meet
    left = a.join(live.select("rel1", "rel2", "target"), "rel1")
    right = b.join(live.select("rel2").distinct(), "rel2", "left_semi")
    return left.join(right, ["mid", "rel2"]).filter("subject <> object").select("subject", F.col("target").alias("relation"), "object")


def compose(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """(subject, relation, object) that one application of the rules adds: x r1 y, y r2 z, z not x; blocked pairs add nothing."""
    made = composed(facts, facts, rules.filter("target is not null"))
    return made.distinct().join(facts.select(*KEY), KEY, "left_anti")


def derive_all(facts: DataFrame, rules: DataFrame, properties: DataFrame, max_rounds: int = 1000, reflexive: bool = False) -> DataFrame:
    """(subject, relation, object, source): facts, the closure of transitive relations, then rules to fixpoint, semi-naive.

    A round joins only what is new with all that is known, on both sides, and writes it to a table of its own; what is known is
    the union of those tables. A rule r r -> r of a relation that is closed is left out of the first round, as it can add nothing
    there. reflexive: keep x r x that cycles give. More rounds than max_rounds are an error.
    """
    base = cut(facts.select(*KEY).distinct(), "base")
    moving = properties.filter("property = 'transitive'").select("relation").distinct()
    of = base.join(F.broadcast(moving), "relation", "left_semi")
    tag = F.concat_ws("\x1f", "relation", "subject"), F.concat_ws("\x1f", "relation", "object")
    closed = closure(of.select(tag[0].alias("subject"), tag[1].alias("object")), reflexive=reflexive)
    part = lambda c, i: F.split(c, "\x1f")[i]
    closed = closed.select(part("subject", 1).alias("subject"), part("subject", 0).alias("relation"), part("object", 1).alias("object"))
    parts = [base.withColumn("source", F.lit("user")), cut(closed.join(base, KEY, "left_anti").withColumn("source", F.lit("derived")), "closed")]
    live = F.broadcast(cut(rules.filter("target is not null").select("rel1", "rel2", "target").distinct(), "rules"))
    own = moving.select(F.col("relation").alias("rel1"), F.col("relation").alias("rel2"), F.col("relation").alias("target"))
    first_rules = F.broadcast(cut(live.join(own, ["rel1", "rel2", "target"], "left_anti"), "rules"))
    delta = None
    for _ in range(max_rounds):
        known = reduce(DataFrame.union, parts).select(*KEY)
        made = composed(known, known, first_rules) if delta is None else composed(delta, known, live).union(composed(known, delta, live))
        delta, n = cut_counted(made.distinct().join(known, KEY, "left_anti"), "composed")
        if not n:
            break
        parts.append(delta.withColumn("source", F.lit("derived")))
    else:
        raise RuntimeError(f"no fixpoint in {max_rounds} rounds")
    return reduce(DataFrame.union, parts)


def derive_symmetric(facts: DataFrame, properties: DataFrame) -> DataFrame:
    """(subject, relation, object): the reverses of facts of symmetric relations that are not stated."""
    of = properties.filter("property = 'symmetric'").select("relation")
    back = facts.join(F.broadcast(of), "relation", "left_semi").select(F.col("object").alias("subject"), "relation", F.col("subject").alias("object"))
    return back.distinct().join(facts.select(*KEY), KEY, "left_anti")


def detect_properties(facts: DataFrame, min_evidence: int = 3, share: float = 0.8) -> DataFrame:
    """(relation, chains, closed, pairs, reversed, subjects, fan_out, transitive, symmetric, functional) per relation.

    chains: two-edge paths x y z, z not x, counted from the in- and out-degrees of y less the edges that turn back; closed:
    those with an edge x z, counted by joining each edge x z with the edges out of x and into z - the paths themselves are
    never made, and a relation without any edge x z to start from costs nothing.
    """
    e = cut(facts.select(*KEY).distinct(), "edges")
    into = e.groupBy("relation", F.col("object").alias("y")).agg(F.count("*").alias("i"))
    out = e.groupBy("relation", F.col("subject").alias("y")).agg(F.count("*").alias("o"))
    degrees = cut(out.join(into, ["relation", "y"], "full").select("relation", "y", F.coalesce("i", F.lit(0)).alias("i"), F.coalesce("o", F.lit(0)).alias("o")), "degrees")
    back = e.select("relation", F.col("subject").alias("object"), F.col("object").alias("subject"))
    turned = e.join(back, KEY, "left_semi")  # edges whose reverse is stated, loops too
    turns = turned.groupBy("relation").agg(F.count("*").alias("turns"), F.count(F.when(F.col("subject") != F.col("object"), 1)).alias("reversed"))
    each = degrees.groupBy("relation").agg(F.sum(F.col("i") * F.col("o")).alias("paths"), F.count(F.when(F.col("o") > 0, 1)).alias("subjects"), F.max("o").alias("fan_out"))
    pairs = e.groupBy("relation").agg(F.count(F.when(F.col("subject") != F.col("object"), 1)).alias("pairs"))
    # only nodes y with edges in and out stand inside a path
    inner = degrees.filter("i > 0 and o > 0").select("relation", "y")
    one = e.join(inner.withColumnRenamed("y", "object"), ["relation", "object"], "left_semi").select("relation", "subject", F.col("object").alias("y"))
    two = e.join(inner.withColumnRenamed("y", "subject"), ["relation", "subject"], "left_semi").select("relation", F.col("subject").alias("y"), "object")
    starts, stops = one.select("relation", "subject").distinct(), two.select("relation", "object").distinct()
    ends = e.filter("subject <> object").join(starts, ["relation", "subject"], "left_semi").join(stops, ["relation", "object"], "left_semi")
    closed = ends.join(one, ["relation", "subject"]).join(two, ["relation", "y", "object"], "left_semi").groupBy("relation").agg(F.count("*").alias("closed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    got = each.join(pairs, "relation").join(closed, "relation", "left").join(turns, "relation", "left")
    got = got.select("relation", (F.col("paths") - zero("turns")).alias("chains"), zero("closed").alias("closed"), "pairs", zero("reversed").alias("reversed"), "subjects", "fan_out")
    return got.withColumns({
        "transitive": (F.col("chains") >= min_evidence) & (F.col("closed") >= share * F.col("chains")),
        "symmetric": (F.col("pairs") >= min_evidence) & (F.col("reversed") >= share * F.col("pairs")),
        "functional": (F.col("subjects") >= min_evidence) & (F.col("fan_out") <= 1),
    })


def functional_conflicts(facts: DataFrame, relation: str) -> DataFrame:
    """(subject, n): subjects with several objects under a functional relation."""
    return facts.filter(F.col("relation") == relation).groupBy("subject").agg(F.countDistinct("object").alias("n")).filter("n > 1")


def check_same(facts: DataFrame, pairs: DataFrame, functional: list[str]) -> DataFrame:
    """(a, b, same, confidence): identical or stated equal; different where a functional relation tells them apart; else unknown."""
    alike = facts.filter(F.col("relation").isin("same_as", "equals", "identical_to")).select(F.col("subject").alias("a"), F.col("object").alias("b"))
    alike = alike.union(alike.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().withColumn("stated", F.lit(True))
    f = facts.filter(F.col("relation").isin(list(functional)))
    va = f.select(F.col("subject").alias("a"), "relation", F.col("object").alias("x"))
    vb = f.select(F.col("subject").alias("b"), "relation", F.col("object").alias("y"))
    differ = pairs.join(va, "a").join(vb, ["b", "relation"]).filter("x <> y").select("a", "b").distinct().withColumn("differ", F.lit(True))
    got = pairs.join(alike, ["a", "b"], "left").join(differ, ["a", "b"], "left")
    same = F.when(F.col("a") == F.col("b"), True).when(F.col("stated"), True).when(F.col("differ"), False)
    conf = F.when(F.col("a") == F.col("b"), 1.0).when(F.col("stated"), 0.95).when(F.col("differ"), 0.90).otherwise(0.0)
    return got.select("a", "b", same.alias("same"), conf.alias("confidence"))


def chain_confidence(relations: Column, rules: DataFrame, properties: DataFrame) -> Column:
    """Confidence of a chain of relations: 0.95 for one step; else the product of 1.0 per ruled step, 0.7 where what is composed so
    far is transitive, 0.4 otherwise, within [0.1, 0.95]. Rules are a bounded table and become a literal map."""
    table = {f"{r['rel1']}|{r['rel2']}": r["target"] for r in rules.filter("target is not null").collect()}
    rule = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    moving = F.array(*[F.lit(r["relation"]) for r in properties.filter("property = 'transitive'").collect()])

    def step(acc: Column, r: Column) -> Column:
        to = F.try_element_at(rule, F.concat(acc["at"], F.lit("|"), r))
        score = F.when(to.isNotNull(), 1.0).when(F.array_contains(moving, acc["at"]), 0.7).otherwise(0.4)
        return F.struct(F.coalesce(to, r).alias("at"), (acc["p"] * score).alias("p"))

    rest = F.slice(relations, 2, F.greatest(F.size(relations) - 1, F.lit(0)))
    p = F.aggregate(rest, F.struct(F.get(relations, F.lit(0)).alias("at"), F.lit(1.0).alias("p")), step, lambda a: a["p"])
    return F.when(F.size(relations) == 0, 0.0).when(F.size(relations) == 1, 0.95).otherwise(F.round(F.greatest(F.lit(0.1), F.least(F.lit(0.95), p)), 2))


def composed_relation(relations: Column, rules: DataFrame, properties: DataFrame, target: str) -> Column:
    """Whether a chain of relations folds to target: a blocked pair (null rule) ends it; without a rule it goes on only if target is transitive."""
    rows = rules.collect()
    rule = F.create_map(*[F.lit(x) for r in rows for x in (f"{r['rel1']}|{r['rel2']}", r["target"] if r["target"] is not None else "\x00")])
    free = any(r["relation"] == target for r in properties.filter("property = 'transitive'").collect())

    def step(acc: Column, r: Column) -> Column:
        to = F.try_element_at(rule, F.concat(acc, F.lit("|"), r))
        return F.when(acc == "\x00", acc).when(to.isNotNull(), to).otherwise(F.lit(target if free else "\x00"))

    return F.aggregate(F.slice(relations, 2, F.greatest(F.size(relations) - 1, F.lit(0))), F.get(relations, F.lit(0)), step) == target
