"""Answers with proof, confidence and method: a cascade of plans that stops at the first that holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica import schema
from lattica.operators import graph, inference

ANSWER = "answer boolean, proof string, confidence double, method string"


def query(facts: DataFrame, subject: str, relation: str, obj: str, rules: DataFrame | None = None, properties: DataFrame | None = None, max_hops: int = 6) -> DataFrame:
    """One row: stated (0.95); false where a functional relation states another object (0.90; the least is named); derived by a path whose relations fold to
    the asked one (the chain's confidence); else null."""
    spark = facts.sparkSession
    rules = rules if rules is not None else schema.rules(spark)
    properties = properties if properties is not None else schema.properties(spark)
    s, r, o = (x.strip().lower() for x in (subject, relation, obj))
    stated = graph.objects(facts, s, r)
    if stated.filter(F.col("object") == o).limit(1).count():
        return spark.createDataFrame([(True, f"{s} {r} {o}", 0.95, "direct")], ANSWER)
    other = stated.agg(F.min("object")).first()[0]
    if other is not None and properties.filter((F.col("relation") == r) & (F.col("property") == "functional")).limit(1).count():
        return spark.createDataFrame([(False, f"{s} {r} {other}", 0.90, "contradiction")], ANSWER)
    both = [x["relation"] for x in properties.filter("property = 'symmetric'").select("relation").collect()]
    fits = inference.composed_relation(F.col("relations"), rules, properties, r)
    found = graph.best_path(facts, s, o, max_hops, both, fits)
    conf = inference.chain_confidence(F.col("relations"), rules, properties)
    row = found.select(graph.path_text("relations", "nodes").alias("p"), conf.alias("confidence")).first()
    return spark.createDataFrame([(True, f"Yes. {s} {r} {o} because: {row['p']}", row["confidence"], "derived") if row else (None, "", 0.0, "unknown")], ANSWER)


def open_query(facts: DataFrame, subject: str, relation: str) -> DataFrame:
    """(answer, confidence): the objects, then the subjects of the inverse relation."""
    inv = schema.INVERSES.get(relation)
    out = graph.objects(facts, subject, relation).select(F.col("object").alias("answer"))
    return (out.union(graph.subjects(facts, inv, subject)) if inv else out).withColumn("confidence", F.lit(0.85))


def ranked_relations(facts: DataFrame, words: list[str]) -> DataFrame:
    """(relation, score): ln(N / freq), one more where the relation's text is among words."""
    n = facts.count()
    freq = facts.groupBy("relation").agg(F.count("*").alias("f"))
    return freq.select("relation", (F.log(F.lit(float(n)) / F.col("f")) + F.when(F.col("relation").isin(*words), 1.0).otherwise(0.0)).alias("score"))


def open_multi_hop(facts: DataFrame, asked: DataFrame, max_hops: int = 7) -> DataFrame:
    """(subject, relation, answer, hops, proof): for rows (subject, relation) without such a fact the nearest end of a chain of facts whose last is of
    that relation, by name on ties. All rows walk together; a node is left where it was first reached."""
    from functools import reduce

    from lattica.plans.rounds import cut_counted

    f = facts.select(F.col("subject").alias("from"), F.col("relation").alias("r"), F.col("object").alias("to")).distinct()
    front = asked.select("subject", "relation", F.col("subject").alias("node"), F.lit("").alias("proof"))
    seen, hits = [front.select("subject", "relation", "node")], []
    for hop in range(1, max_hops + 1):
        step = front.join(f, F.col("node") == F.col("from")).select("subject", "relation", F.col("to").alias("node"), F.concat("proof", F.when(F.col("proof") != "", " , ").otherwise(""), "from", F.lit(" --"), "r", F.lit("--> "), "to").alias("proof"), (F.col("r") == F.col("relation")).alias("hit"))
        one = step.groupBy("subject", "relation", "node").agg(F.max(F.struct("hit", "proof")).alias("p")).select("subject", "relation", "node", "p.proof", "p.hit")
        front, n = cut_counted(one.join(reduce(DataFrame.unionByName, seen), ["subject", "relation", "node"], "left_anti"), "open")
        if not n:
            break
        hits.append(front.filter("hit").groupBy("subject", "relation").agg(F.min(F.struct("node", "proof")).alias("b")).select("subject", "relation", F.col("b.node").alias("answer"), F.lit(hop).alias("hops"), F.col("b.proof").alias("proof")))
        front = front.join(hits[-1].select("subject", "relation"), ["subject", "relation"], "left_anti")
        seen.append(front.select("subject", "relation", "node"))
    none = facts.sparkSession.createDataFrame([], "subject string, relation string, answer string, hops int, proof string")
    return reduce(DataFrame.unionByName, hits, none)
