"""Ontology checks: typed assertions from facts, and contradictions between an entity's types. Facts are never rejected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica import schema


def typed(facts: DataFrame) -> DataFrame:
    """(entity, type, seq): from is_a facts, and from the typed ends of relations; facts has subject, relation, object, seq."""
    types = schema.relation_types(facts.sparkSession)
    stated = facts.filter("relation = 'is_a'").select(F.col("subject").alias("entity"), F.col("object").alias("type"), "seq")
    both = facts.join(F.broadcast(types), "relation")
    ends = both.select("seq", F.explode(F.array(F.struct(F.col("subject").alias("entity"), F.col("domain").alias("type")), F.struct(F.col("object").alias("entity"), F.col("range").alias("type")))).alias("e"))
    return stated.unionByName(ends.select("e.entity", "e.type", "seq"))


def contradictions(facts: DataFrame) -> DataFrame:
    """(entity, prior_type, new_type): types of one entity that exclude each other, neither being a kind of the other."""
    spark = facts.sparkSession
    first = typed(facts).groupBy("entity", "type").agg(F.min("seq").alias("seq"))
    a = first.select("entity", F.col("type").alias("prior_type"), F.col("seq").alias("s1"))
    b = first.select("entity", F.col("type").alias("new_type"), F.col("seq").alias("s2"))
    pairs = a.join(b, "entity").filter("s1 < s2 or (s1 = s2 and prior_type < new_type)")
    ban = schema.disjoint_pairs(spark).select(F.col("type_a").alias("prior_type"), F.col("type_b").alias("new_type")).distinct()
    sub = schema.subsumption(spark)
    kin = sub.select(F.col("subtype").alias("prior_type"), F.col("supertype").alias("new_type")).union(sub.select(F.col("supertype").alias("prior_type"), F.col("subtype").alias("new_type")))
    keys = ["prior_type", "new_type"]
    return pairs.join(F.broadcast(ban), keys, "left_semi").join(F.broadcast(kin), keys, "left_anti").select("entity", "prior_type", "new_type")


def type_proofs(facts: DataFrame) -> DataFrame:
    """(entity, type, proof): the fact that first gave an entity a type."""
    said = facts.select("seq", F.concat_ws(" ", "subject", "relation", "object").alias("proof"))
    t = typed(facts).join(said, "seq")
    return t.groupBy("entity", "type").agg(F.min_by("proof", F.struct("seq", "proof")).alias("proof"))


def types_of(facts: DataFrame) -> DataFrame:
    return typed(facts).groupBy("entity").agg(F.sort_array(F.collect_set("type")).alias("types"))


def warnings(facts: DataFrame) -> DataFrame:
    """(entity, prior_type, new_type, text): contradictions, said with the facts behind them."""
    p = type_proofs(facts)
    a = p.select("entity", F.col("type").alias("prior_type"), F.col("proof").alias("_a"))
    b = p.select("entity", F.col("type").alias("new_type"), F.col("proof").alias("_b"))
    out = contradictions(facts).join(a, ["entity", "prior_type"]).join(b, ["entity", "new_type"])
    text = F.format_string("Contradiction for '%s': previously inferred as '%s' (%s), now identified as '%s' (%s). These types are mutually exclusive.", "entity", "prior_type", "_a", "new_type", "_b")
    return out.select("entity", "prior_type", "new_type", text.alias("text"))


def is_a_objects(facts: DataFrame, entity: str) -> DataFrame:
    return facts.filter((F.col("subject") == entity) & (F.col("relation") == "is_a")).select("object")
