"""Relations between entities through their intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import intervals
from lattica.sources.triples import latest_intervals


def relate(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, relation) for pairs (a, b): how a's last written interval stands to b's; null where one has none."""
    at = latest_intervals(facts)
    x = at.select(F.col("subject").alias("a"), F.col("t_start").alias("xs"), F.col("t_end").alias("xe"), F.lit(True).alias("has_x"))
    y = at.select(F.col("subject").alias("b"), F.col("t_start").alias("ys"), F.col("t_end").alias("ye"), F.lit(True).alias("has_y"))
    both = pairs.join(x, "a", "left").join(y, "b", "left")
    rel = intervals.classify(F.col("xs"), F.col("xe"), F.col("ys"), F.col("ye"))
    return both.select("a", "b", F.when(F.col("has_x") & F.col("has_y"), rel).alias("relation"))


def derive(stated: DataFrame, table: DataFrame) -> DataFrame:
    """(a, relation, c) that follow from stated (a, relation, b) and (b, relation, c) where table (first, second, result)
    leaves one result only; a and c differ and the fact is new."""
    sure = table.groupBy("first", "second").agg(F.count("*").alias("n"), F.first("result").alias("result")).filter("n = 1").drop("n")
    one = stated.select("a", F.col("relation").alias("first"), "b")
    two = stated.select(F.col("a").alias("b"), F.col("relation").alias("second"), F.col("b").alias("c"))
    made = one.join(two, "b").join(F.broadcast(sure), ["first", "second"]).filter("a <> c").select("a", F.col("result").alias("relation"), "c").distinct()
    known = stated.select("a", "relation", F.col("b").alias("c"))
    return made.join(known, ["a", "relation", "c"], "left_anti")


def intervals_of(facts: DataFrame, names: DataFrame) -> DataFrame:
    """(name, other, relation, t_start, t_end): the dated facts under a relation of time that touch names (name): that relation from the
    subject's side, its inverse from the object's."""
    known = list(intervals.INVERSE)
    dated = facts.filter(F.col("relation").isin(known) & F.coalesce("t_start", "t_end").isNotNull())
    out = dated.select(F.col("subject").alias("name"), F.col("object").alias("other"), "relation", "t_start", "t_end")
    back = dated.select(F.col("object").alias("name"), F.col("subject").alias("other"), intervals.inverse(F.col("relation")).alias("relation"), "t_start", "t_end")
    return out.unionByName(back.filter("name <> other")).join(names, "name", "left_semi")


def query(facts: DataFrame, asked: DataFrame, table: DataFrame, max_hops: int = 6) -> DataFrame:
    """(a, b, relation, answer, confidence, method) for rows (a, b, relation): by the two names' last written intervals (0.90: true if that is
    their relation, else false); else true (0.75) where a chain of facts leads from a to b whose first and last relations may compose to
    the one asked, by table (first, second, result); else null. A relation that is none of the thirteen gives null."""
    from functools import reduce

    from lattica.plans.rounds import cut, cut_counted

    known = list(intervals.INVERSE)
    rows = asked.select(F.lower(F.trim("a")).alias("a"), F.lower(F.trim("b")).alias("b"), F.lower(F.trim("relation")).alias("relation")).distinct()
    valid = F.col("relation").isin(known)
    told = cut(relate(facts, rows.select("a", "b").distinct()).withColumnRenamed("relation", "found"), "temporal")
    both = rows.join(told, ["a", "b"])
    direct = both.filter(valid & F.col("found").isNotNull()).select("a", "b", "relation", (F.col("found") == F.col("relation")).alias("answer"), F.lit(0.90).alias("confidence"), F.lit("direct").alias("method"))
    f = facts.select("subject", "relation", "object").distinct()
    open_ = both.filter(valid & F.col("found").isNull()).select("a", "b").distinct()
    front, ends = open_.select("a", "b", F.col("a").alias("node"), F.lit(None).cast("string").alias("first"), F.array("a").alias("seen")), []
    for hop in range(1, max_hops + 1):
        step = front.join(f.withColumnRenamed("relation", "last"), F.col("node") == F.col("subject")).filter(~F.array_contains("seen", F.col("object")))
        step = step.select("a", "b", F.col("object").alias("node"), F.coalesce("first", "last").alias("first"), "last", F.concat("seen", F.array("object")).alias("seen"))
        now, n = cut_counted(step, "chains")
        if not n:
            break
        if hop > 1:
            ends.append(now.filter("node = b").select("a", "b", "first", F.col("last").alias("second")))
        front = now.filter("node <> b").drop("last")
    zero = rows.filter("false").select("a", "b", F.lit("").alias("first"), F.lit("").alias("second"))
    chains = reduce(DataFrame.unionByName, ends, zero).distinct().join(F.broadcast(table), ["first", "second"]).select("a", "b", F.col("result").alias("relation")).distinct()
    derived = both.filter(valid & F.col("found").isNull()).join(chains, ["a", "b", "relation"], "left_semi").select("a", "b", "relation", F.lit(True).alias("answer"), F.lit(0.75).alias("confidence"), F.lit("derived").alias("method"))
    some = direct.unionByName(derived)
    out = rows.join(some, ["a", "b", "relation"], "left")
    return out.select("a", "b", "relation", "answer", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("method", F.lit("unknown")).alias("method"))


def derive_checked(facts: DataFrame, table: DataFrame) -> DataFrame:
    """(a, relation, c, proof): for dated facts under relations of time that share an entity, the one relation that table (first, second, result)
    leaves for their other ends - where those ends' own first dated intervals stand so."""
    sides = intervals_of(facts.filter("t_start is not null and t_end is not null"), facts.select(F.col("subject").alias("name")).union(facts.select("object")).distinct())
    sure = table.groupBy("first", "second").agg(F.count("*").alias("n"), F.first("result").alias("result")).filter("n = 1").drop("n")
    one = sides.select(F.col("name").alias("mid"), F.col("other").alias("a"), F.col("relation").alias("back"))
    one = one.select("mid", "a", intervals.inverse(F.col("back")).alias("first"))
    two = sides.select(F.col("name").alias("mid"), F.col("other").alias("c"), F.col("relation").alias("second"))
    made = one.join(two, "mid").filter("a <> c and a <> mid and c <> mid").join(F.broadcast(sure), ["first", "second"])
    own = facts.filter("t_start is not null and t_end is not null").select(F.explode(F.array("subject", "object")).alias("name"), "t_start", "t_end", "seq")
    own = own.groupBy("name").agg(F.min_by(F.struct("t_start", "t_end"), "seq").alias("t"))
    x, y = own.select(F.col("name").alias("a"), F.col("t").alias("x")), own.select(F.col("name").alias("c"), F.col("t").alias("y"))
    both = made.join(x, "a").join(y, "c")
    holds = intervals.classify(F.col("x.t_start"), F.col("x.t_end"), F.col("y.t_start"), F.col("y.t_end")) == F.col("result")
    proof = F.concat_ws(" ", "a", "first", "mid", F.lit("and"), "mid", "second", "c")
    out = both.filter(holds).groupBy("a", F.col("result").alias("relation"), "c").agg(F.min(proof).alias("proof"))
    known = facts.select(F.col("subject").alias("a"), "relation", F.col("object").alias("c"))
    return out.join(known, ["a", "relation", "c"], "left_anti")
