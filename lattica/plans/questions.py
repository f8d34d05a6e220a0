"""Questions answered from a graph, a table of them at once: every step is a join over all questions, and each question takes the
first step that answers it.

1. Entities: names of the graph that stand in the text (`extraction.entities_in`), in order.
2. Two or more: the relation that the words name (a word, two words of a two-part name, or alike by edit ratio 0.75). Questions of
   equality go to `check_same`. Then pair after pair: stated under the relation, reached by it alone, stated under any relation, by
   two facts, by up to max_hops.
3. One: relations that the words name (score 1; 0.5 for two-part names), answered forward, else backward; if none answers and it is
   a question, the fact of the entity that ranks best: rare relations, those in the text and forward ones first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica import languages, schema
from lattica.functions import text as tx
from lattica.operators import inference
from lattica.operators.extraction import entities_in
from lattica.plans.rounds import cut, cut_counted

RESULT = "key, answer, confidence, method"


def spotted(words: DataFrame, relations: DataFrame, copulas: tuple) -> DataFrame:
    """(key, relation, score, at): the relations that rows (key, ws) name: 1 where a word is one, 0.5 where two words in a row are its two parts."""
    each = words.select("key", F.posexplode("ws").alias("at", "w"), "ws").withColumn("next", F.get("ws", F.col("at") + 1))
    exact = each.join(relations.select(F.col("relation").alias("w")), "w").select("key", F.col("w").alias("relation"), F.lit(1.0).alias("score"), "at")
    parts = relations.withColumn("p", F.split("relation", "_")).filter("size(p) = 2").select("relation", F.col("p")[0].alias("w"), F.col("p")[1].alias("next"))
    pairs = each.filter(~F.col("w").isin(*copulas)).join(parts, ["w", "next"]).select("key", "relation", F.lit(0.5).alias("score"), "at")
    return exact.unionByName(pairs)


def alike(words: DataFrame, relations: DataFrame, least: float = 0.75, most: int = 100_000) -> DataFrame:
    """(key, relation): for rows (key, ws) the first relation by name each part of which some word is like, by the ratio of matching blocks.
    The distinct words meet the parts of relations (a bounded table) in tasks, not on the driver."""
    import difflib

    import pandas as pd

    rows = [r["relation"] for r in relations.select("relation").distinct().orderBy("relation").limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} relations")
    parts = sorted({p for r in rows if len(r.split("_")) <= 2 for p in r.split("_")})
    held = words.sparkSession.sparkContext.broadcast(parts)

    def run(batches):
        for pdf in batches:
            out = []
            for w in pdf["w"]:
                m = difflib.SequenceMatcher(None, "", w)
                for p in held.value:
                    m.set_seq1(w)
                    m.set_seq2(p)
                    if m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least:
                        out.append((w, p))
            yield pd.DataFrame(out, columns=["w", "part"])

    each = words.select("key", F.explode("ws").alias("w")).distinct()
    near = each.select("w").distinct().mapInPandas(run, "w string, part string")
    said = each.join(near, "w").select("key", "part").distinct()
    wanted = relations.select("relation", F.explode(F.array_distinct(F.split("relation", "_"))).alias("part"), F.size(F.array_distinct(F.split("relation", "_"))).alias("need"), F.size(F.split("relation", "_")).alias("size")).filter("size <= 2")
    met = said.join(wanted, "part").groupBy("key", "relation", "need").agg(F.count("*").alias("n")).filter("n = need")
    return met.groupBy("key").agg(F.min("relation").alias("relation"))


def connected(pairs: DataFrame, facts: DataFrame, max_hops: int) -> DataFrame:
    """(key, i, j, hops, rels, mid): for pairs (key, i, j, a, b, only) the shortest chain of facts from a to b, of relation only where that
    is not null; at most max_hops. All pairs walk together; a node is left where it was first reached."""
    f = facts.select("subject", "relation", "object").distinct()
    front = pairs.select("key", "i", "j", "b", F.coalesce("only", F.lit("")).alias("only"), F.col("a").alias("node"), F.array().cast("array<string>").alias("rels"), F.array("a").alias("nodes"))
    state = ["key", "i", "j", "only", "node"]
    seen, hits = [front.select(*state)], []
    for hop in range(1, max_hops + 1):
        step = front.join(f, (F.col("node") == F.col("subject")) & ((F.col("only") == "") | (F.col("only") == F.col("relation"))))
        step = step.select("key", "i", "j", "b", "only", F.col("object").alias("node"), F.concat("rels", F.array("relation")).alias("rels"), F.concat("nodes", F.array("object")).alias("nodes"))
        one = step.groupBy("key", "i", "j", "b", "only", "node").agg(F.min(F.struct("rels", "nodes")).alias("p")).select("key", "i", "j", "b", "only", "node", "p.rels", "p.nodes")
        front, n = cut_counted(one.join(reduce(DataFrame.unionByName, seen), state, "left_anti"), "walk")
        if not n:
            break
        hits.append(front.filter("node = b").select("key", "i", "j", F.lit(hop).alias("hops"), "rels", "nodes"))
        front = front.join(hits[-1].select("key", "i", "j"), ["key", "i", "j"], "left_anti")
        seen.append(front.select(*state))
    empty = pairs.sparkSession.createDataFrame([], "key string, i int, j int, hops int, rels array<string>, nodes array<string>")
    return reduce(DataFrame.unionByName, hits) if hits else empty.select(F.col("key").cast(pairs.schema["key"].dataType).alias("key"), "i", "j", "hops", "rels", "nodes")


def answers(questions: DataFrame, facts: DataFrame, properties: DataFrame | None = None, lang: str = "en", max_hops: int = 6) -> DataFrame:
    """(key, answer, confidence, method) for rows (key, text) of questions; a question without an answer gets null, 0 and unknown."""
    spark, language = questions.sparkSession, languages.get(lang)
    properties = properties if properties is not None else schema.properties(spark)
    facts = facts.select("subject", "relation", "object").distinct()
    names = facts.select(F.col("subject").alias("name")).union(facts.select("object")).distinct()
    relations = cut(facts.select("relation").union(properties.select("relation")).distinct(), "relations")
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}_:]+", " "), " "), lambda w: w != "")
    asked = cut(questions.select("key", "text", words.alias("ws"), tx.is_question(F.col("text")).alias("q")), "questions")
    asked = asked.withColumn("interrogative", F.col("q") | F.arrays_overlap("ws", F.array(*[F.lit(w) for w in language.interrogatives])))
    linked = entities_in(asked, names)
    rank = F.row_number().over(Window.partitionBy("key").orderBy("at")) - 1
    ents = cut(linked.groupBy("key", "name").agg(F.min("at").alias("at")).withColumn("i", rank), "entities")
    count = ents.groupBy("key").agg(F.count("*").alias("n"))
    spots = cut(spotted(asked.join(count.select("key"), "key", "left_semi"), relations, language.copulas), "spots")

    # two entities or more
    many = asked.join(count.filter("n > 1").select("key"), "key", "left_semi")
    named = spots.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), "at", "relation")).alias("b")).select("key", F.col("b.relation").alias("relation"))
    rest = many.join(named.select("key"), "key", "left_anti")
    fuzzy = alike(rest.select("key", "ws"), relations)
    chosen = cut(named.unionByName(fuzzy.select("key", "relation")), "chosen")
    copula = F.get("ws", F.lit(0)).isin(*language.copulas)
    mark = many.select("key", F.when(copula, "YES. ").otherwise("").alias("yes"), F.arrays_overlap("ws", F.array(*[F.lit(w) for w in language.equality])).alias("equality"))
    a = ents.select("key", "i", F.col("name").alias("a"))
    b = ents.select("key", F.col("i").alias("j"), F.col("name").alias("b"))
    pairs = cut(mark.join(a, "key").join(b, "key").filter("i < j").join(chosen, "key", "left"), "pairs")
    both = pairs.filter("equality and i = 0 and j = 1")
    functional = [r["relation"] for r in properties.filter("property = 'functional'").select("relation").distinct().collect()]
    same = inference.check_same(facts, both.select("a", "b").distinct(), functional).filter("same is not null")
    equal = both.join(same, ["a", "b"]).select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("stage"), F.concat_ws(" ", "a", F.when(F.col("same"), "is the same as").otherwise("is not the same as"), "b").alias("answer"), F.col("confidence"), F.lit("same").alias("method"))
    fact = facts.select(F.col("subject").alias("a"), F.col("relation").alias("r"), F.col("object").alias("b"))
    stated = pairs.join(fact, ["a", "b"])
    direct = stated.filter("r = relation").select("key", "i", "j", F.lit(1).alias("stage"), F.concat(F.col("yes"), F.concat_ws(" ", "a", "r", "b"), F.lit(" (direct)")).alias("answer"), F.lit(0.95).alias("confidence"), F.lit("sparql_direct").alias("method"))
    any_ = stated.groupBy("key", "i", "j", "a", "b", "yes").agg(F.array_join(F.sort_array(F.collect_set("r")), "/").alias("r"))
    any_ = any_.select("key", "i", "j", F.lit(3).alias("stage"), F.concat("yes", "a", F.lit(" --"), "r", F.lit("--> "), "b").alias("answer"), F.lit(0.90).alias("confidence"), F.lit("sparql_any_relation").alias("method"))
    near = cut(reduce(DataFrame.unionByName, [equal, direct, any_]), "near")
    open_ = cut(pairs.join(near.select("key", "i", "j").distinct(), ["key", "i", "j"], "left_anti"), "open")
    alone = connected(open_.filter("relation is not null").select("key", "i", "j", "a", "b", F.col("relation").alias("only")), facts, 40)
    ends = pairs.select("key", "i", "j", "a", "b", "yes", "relation")
    by_one = alone.join(ends, ["key", "i", "j"]).select("key", "i", "j", F.lit(2).alias("stage"), F.concat("yes", "a", F.lit(" → ... → "), "b", F.lit(" via "), "relation", F.lit("+")).alias("answer"), F.lit(0.85).alias("confidence"), F.lit("sparql_transitive").alias("method"))
    by_one = cut(by_one, "by-one")
    left = open_.join(by_one.select("key", "i", "j"), ["key", "i", "j"], "left_anti")
    far = connected(left.select("key", "i", "j", "a", "b", F.lit(None).cast("string").alias("only")), facts, max_hops).join(ends, ["key", "i", "j"])
    two = F.concat("yes", "a", F.lit(" --"), F.get("rels", F.lit(0)), F.lit("--> "), F.get("nodes", F.lit(1)), F.lit(" --"), F.get("rels", F.lit(1)), F.lit("--> "), "b")
    more = F.concat("yes", "a", F.lit(" → ... → "), "b", F.lit(" ("), F.col("hops").cast("string"), F.lit("-hop: "), F.array_join("rels", " → "), F.lit(")"))
    chain = far.select("key", "i", "j", F.lit(4).alias("stage"), F.when(F.col("hops") == 2, two).otherwise(more).alias("answer"), F.when(F.col("hops") == 2, 0.80).otherwise(F.greatest(F.lit(0.5), 0.9 - 0.1 * F.col("hops"))).alias("confidence"), F.concat(F.lit("sparql_"), F.when(F.col("hops") == 2, "2hop").otherwise(F.concat(F.col("hops").cast("string"), F.lit("hop")))).alias("method"))
    pick = F.row_number().over(Window.partitionBy("key").orderBy(F.col("stage") != 0, "i", "j", "stage"))
    found_many = reduce(DataFrame.unionByName, [near, by_one, chain]).withColumn("_r", pick).filter("_r = 1").select("key", "answer", "confidence", "method")

    # one entity
    one = asked.join(count.filter("n = 1").select("key"), "key", "left_semi").join(ents.select("key", "name"), "key")
    options = one.select("key", "name").join(spots.groupBy("key", "relation").agg(F.max("score").alias("score"), F.min("at").alias("at")), "key")
    forward = options.join(facts.select(F.col("subject").alias("name"), "relation", "object"), ["name", "relation"]).groupBy("key", "name", "relation", "score", "at").agg(F.array_join(F.sort_array(F.collect_set("object")), ", ").alias("o"))
    forward = forward.select("key", "relation", "score", "at", F.concat("relation", F.lit("("), "name", F.lit(") → "), "o").alias("answer"), F.lit(0.85).alias("c"))
    backward = options.join(forward.select("key", "relation"), ["key", "relation"], "left_anti").join(facts.select(F.col("object").alias("name"), "relation", F.col("subject").alias("s")), ["name", "relation"]).groupBy("key", "name", "relation", "score", "at").agg(F.min("s").alias("s"))
    backward = backward.select("key", "relation", "score", "at", F.concat(F.lit("Direct fact: ("), "s", F.lit(", "), "relation", F.lit(", "), "name", F.lit(")")).alias("answer"), F.lit(0.95).alias("c"))
    best = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "at", "relation"))
    got = forward.unionByName(backward).withColumn("_r", best).filter("_r = 1")
    found_one = cut(got.select("key", "answer", (F.col("c") * (0.7 + 0.3 * F.col("score"))).alias("confidence"), F.when(F.col("score") < 1, "direct_sim").otherwise("direct").alias("method")), "one")
    rest = one.filter("interrogative").join(found_one.select("key"), "key", "left_anti").select("key", "name", F.lower("text").alias("low"))
    found_open = ranked(rest, facts)

    out = reduce(DataFrame.unionByName, [found_many, found_one, found_open])
    return asked.select("key").join(out, "key", "left").select("key", "answer", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("method", F.lit("unknown")).alias("method"))


def ranked(open_: DataFrame, facts: DataFrame) -> DataFrame:
    """(key, answer, confidence, method): for rows (key, name, low) the fact of name that ranks best: ln(all / those of its relation), 1 more where
    the relation stands in the text, half more where name is its subject; ties by direction, subject, relation, object."""
    total = facts.agg(F.count("*").alias("_n"))
    freq = facts.groupBy("relation").agg(F.count("*").alias("f")).join(F.broadcast(total), F.lit(True)).withColumn("idf", F.log(F.col("_n") / F.col("f"))).select("relation", "idf")
    out = facts.select(F.col("subject").alias("name"), "subject", "relation", "object", F.lit("forward").alias("way")).unionByName(facts.select(F.col("object").alias("name"), "subject", "relation", "object", F.lit("inverse").alias("way")))
    said = F.contains(F.col("low"), F.replace(F.col("relation"), F.lit("_"), F.lit(" ")))
    rows = open_.join(out, "name").join(freq, "relation").withColumn("score", F.col("idf") + F.when(said, 1.0).otherwise(0.0) + F.when(F.col("way") == "forward", 0.5).otherwise(0.0))
    top = rows.groupBy("key").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "way", "subject", "relation", "object")).alias("b"))
    return top.select("key", F.concat_ws(" ", "b.subject", "b.relation", "b.object").alias("answer"), F.lit(0.90).alias("confidence"), F.concat(F.lit("open_query_"), "b.way").alias("method"))


def contained(answers_: DataFrame, names: DataFrame) -> DataFrame:
    """(key, ok): whether all names that stand in a question (key, text) stand in what was retrieved for it (found) too."""
    a = entities_in(answers_.select("key", "text"), names).groupBy("key").agg(F.collect_set("name").alias("x"))
    b = entities_in(answers_.select("key", F.col("found").alias("text")), names).groupBy("key").agg(F.collect_set("name").alias("y"))
    none = F.array().cast("array<string>")
    got = answers_.select("key").join(a, "key", "left").join(b, "key", "left")
    return got.select("key", (F.size(F.array_except(F.coalesce("x", none), F.coalesce("y", none))) == 0).alias("ok"))
