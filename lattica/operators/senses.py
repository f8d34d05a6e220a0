"""Co-occurrence counts, word senses by gloss overlap, relation synonyms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import content_words, tokenize


def words_of(docs: DataFrame, key: str, text: str, stop: tuple) -> DataFrame:
    """(key, word): content words, one row per occurrence."""
    return docs.select(key, F.explode(content_words(tokenize(F.col(text)), stop)).alias("word"))


def cooccurrence(sentences: DataFrame, key: str, text: str, stop: tuple, window: int = 5) -> DataFrame:
    """(word, near, n): ordered pairs of content words at most window apart, per occurrence. Pairs come from each sentence's
    own array, so a sentence of n words gives 2 * window * n pairs, not n squared."""
    ws = sentences.select(content_words(tokenize(F.col(text)), stop).alias("ws"))
    at = ws.select("ws", F.posexplode("ws").alias("i", "word"))
    near = at.select("word", "i", F.explode(F.expr(f"sequence(greatest(0, i - {window}), least(size(ws) - 1, i + {window}))")).alias("j"), "ws")
    return near.filter("i <> j").select("word", F.expr("ws[j]").alias("near")).groupBy("word", "near").agg(F.count("*").alias("n"))


def gloss_overlap(contexts: DataFrame, glosses: DataFrame) -> DataFrame:
    """(key, sense, score): the best sense of each context (key, word) by the summed counts of shared gloss words
    (sense, word, cnt); ties go to the smaller sense."""
    scored = contexts.join(glosses, "word").groupBy("key", "sense").agg(F.sum("cnt").alias("score"))
    best = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "sense"))
    return scored.withColumn("_r", best).filter("_r = 1").drop("_r")


def best_per_canonical(triples: DataFrame) -> DataFrame:
    """Of the rows (subject, relation, object, seq) with equal normalised ends and canonical relation the most specific, the first on ties."""
    from lattica.functions.text import canonical_relation, entity_name, specificity

    keyed = triples.withColumns({"_s": entity_name(F.col("subject")), "_c": canonical_relation(F.col("relation")), "_o": entity_name(F.col("object"))})
    w = Window.partitionBy("_s", "_c", "_o").orderBy(F.desc(specificity(F.col("relation"))), "seq")
    return keyed.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_s", "_c", "_o")


def synonym_groups(taught: DataFrame) -> DataFrame:
    """(relation, canonical): taught rows (seq, canonical, synonym) merged into groups; the canonical of a group is that of its last row.

    Groups are connected components by least-label rounds; each is an aggregate and two joins on relation names.
    """
    from lattica.plans.rounds import cut

    e = taught.select(F.col("canonical").alias("a"), F.col("synonym").alias("b"))
    e = cut(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "synonyms")
    label = cut(e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("g")), "groups")
    while True:
        near = e.join(label.select(F.col("a").alias("b"), "g"), "b").groupBy("a").agg(F.min("g").alias("m"))
        new = cut(label.join(near, "a").select("a", F.least("g", "m").alias("g"), (F.col("m") < F.col("g")).alias("moved")), "groups")
        label = new.select("a", "g")
        if not new.filter("moved").limit(1).count():
            break
    last = taught.join(label.select(F.col("a").alias("canonical"), "g"), "canonical").groupBy("g").agg(F.max_by("canonical", "seq").alias("canonical"))
    return label.join(last, "g").select(F.col("a").alias("relation"), "canonical")
