"""The engine as a whole: a graph, word vectors and sense glosses that are taught by tables of sentences and asked by tables of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import extraction, guard, memory, wordvec
from lattica.plans import questions
from lattica.plans.rounds import cut
from lattica.sources import state
from lattica.store import Store

MODEL, GLOSS = "word string, freq long, ctx array<double>", "entity string, sense int, word string, cnt long"


class Engine:
    def __init__(self, spark: SparkSession, store: Store | None = None, model: DataFrame | None = None, examples: DataFrame | None = None, patterns: DataFrame | None = None, dim: int = 256):
        self.spark, self.dim = spark, dim
        self.store = store if store is not None else Store(spark)  # an empty store is false
        self.model = model if model is not None else spark.createDataFrame([], MODEL)
        self.examples = examples if examples is not None else spark.createDataFrame([], state.SENTENCES)
        self.patterns = patterns if patterns is not None else spark.createDataFrame([], memory.PATTERN)

    def but(self, **parts) -> Engine:
        have = {"store": self.store, "model": self.model, "examples": self.examples, "patterns": self.patterns}
        return Engine(self.spark, dim=self.dim, **(have | parts))

    def teach(self, sentences: DataFrame) -> Engine:
        """Sentences (seq, text, and answer where they are questions with one): their facts join the graph, each under the sense of its subject
        that its words speak for; the sentences train word vectors, and become examples of the senses they went to; text and answer
        become a pattern of memory. Senses are those that were there before."""
        rows = sentences.select(F.col("seq").alias("key"), "text")
        found = cut(extraction.facts_of(rows), "taught")
        senses = self.store.senses
        asked = found.join(senses.filter("idx > 0").select(F.col("surface").alias("subject")).distinct(), "subject").join(rows, "key")
        told = wordvec.resolve(asked.select(F.concat_ws("\x1f", F.col("key").cast("string"), "subject").alias("key"), F.col("subject").alias("entity"), "text", F.col("object").alias("obj")), self.glosses)
        told = told.select(F.split("key", "\x1f")[0].alias("k"), F.split("key", "\x1f")[1].alias("subject"), "sense").distinct()
        names = senses.select(F.col("surface").alias("subject"), F.col("idx").alias("sense"), F.col("sense").alias("name"))
        told = cut(told, "senses")
        placed = found.withColumn("k", F.col("key").cast("string")).join(told, ["k", "subject"], "left").withColumn("sense", F.coalesce("sense", F.lit(0))).join(names, ["subject", "sense"], "left")
        placed = cut(placed, "placed")
        facts = placed.select(F.coalesce("name", "subject").alias("subject"), "relation", "object", F.concat(F.lit("taught: "), "k").alias("proof"), F.lit("user").alias("source"))
        examples = placed.join(rows, "key").select(F.col("subject").alias("entity"), F.col("text").alias("sentence"), F.greatest("sense", F.lit(0)).alias("sense")).distinct()
        return self.but(store=self.store.add(facts), model=wordvec.merged(self.model, wordvec.train(sentences, self.dim)), examples=cut(self.examples.unionByName(examples).distinct(), "examples"))

    def teach_relation(self, relation: str, *properties: str) -> Engine:
        return self.but(store=self.store.set_property(relation, *properties))

    def split_sense(self, entity: str) -> tuple[Engine, str]:
        """One more sense of an entity; glosses follow from the examples, so nothing else needs rebuilding."""
        store, name = self.store.new_sense(entity)
        return self.but(store=store), name

    def diverging(self) -> DataFrame:
        """(entity, a, b): entities stated to be of two types, neither a kind of the other nor alike by name: candidates for new senses."""
        from lattica import schema
        from lattica.operators.decisions import type_matches

        is_a = self.store.facts.filter("relation = 'is_a'").select(F.col("subject").alias("entity"), F.col("object").alias("a"))
        pairs = is_a.join(is_a.withColumnRenamed("a", "b"), "entity").filter("a < b")
        kin = type_matches(pairs.select("a", "b").distinct(), schema.subsumption(self.spark)).filter("ok")
        return pairs.join(kin.select("a", "b"), ["a", "b"], "left_anti").select("entity", "a", "b")

    @property
    def glosses(self) -> DataFrame:
        return wordvec.glosses(self.examples.select("entity", "sense", F.col("sentence").alias("text")))

    def think(self, asked: DataFrame) -> DataFrame:
        """(key, answer, confidence, method) for questions (key, text): from the graph; else from memory (patterns whose key is alike by 0.7, or by 0.3
        where all names of the question stand in what was stored); else unknown, 0.15."""
        got = cut(questions.answers(asked, self.store.facts, self.store.properties), "answers")
        left = asked.join(got.filter("answer is null").select("key"), "key", "left_semi")
        vec = wordvec.encoded(left, self.model, self.dim).select(F.col("key").alias("id"), "vec")
        found = memory.retrieve(vec, self.patterns, 1, damped=False).select(F.col("id").alias("key"), "sim", F.col("domain").alias("found"))
        names = self.store.entities().select(F.col("entity").alias("name"))
        fits = questions.contained(left.join(found, "key").select("key", "text", "found"), names)
        ok = found.join(fits, "key").filter("sim >= 0.7 or ok").select("key", F.col("found").alias("m_answer"), F.col("sim").alias("m_sim"))
        out = got.join(ok, "key", "left")
        return out.select("key", F.coalesce("answer", "m_answer").alias("answer"), F.when(F.col("answer").isNotNull(), F.col("confidence")).otherwise(F.coalesce("m_sim", F.lit(0.15))).alias("confidence"), F.when(F.col("answer").isNotNull(), F.col("method")).when(F.col("m_answer").isNotNull(), "memory").otherwise("unknown").alias("method"))

    def remember(self, pairs: DataFrame) -> Engine:
        """Texts and answers (seq, text, answer) as patterns: what is asked like one of them and has no answer in the graph gets its answer."""
        vec = wordvec.encoded(pairs.select(F.col("seq").alias("key"), "text"), self.model, self.dim)
        rows = vec.join(pairs.select(F.col("seq").alias("key"), "answer"), "key").select(F.col("key").alias("seq"), F.col("vec").alias("key"), F.col("vec").alias("value"), F.col("answer").alias("domain"))
        return self.but(patterns=cut(memory.stored(self.patterns, rows), "patterns"))

    def stats(self) -> DataFrame:
        """One row: total, user, derived, entities, relations, words, patterns."""
        words = self.model.agg(F.count("*").alias("words"))
        patterns = self.patterns.agg(F.count("*").alias("patterns"))
        return self.store.stats().join(F.broadcast(words), F.lit(True)).join(F.broadcast(patterns), F.lit(True))

    def save(self, path: str) -> None:
        self.store.save(f"{path}/graph")
        state.save_tables({"words": self.model, "patterns": self.patterns}, path)
        state.save_sentences(self.examples, f"{path}/examples")

    @staticmethod
    def load(spark: SparkSession, path: str, dim: int = 256) -> Engine:
        t = state.load_tables(spark, path, {"words": MODEL, "patterns": memory.PATTERN})
        return Engine(spark, Store.load(spark, f"{path}/graph"), t["words"], state.load_sentences(spark, f"{path}/examples"), t["patterns"], dim)

    def warnings(self) -> DataFrame:
        return guard.warnings(self.store.facts)
