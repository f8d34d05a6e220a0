"""One graph as a set of tables, and all that can be asked of it: the API over the operators.

Facts are one wide table (schema.TRIPLE): a fact's source, proof, confidence and years stand in its row, so that looking up a
fact's metadata is a filter. Every change gives a new Store; nothing is written before save.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica import schema
from lattica.operators import graph, guard, inference
from lattica.plans import patterns
from lattica.plans.rounds import cut
from lattica.sources import rdf, sqlite, triples


def confidence():
    return F.when(F.col("source") == "user", 1.0).otherwise(0.85)


class Store:
    def __init__(self, spark: SparkSession, facts: DataFrame | None = None, properties: DataFrame | None = None, rules: DataFrame | None = None, senses: DataFrame | None = None):
        self.spark = spark
        self.facts = facts if facts is not None else spark.createDataFrame([], schema.TRIPLE)
        self.properties = properties if properties is not None else schema.properties(spark)
        self.rules = rules if rules is not None else schema.rules(spark)
        self.senses = senses if senses is not None else spark.createDataFrame([], "surface string, sense string, idx int")

    def but(self, **tables) -> Store:
        have = {"facts": self.facts, "properties": self.properties, "rules": self.rules, "senses": self.senses}
        return Store(self.spark, **(have | tables))

    # changes

    def add(self, new: DataFrame, source: str = "user") -> Store:
        """Upsert rows (subject, relation, object and any of source, proof, confidence, t_start, t_end, seq). Rows without seq come
        after all that is there, in no order among themselves."""
        rows = new
        for name, value in (("source", F.lit(source)), ("proof", F.lit("")), ("t_start", F.lit(None).cast("int")), ("t_end", F.lit(None).cast("int"))):
            if name not in rows.columns:
                rows = rows.withColumn(name, value)
        if "confidence" not in rows.columns:
            rows = rows.withColumn("confidence", confidence())
        if "seq" not in rows.columns:
            top = self.facts.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
            rows = rows.withColumn("seq", F.monotonically_increasing_id() + F.lit(top + 1))
        names = [f.name for f in self.facts.schema]
        rows = rows.select(*[F.col(n).cast(self.facts.schema[n].dataType) for n in names])
        rows = rows.filter("length(trim(subject)) > 0 and length(trim(relation)) > 0 and length(trim(object)) > 0")
        return self.but(facts=triples.upsert(self.facts, rows).select(*names))

    def add_fact(self, subject: str, relation: str, obj: str, source: str = "user", proof: str = "", sure: float | None = None, t_start: int | None = None, t_end: int | None = None) -> Store:
        row = self.spark.createDataFrame([(subject, relation, obj, source, proof, t_start, t_end)], "subject string, relation string, object string, source string, proof string, t_start int, t_end int")
        return self.add(row if sure is None else row.withColumn("confidence", F.lit(float(sure))), source)

    def remove(self, gone: DataFrame) -> Store:
        """Without the facts (subject, relation, object) of gone, whatever their source."""
        return self.but(facts=triples.remove(self.facts, triples.normalized(gone)))

    def clear(self) -> Store:
        return self.but(facts=self.facts.limit(0))

    def synced(self) -> Store:
        """The facts with the confidences that their sources stand for: user 1.0, others 0.85."""
        return self.but(facts=self.facts.withColumn("confidence", confidence()))

    def set_property(self, relation: str, *names: str) -> Store:
        """Add properties; inverse:x also makes relation the inverse of x, transitive also adds the rule relation relation -> relation."""
        r, rows, rule = relation.strip().lower(), [], []
        for n in names:
            rows.append((r, n))
            if n.startswith("inverse:"):
                rows.append((n[8:], f"inverse:{r}"))
            if n == "transitive":
                rule.append((r, r, r))
        new = self.spark.createDataFrame(rows, "relation string, property string")
        out = self.but(properties=self.properties.union(new).distinct())
        return out.with_rules(rule) if rule else out

    def set_rule(self, first: str, second: str, target: str | None) -> Store:
        """first then second gives target; None blocks the pair."""
        return self.with_rules([(first, second, target)])

    def with_rules(self, rules: list[tuple]) -> Store:
        new = self.spark.createDataFrame(rules, "rel1 string, rel2 string, target string")
        return self.but(rules=self.rules.join(new, ["rel1", "rel2"], "left_anti").union(new))

    def new_sense(self, surface: str) -> tuple[Store, str]:
        """One more sense of a surface form: the first two are itself and itself with _1."""
        s = surface.strip().lower()
        n = self.senses.filter(F.col("surface") == s).count()
        rows = [(s, s, 0)] * (n == 0) + [(s, f"{s}_{max(n, 1)}", max(n, 1))]
        return self.but(senses=self.senses.union(self.spark.createDataFrame(rows, self.senses.schema))), rows[-1][1]

    def senses_of(self, surface: str) -> DataFrame:
        return self.senses.filter(F.col("surface") == surface.strip().lower()).select("idx", "sense")

    # derivation

    def derived(self) -> Store:
        """With all that rules and transitive relations give, as facts of source derived."""
        made = inference.derive_all(self.facts, self.rules, self.properties).filter("source = 'derived'")
        return self.add(cut(made.select("subject", "relation", "object", "source"), "derived"), "derived")

    def detected(self, min_evidence: int = 3, share: float = 0.8) -> Store:
        """With the properties that the facts of relations without any registered one show."""
        open_ = self.facts.join(self.properties.select("relation").distinct(), "relation", "left_anti")
        found = inference.detect_properties(open_, min_evidence, share)
        rows = found.select("relation", F.explode(F.array(*[F.when(F.col(p), p) for p in ("transitive", "symmetric", "functional")])).alias("property")).filter("property is not null")
        rows = cut(rows, "detected")
        rule = rows.filter("property = 'transitive'").select(F.col("relation").alias("rel1"), F.col("relation").alias("rel2"), F.col("relation").alias("target"))
        return self.but(properties=self.properties.union(rows).distinct(), rules=self.rules.join(rule, ["rel1", "rel2"], "left_anti").union(rule))

    def conflicts(self) -> DataFrame:
        return guard.contradictions(self.facts)

    # lookups

    def by_source(self, source: str) -> DataFrame:
        return self.facts.filter(F.col("source") == source).select("subject", "relation", "object")

    def metadata(self, keys: DataFrame) -> DataFrame:
        """(subject, relation, object, source, proof, confidence, t_start, t_end) of the facts asked for; unknown ones give no row."""
        return self.facts.join(triples.normalized(keys), ["subject", "relation", "object"], "left_semi").drop("seq")

    def properties_of(self, relation: str) -> DataFrame:
        return self.properties.filter(F.col("relation") == relation).select("property")

    def all_properties(self) -> DataFrame:
        return self.properties.groupBy("relation").agg(F.sort_array(F.collect_set("property")).alias("properties"))

    def inverses(self) -> DataFrame:
        """(relation, inverse): taught pairs, else the built-in one-way names."""
        taught = self.properties.filter("property like 'inverse:%'").select("relation", F.expr("substring(property, 9)").alias("inverse"))
        named = self.spark.createDataFrame(list(schema.INVERSES.items()), "relation string, inverse string")
        return taught.union(named.join(taught.select("relation"), "relation", "left_anti"))

    def inverse_of(self, relation: str) -> str | None:
        row = self.properties.filter((F.col("relation") == relation) & F.col("property").startswith("inverse:")).select(F.expr("substring(property, 9)").alias("i")).orderBy("i").first()
        return row["i"] if row else None

    def is_functional(self, relation: str) -> bool:
        return bool(self.properties.filter((F.col("relation") == relation) & (F.col("property") == "functional")).limit(1).count())

    def all_rules(self) -> DataFrame:
        return self.rules.select("rel1", "rel2", "target")

    def facts_for_relation(self, relation: str) -> DataFrame:
        return graph.facts_for_relation(self.facts, relation)

    def relations(self) -> DataFrame:
        return graph.relations(self.facts)

    def entities(self) -> DataFrame:
        return graph.entities(self.facts)

    # counts

    def stats(self) -> DataFrame:
        """One row: total, user, derived, entities, relations."""
        f = self.facts
        counts = f.agg(F.count("*").alias("total"), F.count_if(F.col("source") == "user").alias("user"), F.count_if(F.col("source") == "derived").alias("derived"), F.countDistinct("relation").alias("relations"))
        return counts.join(F.broadcast(graph.entities(f).agg(F.count("*").alias("entities"))), F.lit(True))

    def source_counts(self) -> DataFrame:
        return self.facts.groupBy("source").agg(F.count("*").alias("n"))

    def count(self) -> int:
        return self.facts.select("subject", "relation", "object").distinct().count()

    def __len__(self) -> int:
        return self.facts.count()

    # languages

    def sparql(self, query: str) -> DataFrame:
        return patterns.run(self.facts, query)

    def sql(self, query: str, params: Sequence | None = None) -> DataFrame:
        """SQL over triples, relation_properties, composition_rules and senses; ? takes the parameters in turn."""
        for name, df in (("triples", self.facts), ("relation_properties", self.properties), ("composition_rules", self.rules), ("senses", self.senses)):
            df.createOrReplaceTempView(name)
        return self.spark.sql(query, args=list(params) if params else None)

    # files

    def save(self, path: str) -> None:
        triples.save({"triples": self.facts, "relation_properties": self.properties, "composition_rules": self.rules, "senses": self.senses}, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Store:
        names = [f.name for f in Store(spark).facts.schema]
        t = triples.load(spark, path, ("triples", "relation_properties", "composition_rules", "senses"))
        return Store(spark, t["triples"].select(*names), t["relation_properties"], t["composition_rules"], t["senses"])

    def save_sqlite(self, path: str) -> None:
        senses = self.senses.select(F.col("surface").alias("surface_form"), F.col("sense").alias("sense_uri"), F.col("idx").alias("sense_index"))
        sqlite.write_graph({"triples": self.facts, "relation_properties": self.properties, "composition_rules": self.rules, "gazetteer": triples.gazetteer(self.facts).withColumnRenamed("name", "entity"), "sense_inventory": senses}, path)

    @staticmethod
    def load_sqlite(spark: SparkSession, path: str) -> Store:
        t = sqlite.read_graph(spark, path)
        senses = t["sense_inventory"].select(F.col("surface_form").alias("surface"), F.col("sense_uri").alias("sense"), F.col("sense_index").alias("idx"))
        return Store(spark, t["triples"], t["relation_properties"], t["composition_rules"], senses)

    def export_turtle(self, path: str, source: str | None = None) -> None:
        rdf.write_turtle(self.facts, path, source)

    def export_nquads(self, path: str) -> None:
        rdf.to_nquads(self.facts).write.mode("overwrite").text(path)

    def import_turtle(self, path: str, source: str = "user") -> Store:
        return self.add(rdf.read_turtle(self.spark, path), source)

    def nodes_and_edges(self) -> tuple[DataFrame, DataFrame]:
        """For drawing: (id, derived: whether the first fact that names it is derived), (source, target, label)."""
        ends = self.facts.select(F.explode(F.array("subject", "object")).alias("id"), "seq", (F.col("source") == "derived").alias("derived"))
        nodes = ends.groupBy("id").agg(F.min_by("derived", F.struct("seq", "derived")).alias("derived"))
        return nodes, self.facts.select(F.col("subject").alias("source"), F.col("object").alias("target"), F.col("relation").alias("label"))
