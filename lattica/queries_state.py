"""Registered queries of files, the engine as a whole, the type guard and streams, each with the SQL that gives the same rows."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from lattica import schema
from lattica.engine import Engine
from lattica.functions import intervals, text
from lattica.operators import decisions, guard, memory, temporal, wordvec
from lattica.plans import answer
from lattica.queries import EDGES, register, table
from lattica.queries_decisions import labelled
from lattica.queries_reasoning import num, said
from lattica.queries_store import FACTS, facts_of, here, store_of
from lattica.queries_words import DIM, MODEL, WD, marks, marks_sql, named_sql, remembered, turns
from lattica.sources import rdf, sqlite, state, triples
from lattica.store import Store
from lattica.streaming import ingest


@register(f"WITH {FACTS} SELECT s AS subject, r AS relation, o AS object, src AS source, CASE src WHEN 'user' THEN 1.0 ELSE 0.85 END::DOUBLE AS confidence FROM facts WHERE r = 'in'")
def sqlite_round_trip(spark, sf_dir):
    """A graph written to one SQLite file and read back in ranges of rows. The file must be where all tasks can open it."""
    folder = here(spark).removeprefix("file:")
    if "://" in folder:
        raise ValueError("SQLite files need a folder that is mounted, not a remote store")
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/graph-{uuid.uuid4().hex}.db"
    s = store_of(spark, sf_dir)
    s.but(facts=s.facts.filter("relation = 'in'")).save_sqlite(path)
    return Store.load_sqlite(spark, path).facts.select("subject", "relation", "object", "source", "confidence")


@register("SELECT * FROM (VALUES ('relation_properties', " + str(len(schema.TRANSITIVE) + len(schema.SYMMETRIC) + len(schema.FUNCTIONAL)) + "), ('composition_rules', " + str(len(schema.SELF_COMPOSED) + len(schema.CROSS_COMPOSED)) + "), ('triples', 0), ('gazetteer', 0), ('sense_inventory', 2)) t(name, n)")
def sqlite_tables(spark, sf_dir):
    folder = here(spark).removeprefix("file:")
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/graph.db"
    s, _ = Store(spark).new_sense("cell")
    s.save_sqlite(path)
    got = sqlite.read_graph(spark, path)
    return spark.createDataFrame([(n, df.count()) for n, df in got.items()], "name string, n long")


@register(f"SELECT lower(p_name) AS concept, {marks_sql(named_sql('lower(p_name)'))} AS vec FROM (SELECT DISTINCT p_name FROM part) UNION ALL SELECT 'steel', {marks_sql(named_sql(chr(39) + 'steel' + chr(39)))}")
def vocabulary_round_trip(spark, sf_dir):
    """Names as concepts, written as JSON, one more added after reading; the engine's own (_x) stay behind."""
    names = table(spark, sf_dir, "part").select(F.lower("p_name").alias("name")).union(spark.createDataFrame([("_seq_identity",)], "name string"))
    path = here(spark)
    state.save_vocabulary(state.vocabulary(names, DIM), path)
    got = state.added(state.load_vocabulary(spark, path, DIM), spark.createDataFrame([("steel",)], "name string"), DIM)
    return got.select("concept", marks(F.col("vec")).alias("vec"))


@register("WITH " + MODEL + " SELECT w AS word, " + marks_sql("m") + " AS mem FROM m")
def wordvec_round_trip(spark, sf_dir):
    path = here(spark)
    state.save_tables({"words": wordvec.train(turns(spark, sf_dir), WD)}, path)
    got = state.load_tables(spark, path, {"words": "word string, freq long, ctx array<double>", "none": "a int"})
    return wordvec.memories(got["words"], WD).select("word", marks(F.col("mem")).alias("mem"))


@register("SELECT count(*) AS patterns, count(*) AS active FROM embeddings")
def memory_round_trip(spark, sf_dir):
    path = here(spark)
    state.save_tables({"patterns": remembered(spark, sf_dir)[0]}, path)
    return memory.counts(state.load_tables(spark, path, {"patterns": memory.PATTERN})["patterns"])


@register("SELECT doc_id::VARCHAR AS entity, text AS sentence, (doc_id % 3)::INTEGER AS sense FROM documents WHERE text IS NOT NULL")
def sentences_round_trip(spark, sf_dir):
    """Taught sentences as JSON lines, with lines in between that are none."""
    path = here(spark)
    d = table(spark, sf_dir, "documents").filter("text is not null")
    state.save_sentences(d.select(F.col("doc_id").cast("string").alias("entity"), F.col("text").alias("sentence"), (F.col("doc_id") % 3).cast("int").alias("sense")), path)
    spark.createDataFrame([("{broken",), ('{"entity": 1}',), ("[]",)], "value string").coalesce(1).write.mode("append").text(path)
    got = state.load_sentences(spark, path)
    assert state.load_sentences(spark, path + "-none").count() == 0
    return got


@register("SELECT vec_id, true AS same FROM embeddings")
def router_round_trip(spark, sf_dir):
    path, rows = here(spark), labelled(spark, sf_dir).select("vec_id", "vec")
    r = decisions.Router(DIM)
    r.save(spark, path)
    again = decisions.Router(DIM, seed=99).load(spark, path)
    a = r.route(rows).select("vec_id", "domain", "task", F.round("routed", 9).alias("routed"))
    b = again.route(rows).select("vec_id", F.col("domain").alias("d"), F.col("task").alias("t"), F.round("routed", 9).alias("p"))
    return a.join(b, "vec_id").select("vec_id", ((F.col("domain") == F.col("d")) & (F.col("task") == F.col("t")) & (F.col("routed") == F.col("p"))).alias("same"))


@register("SELECT * FROM (VALUES ('a', 0.7::DOUBLE, 2), ('b', 0.5::DOUBLE, 0)) t(id, effectiveness, prototypes)")
def strategies_loaded(spark, sf_dir):
    path = here(spark)
    text_ = '[{"id": "a", "title": "A", "effectiveness": 0.7, "query_prototypes": ["x", "y"]}, {"id": "b", "title": "B", "tags": ["t"]}]'
    spark.createDataFrame([(text_,)], "value string").coalesce(1).write.text(path)
    got = state.load_strategies(spark, path)
    return got.select("id", "effectiveness", F.coalesce(F.size("query_prototypes"), F.lit(0)).cast("int").alias("p")).select("id", "effectiveness", F.greatest("p", F.lit(0)).alias("prototypes"))


@register("SELECT r_name AS domain, 'the ' || lower(n_name) || ' lies well in ' || lower(r_name) AS sentence FROM nation JOIN region ON n_regionkey = r_regionkey")
def corpus_generated(spark, sf_dir):
    """Enough draws that every filling of one template per region comes up."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    templates = r.select(F.col("r_name").alias("domain"), said("the {noun} lies well in ", F.lower("r_name")).alias("template")).union(spark.createDataFrame([("ASIA", "the {verb} of nothing at all")], "domain string, template string"))
    words = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("domain"), F.lit("noun").alias("slot"), F.lower("n_name").alias("word"))
    return state.generated(spark, templates, words, 5000)


@register("SELECT DISTINCT '<http://example.org/kg/relation/r' || p_partkey || '> <http://www.w3.org/2002/07/owl#equivalentProperty> <http://example.org/kg/relation/r' || (p_partkey - p_partkey % 8) || '> .' AS value FROM part WHERE p_partkey % 8 > 0")
def equivalent_properties(spark, sf_dir):
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("r"), c.cast("string"))
    return rdf.equivalent_properties(table(spark, sf_dir, "part").select(name(k).alias("relation"), name(k - k % 8).alias("canonical")))


# --- the engine


def taught(spark, sf_dir) -> Engine:
    """An engine taught one sentence per nation."""
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.select(F.col("n_nationkey").cast("long").alias("seq"), said(F.regexp_replace(F.initcap("n_name"), " ", ""), " is in ", F.regexp_replace(F.initcap("r_name"), " ", ""), ".").alias("text"))
    return Engine(spark, dim=WD).teach(rows).teach_relation("in", "transitive")


TAUGHT = "SELECT n_nationkey k, lower(replace(n_name, ' ', '')) s, lower(replace(r_name, ' ', '')) o FROM nation JOIN region ON n_regionkey = r_regionkey"


@register(f"SELECT s AS subject, 'in' AS relation, o AS object, 'taught: ' || k AS proof, 1.0::DOUBLE AS confidence FROM ({TAUGHT})")
def engine_teach(spark, sf_dir):
    return taught(spark, sf_dir).store.facts.select("subject", "relation", "object", "proof", "confidence")


@register(f"SELECT k AS key, CASE WHEN k % 2 = 0 THEN 'YES. ' || s || ' in ' || o || ' (direct)' END AS answer, CASE WHEN k % 2 = 0 THEN 0.95 ELSE 0.15 END::DOUBLE AS confidence, CASE WHEN k % 2 = 0 THEN 'sparql_direct' ELSE 'unknown' END AS method FROM ({TAUGHT})")
def engine_think(spark, sf_dir):
    e = taught(spark, sf_dir)
    f = e.store.facts.select("subject", "object", F.substring("proof", 9, 9).cast("int").alias("key"))
    asked = f.select("key", F.when(F.col("key") % 2 == 0, said("Is ", F.col("subject"), " in ", F.col("object"), "?")).otherwise("Which qqq zzz?").alias("text"))
    return e.think(asked)


@register(f"SELECT k AS key, 'stored ' || k AS answer, 'memory' AS method FROM ({TAUGHT})")
def engine_memory(spark, sf_dir):
    e = taught(spark, sf_dir)
    n = table(spark, sf_dir, "nation")
    rows = n.select(F.col("n_nationkey").cast("long").alias("seq"), said("what about topic", num("n_nationkey"), " qzx", num("n_nationkey")).alias("text"), said("stored ", num("n_nationkey")).alias("answer"))
    got = e.remember(rows).think(rows.select(F.col("seq").cast("int").alias("key"), "text"))
    return got.select("key", "answer", "method")


@register(f"SELECT count(*) AS total, count(*) AS \"user\", 0::BIGINT AS derived, 1::BIGINT AS relations, count(DISTINCT s) + count(DISTINCT o) AS entities, 0::BIGINT AS patterns FROM ({TAUGHT})")
def engine_save_load(spark, sf_dir):
    path = here(spark)
    taught(spark, sf_dir).save(path)
    return Engine.load(spark, path, WD).stats().drop("words")


@register("SELECT 'cell' AS surface, 'cell_1' AS sense, count(*) AS n FROM nation WHERE n_nationkey % 2 = 1 UNION ALL SELECT 'cell', 'cell', count(*) FROM nation WHERE n_nationkey % 2 = 0")
def engine_senses(spark, sf_dir):
    """A word with two senses: sentences go to the one whose examples they share words with."""
    ex = spark.createDataFrame([("cell", "the prison guard locked cell door", 0), ("cell", "the organism membrane nucleus cell", 1)], state.SENTENCES)
    store, _ = Store(spark).new_sense("cell")
    n = table(spark, sf_dir, "nation")
    rows = n.select(F.col("n_nationkey").cast("long").alias("seq"), F.when(F.col("n_nationkey") % 2 == 0, said("cell is in prison", num("n_nationkey"), " where guard locked")).otherwise(said("cell is in organism", num("n_nationkey"), " with membrane")).alias("text"))
    got = Engine(spark, store, examples=ex, dim=WD).teach(rows).store.facts
    return got.groupBy(text.surface_form(F.col("subject")).alias("surface"), F.col("subject").alias("sense")).agg(F.count("*").alias("n"))


@register("SELECT 'x' || c_custkey AS entity, 'city' AS a, 'person' AS b FROM customer WHERE c_custkey % 3 = 0")
def engine_diverging(spark, sf_dir):
    """Entities of two types; city and settlement agree."""
    c = table(spark, sf_dir, "customer").select(said("x", num("c_custkey")).alias("subject"), F.lit("is_a").alias("relation"), "c_custkey")
    rows = c.select("subject", "relation", F.lit("city").alias("object")).union(c.select("subject", "relation", F.when(F.col("c_custkey") % 3 == 0, "person").otherwise("settlement")))
    return Engine(spark, Store(spark).add(rows), dim=WD).diverging()


# --- the guard, proofs, and time


@register("SELECT 'x' || c_custkey AS entity, 'Contradiction for ''x' || c_custkey || ''': previously inferred as ''city'' (x' || c_custkey || ' capital_of y), now identified as ''country'' (x' || c_custkey || ' is_a country). These types are mutually exclusive.' AS text FROM customer")
def guard_warnings(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(said("x", num("c_custkey")).alias("subject"), "c_custkey")
    f = c.select("subject", F.lit("capital_of").alias("relation"), F.lit("y").alias("object"), (F.col("c_custkey") * 2).alias("seq")).union(c.select("subject", F.lit("is_a"), F.lit("country"), F.col("c_custkey") * 2 + 1))
    return guard.warnings(f).select("entity", "text")


@register("SELECT 'x' || c_custkey AS entity, 'city' AS type, 'x' || c_custkey || ' capital_of y' || c_custkey AS proof FROM customer UNION ALL SELECT 'y' || c_custkey, 'country', 'x' || c_custkey || ' capital_of y' || c_custkey FROM customer")
def guard_proofs(spark, sf_dir):
    f = table(spark, sf_dir, "customer").select(said("x", num("c_custkey")).alias("subject"), F.lit("capital_of").alias("relation"), said("y", num("c_custkey")).alias("object"), F.col("c_custkey").alias("seq"))
    return guard.type_proofs(f)


@register("SELECT 'x' || c_custkey AS entity, 'city,place' AS types FROM customer")
def guard_types(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(said("x", num("c_custkey")).alias("subject"), "c_custkey")
    f = c.select("subject", F.lit("is_a").alias("relation"), F.explode(F.array(F.lit("place"), F.lit("city"))).alias("object"), F.col("c_custkey").alias("seq"))
    return guard.types_of(f).select("entity", F.array_join("types", ",").alias("types"))


@register("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b in intervals.STATED for c in intervals.STATED[a, b]) + ") t(first, second, result)")
def allen_stated(spark, sf_dir):
    return intervals.stated_composition(spark)


@register("SELECT 'n' || a AS a, 'before' AS relation, 'n' || c AS c FROM (SELECT n_nationkey a, n_nationkey + 2 c FROM nation WHERE n_nationkey <= 22) UNION ALL SELECT 'n' || c, 'after', 'n' || a FROM (SELECT n_nationkey a, n_nationkey + 2 c FROM nation WHERE n_nationkey <= 22)")
def temporal_derive_checked(spark, sf_dir):
    k = F.col("n_nationkey")
    f = table(spark, sf_dir, "nation").filter(k < 24).select(said("n", num("n_nationkey")).alias("subject"), F.lit("before").alias("relation"), said("n", (k + 1).cast("string")).alias("object"), (1000 + k * 10).cast("int").alias("t_start"), (1005 + k * 10).cast("int").alias("t_end"), k.cast("long").alias("seq"))
    last = spark.createDataFrame([("n24", "before", "n25", 1240, 1245, 24)], f.schema)
    got = temporal.derive_checked(f.unionByName(last), intervals.stated_composition(spark))
    return got.filter("a <> 'n25' and c <> 'n25'").select("a", "relation", "c")


@register(f"WITH {EDGES} SELECT 'order:' || o_orderkey AS subject, 'in' AS relation, 'nation:' || c_nationkey AS object FROM orders JOIN customer ON o_custkey = c_custkey")
def stream_rederive(spark, sf_dir):
    """Facts arrive in two batches; what the second adds by one rule is derived from it alone."""
    base = here(spark)
    e = facts_of(spark, sf_dir).withColumns({"proof": F.lit(""), "confidence": F.lit(1.0), "t_start": F.lit(None).cast("int"), "t_end": F.lit(None).cast("int"), "seq": F.lit(1).cast("long")})
    cols = ["subject", "relation", "object", "source", "proof", "confidence", "t_start", "t_end", "seq"]
    b = ingest.Buckets(spark, f"{base}/kg", spark.createDataFrame([], schema.TRIPLE).schema, 8)
    rules = spark.createDataFrame([("placed_by", "in", "in")], "rel1 string, rel2 string, target string")
    derive = ingest.rederived(b, rules, f"{base}/derived")
    first = e.filter("relation = 'in' and subject like 'customer:%'").select(*cols)
    second = e.filter("relation = 'placed_by'").select(*cols)
    for n, batch in enumerate((first, second)):
        b.merge(batch, n)
        derive(batch, n)
    return spark.read.parquet(f"{base}/derived/1")


@register(f"WITH {EDGES} SELECT s AS subject, r AS relation, o AS object FROM edges WHERE r IN ('in', 'placed_by')")
def stream_upsert(spark, sf_dir):
    """Every fact twice, in three batches of buckets."""
    base = here(spark)
    e = facts_of(spark, sf_dir).filter("relation in ('in', 'placed_by')").withColumns({"proof": F.lit(""), "confidence": F.lit(1.0), "t_start": F.lit(None).cast("int"), "t_end": F.lit(None).cast("int"), "seq": F.lit(1).cast("long")})
    e = e.select("subject", "relation", "object", "source", "proof", "confidence", "t_start", "t_end", "seq")
    b = ingest.Buckets(spark, f"{base}/kg", spark.createDataFrame([], schema.TRIPLE).schema, 8)
    for n, batch in enumerate((e.filter("relation = 'in'"), e, e.filter("relation = 'placed_by'"))):
        b.merge(batch, n)
    return b.latest(2).select("subject", "relation", "object")


# --- answers over several facts


@register("SELECT 'order:' || o_orderkey AS subject, 'nation:' || c_nationkey AS answer, 2::INTEGER AS hops FROM orders JOIN customer ON o_custkey = c_custkey")
def open_multi_hop(spark, sf_dir):
    e = triples.star_edges(spark, sf_dir)
    asked = table(spark, sf_dir, "orders").select(said("order:", num("o_orderkey")).alias("subject"), F.lit("in").alias("relation"))
    return answer.open_multi_hop(e, asked).select("subject", "answer", "hops")


@register(f"WITH {EDGES} SELECT DISTINCT r AS relation, r IN ('in', 'placed_by') AS functional FROM edges")
def detected_properties(spark, sf_dir):
    """Of relations without registered properties, what the facts show; `in` is registered, so it keeps what it has."""
    s = store_of(spark, sf_dir)
    got = s.detected()
    f = got.properties.filter("property = 'functional'").select("relation").withColumn("f", F.lit(True))
    both = s.relations().join(f, "relation", "left")
    return both.select("relation", (F.coalesce("f", F.lit(False)) | (F.col("relation") == "in")).alias("functional"))


@register(f"WITH {EDGES} SELECT count(*) AS n FROM (SELECT DISTINCT a.s, b.o FROM edges a JOIN edges b ON a.o = b.s AND b.r = 'in' WHERE a.r = 'in')")
def store_derived(spark, sf_dir):
    return store_of(spark, sf_dir).derived().facts.filter("source = 'derived' and relation = 'in'").agg(F.count("*").alias("n"))
