"""Registered queries of the store, its languages and its files, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lattica import schema
from lattica.operators import graph, inference
from lattica.plans import answer, patterns
from lattica.plans.rounds import shared_dir
from lattica.queries import EDGES, register, table
from lattica.sources import rdf, triples
from lattica.store import Store

FACTS = EDGES + ", facts AS (SELECT s, r, o, CASE r WHEN 'in' THEN 'user' WHEN 'placed_by' THEN 'bulk' ELSE 'derived' END AS src, row_number() OVER () AS seq FROM edges)"


def facts_of(spark, sf_dir):
    """The star graph with a source per relation."""
    source = F.when(F.col("relation") == "in", "user").when(F.col("relation") == "placed_by", "bulk").otherwise("derived")
    return triples.star_edges(spark, sf_dir).withColumn("source", source)


def store_of(spark, sf_dir) -> Store:
    rows = facts_of(spark, sf_dir).withColumns({"proof": F.concat_ws(" ", F.lit("from"), "source"), "confidence": F.when(F.col("source") == "user", 1.0).otherwise(0.85), "t_start": F.lit(None).cast("int"), "t_end": F.lit(None).cast("int"), "seq": F.monotonically_increasing_id()})
    return Store(spark, rows.select("subject", "relation", "object", "source", "proof", "confidence", "t_start", "t_end", "seq"))


def here(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


# --- SPARQL forms


def sparql(name: str, query: str, sql: str):
    """Register a query text over the star graph."""

    def run(spark, sf_dir):
        return patterns.run(facts_of(spark, sf_dir), query)

    run.__name__ = name
    register(sql)(run)


REL = "http://example.org/kg/relation/"
sparql("sparql_not_exists", "SELECT ?c WHERE { ?c in ?n . FILTER NOT EXISTS { ?o placed_by ?c } }", f"WITH {EDGES} SELECT s AS c FROM edges a WHERE r = 'in' AND NOT EXISTS (SELECT 1 FROM edges b WHERE b.r = 'placed_by' AND b.o = a.s)")
sparql("sparql_exists", "SELECT ?c ?n WHERE { ?c in ?n . FILTER EXISTS { ?o placed_by ?c } }", f"WITH {EDGES} SELECT s AS c, o AS n FROM edges a WHERE r = 'in' AND EXISTS (SELECT 1 FROM edges b WHERE b.r = 'placed_by' AND b.o = a.s)")
sparql("sparql_minus", "SELECT ?c WHERE { ?c in ?n MINUS { ?o placed_by ?c } }", f"WITH {EDGES} SELECT s AS c FROM edges a WHERE r = 'in' AND s NOT IN (SELECT o FROM edges WHERE r = 'placed_by')")
sparql("sparql_graph", "SELECT ?s ?o WHERE { GRAPH <http://example.org/kg/source/user> { ?s ?p ?o } }", f"WITH {FACTS} SELECT s, o FROM facts WHERE src = 'user'")
sparql("sparql_graph_variable", "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g", f"WITH {FACTS} SELECT src AS g, count(*) AS n FROM facts GROUP BY src")
sparql("sparql_semicolon", "SELECT ?p ?s ?n WHERE { ?p supplied_by ?s . ?s in ?n ; ^supplied_by ?q . FILTER(?q = ?p) }", f"WITH {EDGES} SELECT a.s AS p, a.o AS s, b.o AS n FROM edges a JOIN edges b ON b.s = a.o AND b.r = 'in' WHERE a.r = 'supplied_by'")
sparql("sparql_strstarts", f'SELECT DISTINCT ?p WHERE {{ ?s ?p ?o . FILTER(STRSTARTS(STR(?p), "{REL}")) }}', f"WITH {EDGES} SELECT DISTINCT r AS p FROM edges")
sparql("sparql_entities", 'SELECT DISTINCT ?e WHERE { { ?e ?p ?o } UNION { ?s ?p ?e } . FILTER(STRSTARTS(STR(?e), "http://example.org/kg/entity/")) }', f"WITH {EDGES} SELECT s AS e FROM edges UNION SELECT o FROM edges")
sparql("sparql_three_unions", "SELECT ?x WHERE { { ?x in nation:7 } UNION { ?x placed_by customer:3 } UNION { ?x supplied_by supplier:2 } }", f"WITH {EDGES} SELECT s AS x FROM edges WHERE (r = 'in' AND o = 'nation:7') OR (r = 'placed_by' AND o = 'customer:3') OR (r = 'supplied_by' AND o = 'supplier:2')")
sparql("sparql_functions", 'SELECT ?s (UCASE(?s) AS ?u) (STRLEN(?s) AS ?n) WHERE { ?s in ?o . FILTER(CONTAINS(?s, ":1") && REGEX(?o, "^nation:[0-9]$") || STRENDS(?s, "99")) }', f"WITH {EDGES} SELECT s, upper(s) AS u, length(s)::INTEGER AS n FROM edges WHERE r = 'in' AND ((contains(s, ':1') AND regexp_matches(o, '^nation:[0-9]$')) OR s LIKE '%99')")
sparql("sparql_group_having", "SELECT ?n (COUNT(DISTINCT ?x) AS ?k) WHERE { ?x in ?n } GROUP BY ?n HAVING (COUNT(DISTINCT ?x) > 5) ORDER BY DESC(?k) ?n", f"WITH {EDGES} SELECT o AS n, count(DISTINCT s) AS k FROM edges WHERE r = 'in' GROUP BY o HAVING count(DISTINCT s) > 5")
sparql("sparql_order_limit", "SELECT ?s ?o WHERE { ?s in ?o } ORDER BY DESC(?o) ?s LIMIT 7 OFFSET 2", f"WITH {EDGES} SELECT s, o FROM edges WHERE r = 'in' ORDER BY o DESC, s LIMIT 7 OFFSET 2")
sparql("sparql_bind_values", "SELECT ?c ?n ?t WHERE { VALUES ?n { nation:1 nation:2 } ?c in ?n . BIND(CONCAT(?c, '@', ?n) AS ?t) }", f"WITH {EDGES} SELECT s AS c, o AS n, s || '@' || o AS t FROM edges WHERE r = 'in' AND o IN ('nation:1', 'nation:2')")
sparql("sparql_path_sequence", "SELECT ?o ?r WHERE { ?o placed_by/in/in ?r }", f"WITH {EDGES} SELECT a.s AS o, c.o AS r FROM edges a JOIN edges b ON b.s = a.o AND b.r = 'in' JOIN edges c ON c.s = b.o AND c.r = 'in' WHERE a.r = 'placed_by'")
sparql("sparql_path_alternative_inverse", "SELECT ?x ?y WHERE { ?x (placed_by|^supplied_by) ?y }", f"WITH {EDGES} SELECT s AS x, o AS y FROM edges WHERE r = 'placed_by' UNION ALL SELECT o, s FROM edges WHERE r = 'supplied_by'")
sparql("sparql_path_star", "SELECT ?x WHERE { customer:1 in* ?x }", f"WITH RECURSIVE {EDGES}, c(o) AS (SELECT 'customer:1' UNION SELECT e.o FROM c JOIN edges e ON e.s = c.o AND e.r = 'in') SELECT o AS x FROM c")
sparql("sparql_subselect", "SELECT ?n ?k WHERE { ?n in region:1 . { SELECT ?n (COUNT(*) AS ?k) WHERE { ?x in ?n } GROUP BY ?n } }", f"WITH {EDGES} SELECT a.s AS n, count(*) AS k FROM edges a JOIN edges b ON b.o = a.s AND b.r = 'in' WHERE a.r = 'in' AND a.o = 'region:1' GROUP BY a.s")
sparql("sparql_optional_filter", "SELECT ?c ?n WHERE { ?o placed_by ?c . OPTIONAL { ?c in ?n . FILTER(?n != nation:3) } }", f"WITH {EDGES} SELECT a.o AS c, b.o AS n FROM edges a LEFT JOIN edges b ON b.s = a.o AND b.r = 'in' AND b.o <> 'nation:3' WHERE a.r = 'placed_by'")
sparql("sparql_ask", "ASK { customer:1 in+ ?r . ?r in region:0 }", f"WITH {EDGES} SELECT count(*) > 0 AS found FROM edges a JOIN edges b ON b.s = a.o AND b.r = 'in' WHERE a.s = 'customer:1' AND a.r = 'in' AND b.o = 'region:0'")
sparql("sparql_construct", "CONSTRUCT { ?r has ?n . ?n has ?c } WHERE { ?c in ?n . ?n in ?r }", f"WITH {EDGES}, j AS (SELECT a.s c, a.o n, b.o r FROM edges a JOIN edges b ON b.s = a.o AND b.r = 'in' WHERE a.r = 'in') SELECT r AS subject, 'has' AS relation, n AS object FROM j UNION SELECT n, 'has', c FROM j")


# --- facts, metadata, rules


@register(f"WITH {FACTS} SELECT s AS subject, r AS relation, o AS object FROM facts WHERE src = 'bulk'")
def store_by_source(spark, sf_dir):
    return store_of(spark, sf_dir).by_source("bulk")


@register(f"WITH {FACTS} SELECT f.s AS subject, f.r AS relation, f.o AS object, src AS source, 'from ' || src AS proof, 1.0::DOUBLE AS confidence, NULL::INTEGER AS t_start, NULL::INTEGER AS t_end FROM facts f JOIN customer ON f.s = 'customer:' || c_custkey AND f.r = 'in' AND f.o = 'nation:' || c_nationkey")
def store_metadata(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    keys = c.select(F.concat(F.lit(" Customer:"), F.col("c_custkey").cast("string")).alias("subject"), F.lit("in").alias("relation"), F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("object"))
    return store_of(spark, sf_dir).metadata(keys)


@register(f"WITH {FACTS} SELECT s AS subject, r AS relation, o AS object, src AS source, CASE src WHEN 'user' THEN 1.0 ELSE 0.85 END::DOUBLE AS confidence FROM facts")
def store_synced(spark, sf_dir):
    s = store_of(spark, sf_dir)
    return s.but(facts=s.facts.withColumn("confidence", F.lit(0.1))).synced().facts.select("subject", "relation", "object", "source", "confidence")


@register(f"WITH {FACTS} SELECT count(*) AS total, count(*) FILTER (src = 'user') AS \"user\", count(*) FILTER (src = 'derived') AS derived, count(DISTINCT r) AS relations, (SELECT count(*) FROM (SELECT s FROM edges UNION SELECT o FROM edges)) AS entities FROM facts")
def store_stats(spark, sf_dir):
    return store_of(spark, sf_dir).stats()


@register(f"WITH {FACTS} SELECT src AS source, count(*) AS n FROM facts GROUP BY src")
def store_source_counts(spark, sf_dir):
    return store_of(spark, sf_dir).source_counts()


@register(f"WITH {EDGES} SELECT s AS subject, r AS relation, o AS object FROM edges WHERE NOT (r = 'in' AND s LIKE 'customer:%')")
def store_remove(spark, sf_dir):
    s = store_of(spark, sf_dir)
    gone = s.facts.filter("relation = 'in' and subject like 'customer:%'").select(F.upper("subject").alias("subject"), "relation", "object")
    return s.remove(gone).facts.select("subject", "relation", "object")


@register(f"WITH {EDGES} SELECT 0::BIGINT AS left_over, (SELECT count(*) FROM edges) AS before")
def store_clear(spark, sf_dir):
    s = store_of(spark, sf_dir)
    return spark.createDataFrame([(len(s.clear()), len(s))], "left_over long, before long")


@register("SELECT relation, string_agg(property, ',' ORDER BY property) AS properties FROM (VALUES " + ", ".join(f"('{r}', '{p}')" for p, rs in (("transitive", schema.TRANSITIVE), ("symmetric", schema.SYMMETRIC), ("functional", schema.FUNCTIONAL)) for r in rs) + ", ('made_in', 'inverse:makes'), ('makes', 'inverse:made_in'), ('made_in', 'transitive')) t(relation, property) GROUP BY relation")
def store_properties(spark, sf_dir):
    s = Store(spark).set_property(" Made_in", "inverse:makes", "transitive")
    return s.all_properties().select("relation", F.array_join("properties", ",").alias("properties"))


@register("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in [*((r, r, r) for r in schema.SELF_COMPOSED if r != "in"), *schema.CROSS_COMPOSED]) + ", ('in', 'in', NULL), ('made_in', 'in', 'made_in')) t(rel1, rel2, target)")
def store_rules(spark, sf_dir):
    return Store(spark).set_rule("in", "in", None).set_rule("made_in", "in", "made_in").all_rules()


@register("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in schema.INVERSES.items() if a != "in") + ", ('in', 'holds'), ('holds', 'in')) t(relation, inverse)")
def store_inverses(spark, sf_dir):
    return Store(spark).set_property("in", "inverse:holds").inverses()


@register(f"WITH {EDGES} SELECT r AS relation, count(*) AS n FROM edges WHERE s LIKE 'order:%' GROUP BY r")
def store_sql(spark, sf_dir):
    return store_of(spark, sf_dir).sql("SELECT relation, count(*) AS n FROM triples WHERE subject LIKE ? GROUP BY relation", ["order:%"])


@register(f"WITH {EDGES}, e AS (SELECT s, min(CASE r WHEN 'supplied_by' THEN 1 ELSE 0 END) d FROM (SELECT s, r FROM edges UNION ALL SELECT o, r FROM edges) GROUP BY s) SELECT count(*) AS nodes, sum(CASE WHEN s LIKE 'part:%' THEN d ELSE 0 END)::BIGINT AS derived_parts, (SELECT count(*) FROM edges) AS edges FROM e")
def store_nodes_and_edges(spark, sf_dir):
    nodes, edges = store_of(spark, sf_dir).nodes_and_edges()
    parts = F.count_if(F.col("derived") & F.col("id").startswith("part:"))
    return nodes.agg(F.count("*").alias("nodes"), parts.alias("derived_parts")).join(F.broadcast(edges.agg(F.count("*").alias("edges"))), F.lit(True))


@register(f"WITH {FACTS} SELECT s AS subject, r AS relation, o AS object, src AS source, seq > 0 AS numbered FROM facts")
def store_save_load(spark, sf_dir):
    path = here(spark)
    store_of(spark, sf_dir).save(path)
    return Store.load(spark, path).facts.select("subject", "relation", "object", "source", (F.col("seq") >= 0).alias("numbered"))


def odd_facts(spark, sf_dir):
    """Facts whose names hold underscores, spaces, signs and letters that IRIs must encode."""
    n = table(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("größe_"), F.lower("n_name"), F.lit(" %+/é")).alias("subject"), F.lit("capital_of").alias("relation"), F.concat(F.lit("region a_b "), F.col("n_regionkey").cast("string")).alias("object"), F.lit("bulk_load").alias("source"))


ODD = "SELECT 'größe_' || lower(n_name) || ' %+/é' AS subject, 'capital_of' AS relation, 'region a_b ' || n_regionkey AS object"


@register(f"WITH {FACTS} SELECT s AS subject, r AS relation, o AS object, src AS source FROM facts UNION ALL {ODD}, 'bulk_load' AS source FROM nation")
def nquads_round_trip(spark, sf_dir):
    path = here(spark)
    rdf.to_nquads(facts_of(spark, sf_dir).union(odd_facts(spark, sf_dir))).write.text(path)
    return rdf.from_nquads(spark.read.text(path))


@register(f"WITH {EDGES} SELECT s AS subject, r AS relation, o AS object FROM edges WHERE r = 'in' UNION ALL {ODD} FROM nation")
def turtle_round_trip(spark, sf_dir):
    path = here(spark)
    rdf.write_turtle(facts_of(spark, sf_dir).union(odd_facts(spark, sf_dir)).filter("relation in ('in', 'capital_of')"), path)
    return rdf.read_turtle(spark, path)


@register(f"{ODD}, n_nationkey AS k FROM nation")
def uri_round_trip(spark, sf_dir):
    n = odd_facts(spark, sf_dir).withColumn("k", F.expr("0"))
    keyed = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("größe_"), F.lower("n_name"), F.lit(" %+/é")).alias("subject"))
    kinds = {"subject": "entity", "relation": "relation", "object": "entity"}
    out = n.drop("k").join(keyed, "subject").select(*[triples.from_uri(triples.uri(c, k)).alias(c) for c, k in kinds.items()], "k")
    return out


@register("SELECT n_nationkey AS k, regexp_replace(n_name || '; DROP <x>', '[^A-Za-z0-9_. -]', '', 'g') AS safe, CASE WHEN n_name LIKE '% %' THEN lower(n_name) ELSE 'the ' || lower(n_name) END AS bare FROM nation")
def name_cleaning(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("k"), triples.query_name(F.concat("n_name", F.lit("; DROP <x>"))).alias("safe"), triples.without_article(F.concat(F.lit("The "), "n_name")).alias("bare"))


@register("SELECT DISTINCT lower(p_name) AS name FROM part WHERE p_name LIKE '% %'")
def gazetteer(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.lower("p_name").alias("subject"), F.lit("x").alias("object"))
    return triples.gazetteer(rows)


@register("SELECT 'cell' AS surface, * FROM (VALUES ('cell', 0), ('cell_1', 1), ('cell_2', 2)) t(sense, idx)")
def store_senses(spark, sf_dir):
    s, _ = Store(spark).new_sense("Cell ")
    s, name = s.new_sense("cell")
    assert name == "cell_2"
    return s.senses


# --- inference over whole graphs


@register(
    f"WITH RECURSIVE {EDGES}, c(s, r, o) AS (SELECT s, r, o FROM edges UNION SELECT c.s, 'in', e.o FROM c JOIN edges e ON c.o = e.s AND e.r = 'in') "
    "SELECT r AS relation, (s, r, o) IN (SELECT s, r, o FROM edges) AS stated, count(*) AS n FROM c GROUP BY ALL"
)
def kg_derive_everything(spark, sf_dir):
    rules = schema.rules(spark, [("placed_by", "in", "in"), ("supplied_by", "in", "in")])
    got = inference.derive_all(triples.star_edges(spark, sf_dir), rules, schema.properties(spark))
    return got.groupBy("relation", (F.col("source") == "user").alias("stated")).agg(F.count("*").alias("n"))


@register("SELECT 'nation:' || a.n_nationkey AS subject, 'sibling_of' AS relation, 'nation:' || b.n_nationkey AS object FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey > b.n_nationkey")
def kg_derive_symmetric(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("s"), "n_nationkey", "n_regionkey")
    a, b = n.select(F.col("s").alias("subject"), F.col("n_nationkey").alias("x"), "n_regionkey"), n.select(F.col("s").alias("object"), F.col("n_nationkey").alias("y"), "n_regionkey")
    stated = a.join(b, "n_regionkey").filter("x < y").select("subject", F.lit("sibling_of").alias("relation"), "object")
    return inference.derive_symmetric(stated, schema.properties(spark))


@register(f"WITH RECURSIVE {EDGES}, c(o) AS (SELECT o FROM edges WHERE s = 'order:1' UNION SELECT e.o FROM c JOIN edges e ON e.s = c.o) SELECT o AS node FROM c")
def kg_reachable(spark, sf_dir):
    return graph.reachable(triples.star_edges(spark, sf_dir), "order:1")


@register(f"WITH {EDGES} SELECT o AS answer, 0.85::DOUBLE AS confidence FROM edges WHERE s = 'nation:3' AND r = 'in' UNION ALL SELECT o, 0.85 FROM edges WHERE false")
def kg_open_query(spark, sf_dir):
    return answer.open_query(triples.star_edges(spark, sf_dir), "nation:3", "in")
