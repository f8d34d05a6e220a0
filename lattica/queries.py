"""The registered queries of the graph engine over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica import schema
from lattica.functions import intervals, text, vectors
from lattica.operators import graph, guard, inference, senses, solver, temporal
from lattica.plans import answer, patterns
from lattica.sources import triples
from lattica.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EDGES = """edges AS (
  SELECT 'customer:' || c_custkey AS s, 'in' AS r, 'nation:' || c_nationkey AS o FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'in', 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'in', 'region:' || n_regionkey FROM nation
  UNION ALL SELECT 'order:' || o_orderkey, 'placed_by', 'customer:' || o_custkey FROM orders
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplied_by', 'supplier:' || l_suppkey FROM lineitem)"""
STOP_SQL = ", ".join(f"'{w}'" for w in text.STOP)
TOKENS = r"list_filter(list_transform(string_split_regex(regexp_replace(lower({t}), '[^\p{{L}}\p{{N}}_\s''-]', ' ', 'g'), '\s+'), lambda w: regexp_replace(w, '^[''-]+|[''-]+$', '', 'g')), lambda w: w <> '')"
CONTENT = "list_filter(" + TOKENS + f", lambda w: w NOT IN ({STOP_SQL}) AND regexp_matches(w, '[\\p{{{{L}}}}\\p{{{{N}}}}]'))"


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register(f"WITH RECURSIVE {EDGES}, c(s, o) AS (SELECT s, o FROM edges WHERE r = 'in' UNION SELECT c.s, e.o FROM c JOIN edges e ON c.o = e.s AND e.r = 'in') SELECT s AS subject, o AS object FROM c")
def kg_closure_in(spark, sf_dir):
    return graph.closure(graph.facts_for_relation(triples.star_edges(spark, sf_dir), "in"))


@register("SELECT DISTINCT lower(trim(c_name)) AS subject, 'segment' AS relation, lower(trim(c_mktsegment)) AS object FROM customer WHERE length(trim(c_name)) > 0 AND length(trim(c_mktsegment)) > 0")
def kg_triples_normalize_dedup(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    raw = c.select(F.concat(F.lit("  "), "c_name", F.lit("\t")).alias("subject"), F.lit("Segment ").alias("relation"), F.col("c_mktsegment").alias("object"))
    return triples.normalized(raw.union(raw))


@register(f"WITH {EDGES} SELECT count(*) AS lines, count(*) AS loaded, count(DISTINCT (s, r, o)) AS facts, 0 AS skipped, count(*) - count(DISTINCT (s, r, o)) AS repeats FROM edges")
def kg_load_stats(spark, sf_dir):
    return triples.load_stats(triples.star_edges(spark, sf_dir))


@register(f"WITH {EDGES} SELECT s AS subject, o AS object FROM edges WHERE r = 'placed_by'")
def kg_filter_relation(spark, sf_dir):
    return graph.facts_for_relation(triples.star_edges(spark, sf_dir), "placed_by")


@register(f"WITH {EDGES} SELECT s AS subject FROM edges WHERE r = 'in' AND o = 'nation:7'")
def kg_inverse(spark, sf_dir):
    return graph.subjects(triples.star_edges(spark, sf_dir), "in", "nation:7")


@register(f"WITH {EDGES} SELECT r AS relation, o AS neighbor, 'out' AS direction FROM edges WHERE s = 'nation:7' UNION ALL SELECT r, s, 'in' FROM edges WHERE o = 'nation:7'")
def kg_neighbors(spark, sf_dir):
    return graph.neighbors(triples.star_edges(spark, sf_dir), "nation:7")


@register(f"WITH {EDGES} SELECT s AS entity FROM edges UNION SELECT o FROM edges")
def kg_entities(spark, sf_dir):
    return graph.entities(triples.star_edges(spark, sf_dir))


@register(f"WITH {EDGES} SELECT r AS relation, count(*) AS n, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM edges GROUP BY r")
def kg_stats(spark, sf_dir):
    return triples.star_edges(spark, sf_dir).groupBy("relation").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"), F.countDistinct("object").alias("objects"))


@register(f"WITH {EDGES}, f AS (SELECT r, count(*) f FROM edges GROUP BY r) SELECT r AS relation, round(ln((SELECT count(*) FROM edges)::DOUBLE / f) + CASE WHEN r IN ('in') THEN 1.0 ELSE 0.0 END, 6) AS score FROM f")
def kg_idf_rank(spark, sf_dir):
    return answer.ranked_relations(triples.star_edges(spark, sf_dir), ["in"]).select("relation", F.round("score", 6).alias("score"))


@register(f"WITH {EDGES} SELECT a.s AS subject, a.o AS mid, b.o AS object FROM edges a JOIN edges b ON a.o = b.s WHERE a.r = 'placed_by' AND b.r = 'in'")
def kg_two_hop(spark, sf_dir):
    return graph.two_hop(triples.star_edges(spark, sf_dir), "placed_by", "in")


@register(f"WITH {EDGES} SELECT DISTINCT a.s AS subject, 'in' AS relation, b.o AS object FROM edges a JOIN edges b ON a.o = b.s WHERE a.r = 'placed_by' AND b.r = 'in' AND NOT EXISTS (SELECT 1 FROM edges k WHERE k.s = a.s AND k.r = 'in' AND k.o = b.o)")
def kg_compose_once(spark, sf_dir):
    rules = spark.createDataFrame([("placed_by", "in", "in"), ("supplied_by", "in", None)], "rel1 string, rel2 string, target string")
    return inference.compose(triples.star_edges(spark, sf_dir), rules)


@register(
    f"WITH RECURSIVE {EDGES}, c(s, r, o) AS (SELECT s, r, o FROM edges WHERE r IN ('in', 'placed_by') UNION SELECT c.s, 'in', e.o FROM c JOIN edges e ON c.o = e.s AND e.r = 'in') "
    "SELECT s AS subject, r AS relation, o AS object, CASE WHEN (s, r, o) IN (SELECT s, r, o FROM edges) THEN 'user' ELSE 'derived' END AS source FROM c"
)
def kg_derive_all(spark, sf_dir):
    edges = triples.star_edges(spark, sf_dir).filter(F.col("relation").isin("in", "placed_by"))
    return inference.derive_all(edges, schema.rules(spark, [("placed_by", "in", "in")]), schema.properties(spark))


@register(
    f"WITH {EDGES}, e AS (SELECT DISTINCT s, r, o FROM edges UNION SELECT 'nation:' || a.n_nationkey, 'neighbour', 'nation:' || b.n_nationkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey), "
    "ch AS (SELECT a.r, a.s, b.o FROM e a JOIN e b ON a.r = b.r AND a.o = b.s WHERE a.s <> b.o), "
    "c AS (SELECT ch.r, count(*) n, count(k.s) k FROM ch LEFT JOIN e k ON k.r = ch.r AND k.s = ch.s AND k.o = ch.o GROUP BY ch.r), "
    "p AS (SELECT a.r, count(*) n, count(b.s) k FROM e a LEFT JOIN e b ON a.r = b.r AND a.s = b.o AND a.o = b.s WHERE a.s <> a.o GROUP BY a.r), "
    "f AS (SELECT r, count(*) n, max(k) k FROM (SELECT r, s, count(*) k FROM e GROUP BY r, s) GROUP BY r) "
    "SELECT f.r AS relation, coalesce(c.n, 0) AS chains, coalesce(c.k, 0) AS closed, coalesce(p.n, 0) AS pairs, coalesce(p.k, 0) AS reversed, f.n AS subjects, f.k AS fan_out, "
    "coalesce(c.n, 0) >= 3 AND coalesce(c.k, 0) >= 0.8 * coalesce(c.n, 0) AS transitive, coalesce(p.n, 0) >= 3 AND coalesce(p.k, 0) >= 0.8 * coalesce(p.n, 0) AS symmetric, f.n >= 3 AND f.k <= 1 AS functional "
    "FROM f LEFT JOIN c ON c.r = f.r LEFT JOIN p ON p.r = f.r"
)
def kg_detect_properties(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_nationkey").alias("a"), "n_regionkey"), n.select(F.col("n_nationkey").alias("b"), "n_regionkey")
    near = a.join(b, "n_regionkey").filter("a <> b").select(F.concat(F.lit("nation:"), F.col("a").cast("string")).alias("subject"), F.lit("neighbour").alias("relation"), F.concat(F.lit("nation:"), F.col("b").cast("string")).alias("object"))
    return inference.detect_properties(triples.star_edges(spark, sf_dir).union(near))


@register(f"WITH {EDGES} SELECT s AS subject, count(DISTINCT o) AS n FROM edges WHERE r = 'supplied_by' GROUP BY s HAVING count(DISTINCT o) > 1")
def kg_functional_conflicts(spark, sf_dir):
    return inference.functional_conflicts(triples.star_edges(spark, sf_dir), "supplied_by")


@register(
    "WITH p AS (SELECT c_custkey k, 'customer:' || c_custkey a, 'customer:' || (c_custkey + c_custkey % 3) b FROM customer), "
    "n AS (SELECT 'customer:' || c_custkey c, c_nationkey v FROM customer) "
    "SELECT p.a, p.b, CASE WHEN p.a = p.b THEN true WHEN x.v <> y.v THEN false END AS same, CASE WHEN p.a = p.b THEN 1.0 WHEN x.v <> y.v THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence "
    "FROM p LEFT JOIN n x ON x.c = p.a LEFT JOIN n y ON y.c = p.b"
)
def kg_check_same(spark, sf_dir):
    name = lambda e: F.concat(F.lit("customer:"), F.expr(e).cast("string"))
    pairs = table(spark, sf_dir, "customer").select(name("c_custkey").alias("a"), name("c_custkey + c_custkey % 3").alias("b"))
    return inference.check_same(triples.star_edges(spark, sf_dir), pairs, ["in"])


@register(
    f"WITH {EDGES} SELECT a.s AS subject, c.o AS object, 0.4::DOUBLE AS confidence, a.s || ' --placed_by--> ' || a.o || ' , ' || b.s || ' --in--> ' || b.o || ' , ' || c.s || ' --in--> ' || c.o AS proof "
    "FROM edges a JOIN edges b ON a.o = b.s AND b.r = 'in' JOIN edges c ON b.o = c.s AND c.r = 'in' WHERE a.r = 'placed_by'"
)
def kg_path_confidence(spark, sf_dir):
    e = triples.star_edges(spark, sf_dir)
    a, b = graph.two_hop(e, "placed_by", "in"), graph.facts_for_relation(e, "in").select(F.col("subject").alias("object"), F.col("object").alias("last"))
    chains = a.join(b, "object").select(F.array(F.lit("placed_by"), F.lit("in"), F.lit("in")).alias("relations"), F.array("subject", "mid", "object", "last").alias("nodes"))
    conf = inference.chain_confidence(F.col("relations"), schema.rules(spark), schema.properties(spark))
    return chains.select(F.col("nodes")[0].alias("subject"), F.col("nodes")[3].alias("object"), conf.alias("confidence"), graph.path_text("relations", "nodes").alias("proof"))


@register("SELECT 3::INTEGER AS hops, 'placed_by,in,in' AS relations, 'order:1,customer:' || c_custkey || ',nation:' || c_nationkey || ',region:' || n_regionkey AS nodes FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey = 1")
def kg_paths(spark, sf_dir):
    e = triples.star_edges(spark, sf_dir).filter("relation <> 'supplied_by'")
    world = graph.facts_for_relation(e, "in").filter("object like 'region:%'").select(F.col("object").alias("subject"), F.lit("in").alias("relation"), F.lit("world").alias("object")).distinct()
    found = graph.paths(e.unionByName(world), "order:1", "world", 4)
    return found.select((F.col("hops") - 1).alias("hops"), F.concat_ws(",", F.slice("relations", 1, 3)).alias("relations"), F.concat_ws(",", F.slice("nodes", 1, 4)).alias("nodes"))


@register(f"WITH {EDGES} SELECT c.o IS NOT NULL AS answer, CASE WHEN c.o IS NOT NULL THEN 'direct' ELSE 'contradiction' END AS method, CASE WHEN c.o IS NOT NULL THEN 0.95 ELSE 0.9 END::DOUBLE AS confidence FROM (SELECT 1) LEFT JOIN (SELECT o FROM edges WHERE s = 'nation:3' AND r = 'in' AND o = 'region:1') c ON true")
def kg_query(spark, sf_dir):
    return answer.query(triples.star_edges(spark, sf_dir), "Nation:3", " in", "region:1", properties=schema.properties(spark, [("in", "functional")])).select("answer", "method", "confidence")


@register("SELECT lower(trim(n.n_name)) AS subject, 'located in' AS relation, lower(trim(r.r_name)) AS object FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def kg_alias_map_load(spark, sf_dir):
    e = triples.star_edges(spark, sf_dir).filter("relation = 'in'")
    alias = lambda t, k, n, kind: table(spark, sf_dir, t).select(F.concat(F.lit(f"{kind}:"), F.col(k).cast("string")).alias("id"), triples.pick_alias(F.array(F.lit("Ωμέγα"), F.col(n))).alias("name"))
    names = alias("nation", "n_nationkey", "n_name", "nation").union(alias("region", "r_regionkey", "r_name", "region"))
    return triples.map_aliases(e, names, spark.createDataFrame([("in", "located in")], "id string, name string"))


@register(
    "SELECT user_id::VARCHAR AS subject, event_type AS relation, 'seen' AS object, min_by(event_id::VARCHAR, event_id) AS proof, max_by(year(ts), event_id)::INTEGER AS t_start, count(*) AS writes FROM events GROUP BY ALL"
)
def kg_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").cast("string").alias("subject"), F.col("event_type").alias("relation"), F.lit("seen").alias("object"), F.lit("user").alias("source"), F.col("event_id").cast("string").alias("proof"), F.lit(1.0).alias("confidence"), F.year("ts").alias("t_start"), F.lit(None).cast("int").alias("t_end"), F.col("event_id").alias("seq"))
    half = F.col("seq") % 2 == 0
    out = triples.upsert(rows.filter(half), rows.filter(~half))
    writes = rows.groupBy("subject", "relation", "object").agg(F.count("*").alias("writes"))
    return out.join(writes, ["subject", "relation", "object"]).select("subject", "relation", "object", "proof", "t_start", "writes")


@register("SELECT user_id::VARCHAR AS subject, max_by(year(ts), event_id)::INTEGER AS t_start FROM events GROUP BY user_id")
def temporal_last_interval(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("subject"), F.year("ts").alias("t_start"), F.lit(None).cast("int").alias("t_end"), F.col("event_id").alias("seq"))
    return triples.latest_intervals(e).select("subject", "t_start")


@register(
    "WITH o AS (SELECT o_orderkey k, o_custkey c, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) a, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 1 + (o_orderkey % 400)::INTEGER b FROM orders) "
    "SELECT x.k AS first, y.k AS second, CASE WHEN x.a = y.a AND x.b = y.b THEN 'equals' WHEN x.b < y.a THEN 'before' WHEN y.b < x.a THEN 'after' WHEN x.b = y.a THEN 'meets' WHEN y.b = x.a THEN 'met_by' "
    "WHEN y.a < x.a AND x.b < y.b THEN 'during' WHEN x.a < y.a AND y.b < x.b THEN 'contains' WHEN x.a < y.a AND x.b < y.b THEN 'overlaps' WHEN y.a < x.a AND y.b < x.b THEN 'overlapped_by' "
    "WHEN x.a = y.a AND x.b < y.b THEN 'starts' WHEN x.a = y.a THEN 'started_by' WHEN x.a > y.a THEN 'finishes' ELSE 'finished_by' END AS relation FROM o x JOIN o y ON x.c = y.c AND x.k < y.k"
)
def allen_classify(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).alias("a"))
    o = o.withColumn("b", (F.col("a") + 1 + F.col("k") % 400).cast("int"))
    x, y = (o.select("c", *[F.col(i).alias(f"{p}{i}") for i in "kab"]) for p in "xy")
    rel = intervals.classify(F.col("xa"), F.col("xb"), F.col("ya"), F.col("yb"))
    return x.join(y, "c").filter("xk < yk").select(F.col("xk").alias("first"), F.col("yk").alias("second"), rel.alias("relation"))


@register(
    "WITH i AS (SELECT a, b FROM range(6) x(a), range(6) y(b) WHERE a < b), k AS (SELECT x.a a, x.b b, y.a c, y.b d, CASE WHEN x.a = y.a AND x.b = y.b THEN 'equals' WHEN x.b < y.a THEN 'before' WHEN y.b < x.a THEN 'after' WHEN x.b = y.a THEN 'meets' WHEN y.b = x.a THEN 'met_by' "
    "WHEN y.a < x.a AND x.b < y.b THEN 'during' WHEN x.a < y.a AND y.b < x.b THEN 'contains' WHEN x.a < y.a AND x.b < y.b THEN 'overlaps' WHEN y.a < x.a AND y.b < x.b THEN 'overlapped_by' WHEN x.a = y.a AND x.b < y.b THEN 'starts' WHEN x.a = y.a THEN 'started_by' WHEN x.a > y.a THEN 'finishes' ELSE 'finished_by' END r FROM i x, i y) "
    "SELECT DISTINCT p.r AS first, q.r AS second, t.r AS result FROM k p JOIN k q ON p.c = q.a AND p.d = q.b JOIN k t ON t.a = p.a AND t.b = p.b AND t.c = q.c AND t.d = q.d"
)
def allen_compose(spark, sf_dir):
    return intervals.composition(spark)


PHRASES = "from {y} to {z}|between {y} and {z}|since {y}|until {y}|{y}-{z}|during the 1990s|in {y}|none"


@register(
    "WITH t AS (SELECT o_orderkey k, year(o_orderdate)::INTEGER y, year(o_orderdate)::INTEGER + 1 + (o_orderkey % 5)::INTEGER z, (o_orderkey % 8)::INTEGER c FROM orders) SELECT k, "
    "CASE WHEN c IN (0, 1, 2, 4, 6) THEN y WHEN c = 5 THEN 1990 ELSE -1 END::INTEGER AS t_start, CASE WHEN c IN (0, 1, 4) THEN z WHEN c = 3 THEN y WHEN c = 5 THEN 2000 WHEN c = 6 THEN y + 1 ELSE -1 END::INTEGER AS t_end FROM t"
)
def interval_from_text(spark, sf_dir):
    y, k = F.year("o_orderdate"), F.col("o_orderkey")
    t = F.element_at(F.split(F.lit(PHRASES), r"\|"), (k % 8 + 1).cast("int"))
    said = F.replace(F.replace(t, F.lit("{y}"), y.cast("string")), F.lit("{z}"), (y + 1 + k % 5).cast("string"))
    return table(spark, sf_dir, "orders").select(k.alias("k"), text.interval(said).alias("i")).select("k", F.coalesce("i.start", F.lit(-1)).alias("t_start"), F.coalesce("i.end", F.lit(-1)).alias("t_end"))


@register("SELECT w AS word, count(*) AS n FROM (SELECT unnest(" + TOKENS.format(t="text") + ") w FROM documents) GROUP BY w")
def text_tokenize_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(text.tokenize(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@register("SELECT doc_id, len(" + CONTENT.format(t="text") + ")::BIGINT AS n FROM documents")
def text_content_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.content_words(text.tokenize(F.col("text")))).cast("long").alias("n"))


@register(
    "WITH w AS (SELECT " + CONTENT.format(t="text") + " ws FROM documents), p AS (SELECT ws, unnest(range(1, len(ws) + 1)) i FROM w), q AS (SELECT ws, i, unnest(range(greatest(1, i - 2), least(len(ws), i + 2) + 1)) j FROM p) "
    "SELECT ws[i] AS word, ws[j] AS near, count(*) AS n FROM q WHERE i <> j GROUP BY ALL"
)
def cooccurrence(spark, sf_dir):
    return senses.cooccurrence(table(spark, sf_dir, "documents"), "doc_id", "text", text.STOP, 2)


@register(
    "WITH g AS (SELECT lang AS sense, w AS word, count(*) cnt FROM (SELECT lang, unnest(" + CONTENT.format(t="text") + ") w FROM documents) GROUP BY ALL), "
    "c AS (SELECT doc_id AS key, unnest(" + CONTENT.format(t="text") + ") word FROM documents), "
    "s AS (SELECT key, sense, sum(cnt)::BIGINT score FROM c JOIN g USING (word) GROUP BY ALL) SELECT key, sense, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, sense) r FROM s) WHERE r = 1"
)
def lesk_overlap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = docs.select("doc_id", "lang", F.explode(text.content_words(text.tokenize(F.col("text")))).alias("word"))
    glosses = words.groupBy(F.col("lang").alias("sense"), "word").agg(F.count("*").alias("cnt"))
    return senses.gloss_overlap(words.select(F.col("doc_id").alias("key"), "word"), glosses)


@register(
    "WITH f AS (SELECT c_custkey k, 'x' || (c_custkey % 200) e, ['capital_of','is_a','founded_by','born_in','is_a','is_a'][(c_custkey % 6 + 1)::INTEGER] r, ['y','country','z','w','person','city'][(c_custkey % 6 + 1)::INTEGER] o FROM customer), "
    "t AS (SELECT e, CASE r WHEN 'capital_of' THEN 'city' WHEN 'founded_by' THEN 'organization' WHEN 'born_in' THEN 'person' ELSE o END ty, min(k) s FROM f GROUP BY ALL) "
    "SELECT a.e AS entity, a.ty AS prior_type, b.ty AS new_type FROM t a JOIN t b ON a.e = b.e AND a.s < b.s WHERE (a.ty, b.ty) IN (('city', 'country'), ('country', 'city'), ('person', 'organization'), ('organization', 'person')) "
    "UNION ALL SELECT * FROM (SELECT 'y', 'a', 'b') WHERE false"
)
def guard_conflicts(spark, sf_dir):
    k = F.col("c_custkey")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % 6 + 1).cast("int"))
    rel = pick(["capital_of", "is_a", "founded_by", "born_in", "is_a", "is_a"])
    obj = pick(["y", "country", "z", "w", "person", "city"])
    f = table(spark, sf_dir, "customer").select(F.concat(F.lit("x"), (k % 200).cast("string")).alias("subject"), rel.alias("relation"), obj.alias("object"), k.alias("seq"))
    return guard.contradictions(f).filter(F.col("entity").startswith("x"))


@register(
    "SELECT o_orderkey AS seq, 'order ' || (o_orderkey % 50) AS subject, CASE o_orderkey % 3 WHEN 0 THEN 'depends_on' WHEN 1 THEN 'went_to' ELSE 'go' END AS relation FROM orders "
    "QUALIFY row_number() OVER (PARTITION BY o_orderkey % 50, o_orderkey % 3 ORDER BY o_orderkey) = 1"
)
def dedup_specificity(spark, sf_dir):
    k = F.col("o_orderkey")
    rel = F.when(k % 3 == 0, "depends_on").when(k % 3 == 1, "went_to").otherwise("go")
    rows = table(spark, sf_dir, "orders").select(k.alias("seq"), F.concat(F.lit("The  Order "), (k % 50).cast("string")).alias("subject"), rel.alias("relation"), F.lit("a B").alias("object"))
    return senses.best_per_canonical(rows).select("seq", text.entity_name(F.col("subject")).alias("subject"), "relation")


@register(
    "WITH p AS (SELECT label, unnest(range(1, 65)) i, unnest(embedding) x FROM embeddings), s AS (SELECT label, i, sum(CASE WHEN x >= 0 THEN 1 ELSE -1 END) s FROM p GROUP BY ALL) "
    "SELECT label, string_agg(CASE WHEN s >= 0 THEN '+' ELSE '-' END, '' ORDER BY i) AS signs FROM s GROUP BY label"
)
def vec_bundle_label(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", vectors.sign(F.col("embedding")).alias("v"))
    out = vectors.bundled(e, ["label"], "v")
    return out.select("label", F.concat_ws("", F.transform("v", lambda x: F.when(x > 0, "+").otherwise("-"))).alias("signs"))


@register("SELECT vec_id, 1.0::DOUBLE AS back, round(list_dot_product(list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1.0::DOUBLE ELSE -1.0 END), list_transform(list_concat(embedding[-3:], embedding[:-4]), lambda x: CASE WHEN x >= 0 THEN 1.0::DOUBLE ELSE -1.0 END)) / 64, 6) AS turned FROM embeddings")
def vec_bind_permute(spark, sf_dir):
    v = vectors.sign(F.col("embedding"))
    name = vectors.named(F.col("vec_id").cast("string"), 64)
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", v.alias("v"), name.alias("n")).select("vec_id", vectors.similarity(vectors.bind(vectors.bind(F.col("v"), F.col("n")), F.col("n")), F.col("v")).alias("back"), F.round(vectors.similarity(F.col("v"), vectors.permute(F.col("v"), 3)), 6).alias("turned"))


@register("SELECT event_id, CASE WHEN value >= 90 THEN 'critical' WHEN value >= 70 THEN 'high' WHEN value >= 30 THEN 'medium' ELSE 'low' END AS level FROM events")
def metrics_level(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.level(F.col("value")).alias("level"))


@register(r"SELECT page_id, len(regexp_extract_all(lower(html), '<p[ >/]'))::BIGINT AS p, len(regexp_extract_all(lower(html), '<script[ >/]'))::BIGINT AS script, len(regexp_extract_all(lower(html), '<a[ >/]'))::BIGINT AS a FROM pages")
def html_tag_features(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", *[text.tag_count(F.col("html"), t).cast("long").alias(t) for t in ("p", "script", "a")])


@register("SELECT conv_id, turn, rtrim(text) LIKE '%?' AS question FROM conversations")
def question_flag(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.is_question(F.col("text")).alias("question"))


@register("SELECT n_nationkey AS k, lower(n_name) || '|in|' || 'europe west' AS said FROM nation WHERE n_name NOT LIKE '% %'")
def triples_from_text(spark, sf_dir):
    n = table(spark, sf_dir, "nation").filter(~F.col("n_name").contains(" "))
    said = n.select(F.col("n_nationkey").alias("k"), F.explode(text.statements(F.concat("n_name", F.lit(" is in the Europe West."))))).select("k", "col.*")
    return said.select("k", F.concat_ws("|", "subject", "relation", "object").alias("said"))


@register("SELECT n_nationkey AS k, unnest([lower(n_name) || ' is big', 'it is far']) AS part FROM nation")
def preprocess_split(spark, sf_dir):
    said = F.concat(F.lit("so "), F.lower("n_name"), F.lit(" is big, and basically it is far"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.explode(text.sentences(said)).alias("part"))


@register(f"WITH {EDGES} SELECT DISTINCT s AS x, o AS n FROM edges WHERE r = 'in' AND s LIKE 'supplier:%' AND o <> 'nation:1'")
def sparql_select_filter(spark, sf_dir):
    return patterns.run(triples.star_edges(spark, sf_dir), "SELECT DISTINCT ?x ?n WHERE { ?x in ?n . FILTER(STRSTARTS(?x, 'supplier:') && ?n != \"nation:1\") }")


@register(f"WITH {EDGES} SELECT a.s AS o, a.o AS c, b.o AS n FROM edges a LEFT JOIN edges b ON a.o = b.s AND b.r = 'in' WHERE a.r = 'placed_by'")
def sparql_optional(spark, sf_dir):
    return patterns.run(triples.star_edges(spark, sf_dir), "SELECT ?o ?c ?n WHERE { ?o placed_by ?c . OPTIONAL { ?c in ?n } }")


@register(f"WITH {EDGES} SELECT count(DISTINCT s) AS n FROM edges WHERE r IN ('in', 'placed_by')")
def sparql_union_count(spark, sf_dir):
    return patterns.run(triples.star_edges(spark, sf_dir), "SELECT (COUNT(DISTINCT ?x) AS ?n) WHERE { { ?x in ?y } UNION { ?x placed_by ?y } }")


@register("SELECT 'customer:' || c_custkey AS x FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 UNION SELECT 'supplier:' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2 UNION SELECT 'nation:' || n_nationkey FROM nation WHERE n_regionkey = 2")
def sparql_path(spark, sf_dir):
    return patterns.run(triples.star_edges(spark, sf_dir), "SELECT ?x WHERE { ?x in+ region:2 }")


@register("SELECT event_type, date_trunc('day', ts)::VARCHAR AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windowed_counts(spark, sf_dir):
    out = ingest.windowed_counts(table(spark, sf_dir, "events"))
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("total", 4).alias("total"))


@register("SELECT a.x AS a, b.x AS b, c.x AS c FROM range(1, 21) a(x), range(1, 21) b(x), range(1, 21) c(x) WHERE a.x < b.x AND a.x * a.x + b.x * b.x = c.x * c.x")
def solver_triples(spark, sf_dir):
    return solver.solve(spark, {v: range(1, 21) for v in "abc"}, [(("a", "b"), "a < b"), (("a", "b", "c"), "a * a + b * b = c * c")])


@register("SELECT a.x AS a, b.x AS b, c.x AS c, d.x AS d FROM range(4) a(x), range(4) b(x), range(4) c(x), range(4) d(x) WHERE a.x NOT IN (b.x, c.x, d.x) AND b.x NOT IN (c.x, d.x) AND c.x <> d.x AND abs(a.x - b.x) <> 1 AND abs(b.x - c.x) <> 1 AND abs(c.x - d.x) <> 1 AND abs(a.x - c.x) <> 2 AND abs(b.x - d.x) <> 2 AND abs(a.x - d.x) <> 3")
def solver_all_different(spark, sf_dir):
    v = ["a", "b", "c", "d"]
    rules = [((x, y), f"abs({x} - {y}) <> {j - i}") for i, x in enumerate(v) for j, y in enumerate(v) if i < j]
    return solver.solve(spark, {x: range(4) for x in v}, solver.all_different(v) + rules)


@register(
    "WITH e AS (SELECT user_id u, max_by(year(ts), event_id)::INTEGER s, max_by(year(ts) + 1 + event_id % 3, event_id)::INTEGER t FROM events GROUP BY user_id), p AS (SELECT x.u a, y.u b, x.s xs, x.t xe, y.s ys, y.t ye FROM e x JOIN e y ON y.u = x.u + 1) "
    "SELECT a::VARCHAR AS a, b::VARCHAR AS b, CASE WHEN xs = ys AND xe = ye THEN 'equals' WHEN xe < ys THEN 'before' WHEN ye < xs THEN 'after' WHEN xe = ys THEN 'meets' WHEN ye = xs THEN 'met_by' WHEN ys < xs AND xe < ye THEN 'during' "
    "WHEN xs < ys AND ye < xe THEN 'contains' WHEN xs < ys AND xe < ye THEN 'overlaps' WHEN ys < xs AND ye < xe THEN 'overlapped_by' WHEN xs = ys AND xe < ye THEN 'starts' WHEN xs = ys THEN 'started_by' WHEN xs > ys THEN 'finishes' ELSE 'finished_by' END AS relation FROM p"
)
def temporal_relate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    f = e.select(F.col("user_id").cast("string").alias("subject"), F.year("ts").alias("t_start"), (F.year("ts") + 1 + F.col("event_id") % 3).cast("int").alias("t_end"), F.col("event_id").alias("seq"))
    u = e.select("user_id").distinct()
    pairs = u.join(u.select((F.col("user_id") - 1).alias("user_id")), "user_id").select(F.col("user_id").cast("string").alias("a"), (F.col("user_id") + 1).cast("string").alias("b"))
    return temporal.relate(f, pairs)


@register(
    "WITH s AS (SELECT 'n' || n_nationkey a, CASE WHEN n_nationkey % 2 = 0 THEN 'before' ELSE 'meets' END r, 'n' || (n_nationkey + 1) b FROM nation) SELECT x.a, 'before' AS relation, y.b AS c FROM s x JOIN s y ON x.b = y.a"
)
def temporal_derive(spark, sf_dir):
    k = F.col("n_nationkey")
    stated = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), k.cast("string")).alias("a"), F.when(k % 2 == 0, "before").otherwise("meets").alias("relation"), F.concat(F.lit("n"), (k + 1).cast("string")).alias("b"))
    return temporal.derive(stated, intervals.composition(spark))


@register("SELECT DISTINCT unnest(['r' || p_partkey, 'r' || (p_partkey - p_partkey % 8)]) AS relation, 'r' || (p_partkey - p_partkey % 8) AS canonical FROM part WHERE p_partkey % 8 > 0")
def relation_synonyms(spark, sf_dir):
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("r"), c.cast("string"))
    taught = table(spark, sf_dir, "part").filter(k % 8 > 0).select(k.alias("seq"), name(k - k % 8).alias("canonical"), name(k).alias("synonym"))
    return senses.synonym_groups(taught)


@register("SELECT event_id, CASE WHEN props IS NULL THEN 'absent' WHEN left(trim(props), 1) = '{' THEN 'entity' WHEN left(trim(props), 1) = '[' THEN 'multiple' ELSE 'string' END AS concept FROM events")
def json_concept(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.json_concept(F.col("props")).alias("concept"))


def loaded() -> None:
    """Let the other modules of queries register theirs."""
    import lattica.queries_decisions
    import lattica.queries_reasoning
    import lattica.queries_state
    import lattica.queries_store
    import lattica.queries_words  # noqa: F401


def queries() -> dict:
    loaded()
    return dict(QUERIES)


def oracle_sql() -> dict:
    loaded()
    return dict(SQL)
