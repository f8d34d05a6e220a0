"""Registered queries of question answering, text extraction, constraints and time, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica import languages, schema
from lattica.functions import intervals
from lattica.operators import extraction, solver, temporal
from lattica.plans import questions
from lattica.queries import EDGES, register, table
from lattica.sources import triples

# --- questions over the star graph, one per row of a table


def asked(spark, sf_dir, name, key, said):
    return table(spark, sf_dir, name).select(F.col(key).alias("key"), said.alias("text"))


def said(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def num(c):
    return F.col(c).cast("string")


def small_graph(spark, sf_dir):
    return triples.star_edges(spark, sf_dir)


def answered(spark, sf_dir, rows, **options):
    return questions.answers(rows, small_graph(spark, sf_dir), **options)


@register("SELECT c_custkey AS key, 'YES. customer:' || c_custkey || ' in nation:' || c_nationkey || ' (direct)' AS answer, 0.95::DOUBLE AS confidence, 'sparql_direct' AS method FROM customer")
def qa_stated(spark, sf_dir):
    return answered(spark, sf_dir, asked(spark, sf_dir, "customer", "c_custkey", said("Is Customer:", num("c_custkey"), " in nation:", num("c_nationkey"), "?")))


@register("SELECT c_custkey AS key, 'YES. customer:' || c_custkey || ' → ... → region:' || n_regionkey || ' via in+' AS answer, 0.85::DOUBLE AS confidence, 'sparql_transitive' AS method FROM customer JOIN nation ON c_nationkey = n_nationkey")
def qa_transitive(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return answered(spark, sf_dir, c.select(F.col("c_custkey").alias("key"), said("Is customer:", num("c_custkey"), " in region:", num("n_regionkey"), "?").alias("text")))


@register("SELECT c_custkey AS key, CASE WHEN o IS NULL THEN NULL ELSE 'Direct fact: (' || o || ', placed_by, customer:' || c_custkey || ')' END AS answer, CASE WHEN o IS NULL THEN 0 ELSE 0.95 END::DOUBLE AS confidence, CASE WHEN o IS NULL THEN 'unknown' ELSE 'direct' END AS method FROM customer LEFT JOIN (SELECT o_custkey, min('order:' || o_orderkey) o FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey WHERE o IS NOT NULL")
def qa_inverse(spark, sf_dir):
    """What was placed by each customer that has orders."""
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).distinct()
    return answered(spark, sf_dir, c.select("key", said("What was placed_by customer:", num("key"), "?").alias("text")))


@register("SELECT s_suppkey AS key, 'in(supplier:' || s_suppkey || ') → nation:' || s_nationkey AS answer, 0.85::DOUBLE AS confidence, 'direct' AS method FROM supplier")
def qa_forward(spark, sf_dir):
    return answered(spark, sf_dir, asked(spark, sf_dir, "supplier", "s_suppkey", said("what is supplier:", num("s_suppkey"), " in")))


@register(f"WITH {EDGES}, f AS (SELECT r, ln((SELECT count(*) FROM edges)::DOUBLE / count(*)) idf FROM edges GROUP BY r), c AS (SELECT s n, s, r, o, 'forward' w FROM edges UNION ALL SELECT o, s, r, o, 'inverse' FROM edges), "
          "t AS (SELECT n, s, r, o, w, row_number() OVER (PARTITION BY n ORDER BY round(idf + CASE w WHEN 'forward' THEN 0.5 ELSE 0 END, 9) DESC, w, s, r, o) k FROM c JOIN f USING (r) WHERE n LIKE 'nation:%') "
          "SELECT substr(n, 8)::INTEGER AS key, s || ' ' || r || ' ' || o AS answer, 0.9::DOUBLE AS confidence, 'open_query_' || w AS method FROM t WHERE k = 1")
def qa_open(spark, sf_dir):
    return answered(spark, sf_dir, asked(spark, sf_dir, "nation", "n_nationkey", said("Tell me: where would nation:", num("n_nationkey"), " be?")))


@register("SELECT a.n_nationkey AS key, 'nation:' || a.n_nationkey || CASE WHEN a.n_regionkey <> b.n_regionkey THEN ' is not the same as nation:' ELSE '' END || CASE WHEN a.n_regionkey <> b.n_regionkey THEN b.n_nationkey::VARCHAR ELSE '' END AS answer, 0.9::DOUBLE AS confidence, 'same' AS method FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 WHERE a.n_regionkey <> b.n_regionkey")
def qa_equality(spark, sf_dir):
    """Neighbours by number that lie in different regions; `in` is functional here."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    m = n.select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.col("n_regionkey").alias("other"))
    rows = n.join(m, "n_nationkey").filter("n_regionkey <> other").select(F.col("n_nationkey").alias("key"), said("Are nation:", num("n_nationkey"), " and nation:", (F.col("n_nationkey") + 1).cast("string"), " the same?").alias("text"))
    return answered(spark, sf_dir, rows, properties=schema.properties(spark, [("in", "functional")]))


@register("SELECT o_orderkey AS key, 'order:' || o_orderkey || ' --placed_by--> customer:' || o_custkey || ' --in--> nation:' || c_nationkey AS answer, 0.8::DOUBLE AS confidence, 'sparql_2hop' AS method FROM orders JOIN customer ON o_custkey = c_custkey")
def qa_two_hops(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return answered(spark, sf_dir, o.select(F.col("o_orderkey").alias("key"), said("what links order:", num("o_orderkey"), " to nation:", num("c_nationkey")).alias("text")))


@register("SELECT o_orderkey AS key, 'order:' || o_orderkey || ' → ... → region:' || n_regionkey || ' (3-hop: placed_by → in → in)' AS answer, 0.6::DOUBLE AS confidence, 'sparql_3hop' AS method FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def qa_three_hops(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    got = answered(spark, sf_dir, o.select(F.col("o_orderkey").alias("key"), said("what links order:", num("o_orderkey"), " to region:", num("n_regionkey")).alias("text")))
    return got.withColumn("confidence", F.round("confidence", 6))


@register("SELECT conv_id * 1000 + turn AS key, NULL::VARCHAR AS answer, 0.0::DOUBLE AS confidence, 'unknown' AS method FROM conversations")
def qa_unknown(spark, sf_dir):
    """Turns of conversations, which name nothing of the graph."""
    return answered(spark, sf_dir, table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "text"))


@register("SELECT p_partkey AS key, lower(n) AS name, 1::INTEGER AS at FROM (SELECT p_partkey, p_name n FROM part)")
def entity_linking(spark, sf_dir):
    """Names of parts inside texts; of overlapping names the longest."""
    p = table(spark, sf_dir, "part")
    names = p.select(F.lower("p_name").alias("name")).union(p.select(F.split(F.lower("p_name"), " ")[0])).distinct()
    return extraction.entities_in(p.select(F.col("p_partkey").alias("key"), said("the ", F.col("p_name"), "!").alias("text")), names)


@register("SELECT k AS key, 'depends_on' AS relation FROM (SELECT p_partkey k FROM part) UNION ALL SELECT -1, 'x' WHERE false")
def relation_alike(spark, sf_dir):
    rel = spark.createDataFrame([("depends_on",), ("part_of",), ("zzz",)], "relation string")
    words = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.array(F.lit("depending"), F.lit("depend"), F.lit("one"), F.lit("onn")).alias("ws"))
    return questions.alike(words, rel)


@register("SELECT n_nationkey AS key, n_nationkey % 2 = 0 AS ok FROM nation")
def answer_containment(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    names = n.select(F.lower("n_name").alias("name")).union(spark.createDataFrame([("paris",)], "name string"))
    rows = n.select(F.col("n_nationkey").alias("key"), said("where is ", F.lower("n_name"), " and paris").alias("text"), F.when(F.col("n_nationkey") % 2 == 0, said("paris or ", F.lower("n_name"))).otherwise("paris").alias("found"))
    return questions.contained(rows, names)


# --- text

#: Sentence frames with what each states: one per row of nation in turn.
FRAMES = (
    ("{n} is the capital of the {m}.", "{n}|capital_of|{m}"),
    ("{n} is in {m} on river.", "{n}|in|{m}"),
    ("{n} is inside {m}", "{n}|inside|{m}"),
    ("{n} is within {m}", "{n}|inside|{m}"),
    ("{n} contains {m}", "{n}|contains|{m}"),
    ("{n} is part of {m}", "{n}|part_of|{m}"),
    ("{n} is before {m} at noon", "{n}|before|{m}"),
    ("{n} before {m}", "{n}|before|{m}"),
    ("{n} is after {m}", "{n}|after|{m}"),
    ("{n} after {m}", "{n}|after|{m}"),
    ("{n} means {m}", "{n}|means|{m}"),
    ("{n} is married to {m}", "{n}|married_to|{m}"),
    ("{n} is larger than {m}", "{n}|larger_than|{m}"),
    ("{n} is sibling_of {m}", "{n}|sibling_of|{m}"),
    ("{n} were rival_of {m}", "{n}|rival_of|{m}"),
    ("{n} feeds_into {m}", "{n}|feeds_into|{m}"),
)


def sql_list(items):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


@register(f"SELECT c_custkey AS key, replace(replace({sql_list(w for _, w in FRAMES)}[(c_custkey % 16 + 1)::INTEGER], '{{n}}', 'a' || c_custkey), '{{m}}', 'b' || c_nationkey) AS said FROM customer")
def text_statements(spark, sf_dir):
    """Every pattern, over a sentence per customer."""
    frame = F.element_at(F.array(*[F.lit(f) for f, _ in FRAMES]), (F.col("c_custkey") % 16 + 1).cast("int"))
    t = F.replace(F.replace(frame, F.lit("{n}"), said("A", num("c_custkey"))), F.lit("{m}"), said("b", num("c_nationkey")))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), t.alias("text"))
    return extraction.facts_of(rows).select("key", F.concat_ws("|", "subject", "relation", "object").alias("said"))


@register()
def text_facts_of_documents(spark, sf_dir):
    """What all documents state; the tests hold the patterns against a plain reading."""
    return extraction.facts_of(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text"))


ORDERS = (
    ("After {n} left, {m} came.", "{n} left|before|{m} came"),
    ("{n} left before {m} came.", "{n} left|before|{m} came"),
    ("{n} left and then {m} came.", "{n} left|before|{m} came"),
    ("{n} left. Then {m} came.", "{n} left|before|{m} came"),
    ("While {n} slept, {m} came.", "{m} came|during|{n} slept"),
    ("{n} came. Previously, {m} left.", "{m} left|before|{n} came"),
    ("If {n} left then {m} came.", None),
    ("{n} left before noon.", None),
)


@register(f"SELECT key, said FROM (SELECT c_custkey AS key, replace(replace({sql_list((w or '') for _, w in ORDERS)}[(c_custkey % 8 + 1)::INTEGER], '{{n}}', 'a' || c_custkey), '{{m}}', 'b' || c_nationkey) AS said FROM customer) WHERE said <> ''")
def text_orderings(spark, sf_dir):
    frame = F.element_at(F.array(*[F.lit(f) for f, _ in ORDERS]), (F.col("c_custkey") % 8 + 1).cast("int"))
    t = F.replace(F.replace(frame, F.lit("{n}"), said("A", num("c_custkey"))), F.lit("{m}"), said("b", num("c_nationkey")))
    got = extraction.ordering_facts(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), t.alias("text")))
    return got.select("key", F.concat_ws("|", "subject", "relation", "object").alias("said"))


@register("SELECT c_custkey AS key, unnest(['a' || c_custkey || ' runs', 'b' || c_nationkey || ' sleeps', 'it rains']) AS clause FROM customer")
def text_clauses(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), said("A", num("c_custkey"), " runs, but b", num("c_nationkey"), " sleeps because it rains.").alias("t"))
    return rows.select("key", F.explode(extraction.clauses(F.col("t"))).alias("clause"))


@register("SELECT c_custkey AS key, unnest([0, 1]) AS n, 'ann' || c_custkey AS subject, unnest(['met', 'saw']) AS relation, unnest(['bob', 'rome']) AS object FROM customer")
def text_pronouns(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    rows = c.select("key", F.inline(F.array(*[F.struct(F.lit(n).alias("n"), s.alias("subject"), F.lit(r).alias("relation"), F.lit(o).alias("object")) for n, s, r, o in ((0, said("ann", num("key")), "met", "bob"), (1, F.lit("she"), "saw", "rome"), (2, F.lit("this"), "shows", "much"))])))
    rows = rows.withColumn("subject", F.when(F.col("subject") == "she", "he").otherwise(F.col("subject")))
    return extraction.resolved(rows, extraction.pronoun_map(rows))


@register("SELECT p_partkey AS key, lower(p_name) AS subject, 'made_of' AS relation, CASE p_partkey % 3 WHEN 0 THEN lower(p_name) WHEN 1 THEN 'a b c d e f' ELSE 'steel' END AS object, CASE p_partkey % 3 WHEN 0 THEN 'same' WHEN 1 THEN 'object' END AS wrong FROM part")
def teach_checks(spark, sf_dir):
    k = F.col("p_partkey") % 3
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), said(" ", F.col("p_name")).alias("subject"), F.lit("Made  of").alias("relation"), F.when(k == 0, F.col("p_name")).when(k == 1, "a b c d e f").otherwise("Steel").alias("object"))
    return extraction.taught(p).select("key", "subject", "relation", "object", "wrong")


@register("SELECT unnest(['en', 'xx']) AS code, 'English' AS name, " + str(len(languages.STOP_WORDS)) + " AS stop_words, " + str(len(languages.get("en").connectives)) + " AS connectives, 'after' AS after")
def language_tables(spark, sf_dir):
    import warnings

    rows = []
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for code in ("en", "xx"):
            x = languages.get(code)
            rows.append((code, x.name, len(x.stop_words), len(x.connectives), x.connectives["after"].relation))
    return spark.createDataFrame(rows, "code string, name string, stop_words int, connectives int, after string")


# --- constraints: every named one by enumeration

ABC = {v: range(0, 5) for v in "abc"}
BITS = {v: range(0, 2) for v in "abc"}
NAMED = {
    "all_different": (ABC, {"type": "all_different", "subjects": list("abc")}, "a <> b AND b <> c AND a <> c"),
    "ordered": (ABC, {"type": "ordered", "subjects": list("abc"), "order": "descending"}, "a > b AND b > c"),
    "bounded": (ABC, {"type": "bounded", "subjects": list("ab"), "min": 1, "max": 3}, "a BETWEEN 1 AND 3 AND b BETWEEN 1 AND 3"),
    "excluded": (ABC, {"type": "excluded", "subjects": ["b"], "exclude_value": 2}, "b <> 2"),
    "grouped": (ABC, {"type": "grouped", "subjects": [], "groups": [["a", "b"], ["c"]], "limit": 3}, "a + b <= 3 AND c <= 3"),
    "sum_eq": (ABC, {"type": "sum_eq", "subjects": list("abc"), "target": 7}, "a + b + c = 7"),
    "sum_leq": (ABC, {"type": "sum_leq", "subjects": list("abc"), "limit": 4}, "a + b + c <= 4"),
    "sum_geq": (ABC, {"type": "sum_geq", "subjects": list("abc"), "limit": 9}, "a + b + c >= 9"),
    "count": (BITS, {"type": "count", "subjects": list("abc"), "condition": "geq", "target": 2}, "a + b + c >= 2"),
    "ratio": (ABC, {"type": "ratio", "subjects": ["a", "b"], "ratio": 2}, "a = 2 * b"),
    "implies": (BITS, {"type": "implies", "subjects": list("abc")}, "a <= b AND b <= c"),
    "equivalent": (ABC, {"type": "equivalent", "subjects": list("abc")}, "a = b AND b = c"),
    "at_least": (BITS, {"type": "at_least", "subjects": list("abc"), "n": 2}, "a + b + c >= 2"),
    "at_most": (BITS, {"type": "at_most", "subjects": list("abc"), "n": 1}, "a + b + c <= 1"),
    "exactly": (BITS, {"type": "exactly", "subjects": list("abc"), "n": 2}, "a + b + c = 2"),
    "no_overlap": (ABC, {"type": "no_overlap", "subjects": list("abc"), "duration": 2}, "abs(a - b) >= 2 AND abs(b - c) >= 2 AND abs(a - c) >= 2"),
    "precedence": (ABC, {"type": "precedence", "subjects": list("abc"), "min_gap": 2}, "a + 2 <= b AND b + 2 <= c"),
}


def constraint(name: str, domains: dict, primitive: dict, where: str) -> None:
    def run(spark, sf_dir):
        return solver.satisfy(spark, domains, [primitive])

    run.__name__ = f"solver_{name}"
    n = len(domains["a"])
    register(f"SELECT a.x AS a, b.x AS b, c.x AS c FROM range({n}) a(x), range({n}) b(x), range({n}) c(x) WHERE " + "".join(f"{ch}.x" if ch in "abc" and (i == 0 or not where[i - 1].isalnum()) and not where[i + 1 : i + 2].isalnum() else ch for i, ch in enumerate(where)))(run)


for _name, (_domains, _primitive, _where) in NAMED.items():
    if _name != "all_different":
        constraint(_name, _domains, _primitive, _where)


@register("SELECT a.x AS a, b.x AS b, c.x AS c FROM range(5) a(x), range(5) b(x), range(5) c(x) WHERE a.x + b.x + c.x = 8 ORDER BY least(a.x, b.x, c.x) DESC, a.x, b.x, c.x LIMIT 1")
def solver_optimized(spark, sf_dir):
    return solver.satisfy(spark, ABC, [{"type": "sum_eq", "subjects": list("abc"), "target": 8}, {"type": "optimized", "subjects": list("abc")}])


@register("SELECT * FROM (VALUES ('all_different', 'x,y,z'), ('ordered', 'x,y,z'), ('sum_eq', 'x,y,z'), ('at_least', 'x,y,z')) t(kind, subjects)")
def solver_inferred(spark, sf_dir):
    e = [("x", "x 12"), ("y", "y"), ("z", "z")]
    r = [("x", "different", "y"), ("y", "distinct", "z"), ("x", "before", "y"), ("y", "before", "z"), ("x", "total", "y"), ("x", "at_least", "2")]
    return spark.createDataFrame([(p["type"], ",".join(p["subjects"])) for p in solver.inferred(e, r)], "kind string, subjects string")


@register("SELECT * FROM (VALUES ('order', 'b,a,c'), ('cycle', ''), ('groups', 'a,b,c;d,e'), ('bounds', '0-240'), ('total', '120'), ('count', '3'), ('budget', 'a=40,b=40,c=40'), ('unsat', 'No solution exists -- constraints are contradictory.')) t(what, value)")
def solver_readings(spark, sf_dir):
    ent = [("a", "a 120"), ("b", "b")]
    unsat = solver.satisfy(spark, ABC, [{"type": "sum_eq", "subjects": list("abc"), "target": 99}]).first()
    b = solver.budget(120, {"a": 10, "b": 20, "c": 0})
    rows = [
        ("order", ",".join(solver.order_of([("b", "a"), ("a", "c")]))), ("cycle", ",".join(solver.order_of([("a", "b"), ("b", "a")]))),
        ("groups", ";".join(",".join(g) for g in solver.groups_of([("a", "b"), ("d", "e"), ("b", "c")]))), ("bounds", "{min}-{max}".format(**solver.bounds_of(ent))),
        ("total", str(solver.total_of(ent))), ("count", str(solver.count_of([("x", "at least 3")]))), ("budget", ",".join(f"{k}={v}" for k, v in b.items())), ("unsat", solver.formatted(unsat, ABC, [])["formatted"]),
    ]
    return spark.createDataFrame(rows, "what string, value string")


@register("WITH p AS (SELECT p_name n, p_size w, (floor(p_retailprice)::INTEGER % 50 + 1) v FROM part ORDER BY p_partkey LIMIT 12), s AS (SELECT b.x b, sum(v) v, sum(w) w FROM range(4096) b(x) JOIN (SELECT *, row_number() OVER (ORDER BY n) - 1 i FROM p) q ON (b.x >> q.i) & 1 = 1 GROUP BY b.x) SELECT max(v)::BIGINT AS value FROM s WHERE w <= 60")
def solver_knapsack(spark, sf_dir):
    """A dozen parts (the feature needs a small set): the most value within 60."""
    items = table(spark, sf_dir, "part").orderBy("p_partkey").limit(12).select(F.col("p_name").alias("name"), (F.floor("p_retailprice").cast("int") % 50 + 1).alias("value"), F.col("p_size").alias("weight"))
    return solver.knapsack(items, 60).select("value")


# --- time

ALLEN = "(VALUES " + ", ".join(f"('{r}', '{i}', {str(r in intervals.TRANSITIVE).lower()})" for r, i in intervals.INVERSE.items()) + ") t(relation, inverse, transitive)"


@register(f"SELECT relation, inverse, transitive, relation = 'equals' AS symmetric, relation <> 'equals' AS asymmetric, relation AS mapped FROM {ALLEN}")
def allen_properties(spark, sf_dir):
    r = F.col("relation")
    rows = spark.createDataFrame([(x,) for x in intervals.INVERSE], "relation string")
    return rows.select("relation", intervals.inverse(r).alias("inverse"), intervals.is_transitive(r).alias("transitive"), intervals.is_symmetric(r).alias("symmetric"), intervals.is_asymmetric(r).alias("asymmetric"), intervals.as_relation(F.upper(r)).alias("mapped"))


@register("SELECT event_id, event_id % 3 <> 0 OR event_id % 2 = 0 AS dated, event_id % 3 <> 0 AND event_id % 2 = 0 AS interval FROM events")
def interval_predicates(spark, sf_dir):
    k = F.col("event_id")
    a, b = F.when(k % 3 != 0, 1), F.when(k % 2 == 0, 2)
    return table(spark, sf_dir, "events").select("event_id", intervals.has_years(a, b).alias("dated"), intervals.is_interval(a, b).alias("interval"))


def dated_facts(spark, sf_dir):
    """Nations in a row, each before the next, with years for the even ones alone."""
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation")
    years = F.when(k % 4 == 0, 1900 + k * 10)
    return n.select(said("n", num("n_nationkey")).alias("subject"), F.lit("before").alias("relation"), said("n", (k + 1).cast("string")).alias("object"), years.cast("int").alias("t_start"), (years + 5).cast("int").alias("t_end"), k.cast("long").alias("seq"))


@register("SELECT 'n' || a AS a, 'n' || b AS b, r AS relation, CASE WHEN a % 4 = 0 AND b % 4 = 0 THEN r = 'before' WHEN b - a BETWEEN 2 AND 6 AND r = 'before' THEN true END AS answer, CASE WHEN a % 4 = 0 AND b % 4 = 0 THEN 0.9 WHEN b - a BETWEEN 2 AND 6 AND r = 'before' THEN 0.75 ELSE 0 END::DOUBLE AS confidence, CASE WHEN a % 4 = 0 AND b % 4 = 0 THEN 'direct' WHEN b - a BETWEEN 2 AND 6 AND r = 'before' THEN 'derived' ELSE 'unknown' END AS method FROM (SELECT n_nationkey a, n_nationkey + d b, r FROM nation, (VALUES (1), (2), (4)) t(d), (VALUES ('before'), ('after')) u(r) WHERE n_nationkey + d <= 24)")
def temporal_query(spark, sf_dir):
    k = F.col("n_nationkey")
    pairs = table(spark, sf_dir, "nation").select(k, F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))).alias("d"), F.lit("x")).filter(k + F.col("d") <= 24)
    rows = pairs.select(said("N", num("n_nationkey")).alias("a"), said("n", (k + F.col("d")).cast("string")).alias("b"), F.explode(F.array(F.lit("Before"), F.lit("after"))).alias("relation"))
    return temporal.query(dated_facts(spark, sf_dir), rows, intervals.composition(spark))


@register("SELECT 'n' || (n_nationkey + s) AS name, 'n' || (n_nationkey + 1 - s) AS other, CASE s WHEN 0 THEN 'before' ELSE 'after' END AS relation, (1900 + n_nationkey * 10)::INTEGER AS t_start, (1905 + n_nationkey * 10)::INTEGER AS t_end FROM nation, (VALUES (0), (1)) t(s) WHERE n_nationkey % 4 = 0")
def temporal_intervals_of(spark, sf_dir):
    f = dated_facts(spark, sf_dir)
    return temporal.intervals_of(f, f.select(F.col("subject").alias("name")).union(f.select("object")).distinct())
