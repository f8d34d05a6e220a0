"""Registered queries of encoders, routing, memory-based decisions, advice and decomposition, each with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica import schema
from lattica.functions import encoders, vectors
from lattica.operators import decisions, memory
from lattica.queries import register, table
from lattica.queries_words import DIM, marks, marks_sql, named_sql, remembered, signs

LOW = "lower(html)"
HTML_SQL = (
    "WITH p AS (SELECT page_id, lower(html) h, regexp_extract_all(lower(html), '<([\\p{L}\\p{N}_]+)', 1) t FROM pages), c AS (SELECT page_id, h, t, list_max(list_transform(list_distinct(t), lambda x: len(list_filter(t, lambda y: y = x)))) m FROM p), "
    "f AS (" + " UNION ALL ".join(
        [f"SELECT page_id, 'tag_{t}' k, len(list_filter(t, lambda y: y = '{t}')) / m::DOUBLE v FROM c WHERE list_contains(t, '{t}')" for t in encoders.TAGS]
        + [f"SELECT page_id, 'input_{t}', least(len(regexp_extract_all(h, 'type=[\"'']{t}[\"'']')) / 5.0, 1.0) FROM c WHERE regexp_matches(h, 'type=[\"'']{t}[\"'']')" for t in encoders.INPUTS]
        + ["SELECT page_id, unnest(['has_form', 'form_count']), unnest([1.0, least(len(regexp_extract_all(h, '<form')) / 3.0, 1.0)]) FROM c WHERE contains(h, '<form')",
           "SELECT page_id, unnest(['has_required_fields', 'required_count']), unnest([1.0, least(len(regexp_extract_all(h, 'required')) / 5.0, 1.0)]) FROM c WHERE contains(h, 'required')",
           "SELECT page_id, 'has_hidden_elements', 1.0 FROM c WHERE regexp_matches(h, 'display:none|hidden')", "SELECT page_id, 'has_visible_elements', 1.0 FROM c WHERE regexp_matches(h, 'display:block|display: flex')",
           "SELECT page_id, 'has_captcha', 1.0 FROM c WHERE contains(h, 'captcha')", "SELECT page_id, 'has_submit', 1.0 FROM c WHERE regexp_matches(h, 'type=[\"'']submit[\"'']|<button')"]
    ) + ")"
)


@register(HTML_SQL + " SELECT page_id, k AS feature, round(v::DOUBLE, 9) AS value FROM f")
def page_features(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(encoders.page_features(F.col("html"))).alias("feature", "value")).withColumn("value", F.round("value", 9))


@register(HTML_SQL + ", b AS (SELECT page_id, k, v, 0 + list_reduce(list_transform(range(0, 8), lambda i: ('0x' || substr(sha256(k), i * 8 + 1, 8))::BIGINT), lambda a, x: ((a % 200) * 96 + x) % 200) % 200 AS at_ FROM f), "
          "w AS (SELECT page_id, at_, row_number() OVER (PARTITION BY page_id, at_ ORDER BY k DESC) r, v FROM b) SELECT page_id, string_agg(at_::INTEGER::VARCHAR, ',' ORDER BY at_) AS places FROM w WHERE r = 1 AND v > 0.5 GROUP BY page_id")
def page_feature_bits(spark, sf_dir):
    """Where a page's bits are set; a place is sha256(name) modulo 200 (2^32 is 96 modulo 200)."""
    bits = encoders.feature_bits(encoders.page_features(F.col("html")))
    at = F.filter(F.transform(bits, lambda b, i: F.when(b == 1, i)), lambda x: x.isNotNull())
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.transform(at, lambda x: x.cast("string")), ",").alias("places")).filter("places <> ''")


@register("SELECT page_id, 256::INTEGER AS places, true AS plain FROM pages")
def page_vectors(spark, sf_dir):
    v = encoders.page_vector(F.col("html"), ["form", "login", "price"], 256)
    return table(spark, sf_dir, "pages").select("page_id", v.alias("v")).select("page_id", F.size("v").alias("places"), F.forall("v", lambda x: x.isin(1, -1)).alias("plain"))


def text_sql(column: str) -> str:
    out = column
    for t in ("script", "style", "nav", "footer", "header"):
        out = f"regexp_replace({out}, '<{t}[^>]*>.*?</{t}>', ' ', 'gsi')"
    return f"substr(trim(regexp_replace(regexp_replace(regexp_replace({out}, '<[^>]+>', ' ', 'gs'), '\\[(?:[0-9]+|edit|citation needed)\\]', ' ', 'g'), '\\s+', ' ', 'g')), 1, 5000)"


@register(f"SELECT page_id, {text_sql('html')} AS said FROM pages")
def page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", encoders.page_text(F.col("html")).alias("said"))


@register("SELECT event_id, 'a=number,b=valid,inner=string,c=entity,x=absent,d=multiple,e=multiple' AS said FROM events")
def json_encoding(spark, sf_dir):
    """Keys with the kinds of their values, nested ones before their parent's."""
    j = F.concat(F.lit('{"a": '), F.col("event_id").cast("string"), F.lit(', "b": true, "c": {"inner": "t"}, "d": [{"x": null}, 2], "e": [1]}'))
    pairs = encoders.json_pairs(j)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["role"], p["filler"])), ",").alias("said"))


def fold_sql(parts: list[str]) -> str:
    out = parts[0]
    for p in parts[1:]:
        out = f"list_transform(list_zip({out}, {p}), lambda z: CASE WHEN z[1] + z[2] >= 0 THEN 1 ELSE -1 END)"
    return out


def bound_sql(a: str, b: str) -> str:
    return f"list_transform(list_zip({named_sql(a)}, {named_sql(b)}), lambda y: y[1] * y[2])"


LEVEL = "CASE WHEN value >= 90 THEN 'critical' WHEN value >= 70 THEN 'high' WHEN value >= 30 THEN 'medium' ELSE 'low' END"


@register("SELECT event_id, " + marks_sql(fold_sql([bound_sql("'load'", LEVEL), bound_sql("'kind'", "event_type"), bound_sql("'user'", "'low'")])) + " AS v FROM events WHERE value IS NOT NULL")
def metric_encoding(spark, sf_dir):
    m = F.map_from_arrays(F.array(F.lit("load"), F.lit("kind"), F.lit("user")), F.array(F.col("value").cast("string"), F.col("event_type"), F.lit("1")))
    return table(spark, sf_dir, "events").filter("value is not null").select("event_id", marks(encoders.pairs_vector(encoders.metric_pairs(m), DIM)).alias("v"))


@register("WITH e AS (SELECT event_id, value / 100 r, CASE WHEN event_id % 2 = 0 THEN 0.5 END m, CASE WHEN event_id % 3 = 0 THEN 1.0 END z FROM events), c AS (SELECT event_id, CASE WHEN m IS NULL AND z IS NULL THEN r WHEN m IS NULL THEN 0.7 * r + 0.3 * z WHEN z IS NULL THEN (0.4 * r + 0.3 * m) / 0.7 ELSE 0.4 * r + 0.3 * m + 0.3 * z END c FROM e) "
          "SELECT event_id, round(c::DOUBLE, 6) AS confidence, CASE WHEN round(c::DOUBLE, 6) >= 0.9 THEN 'execute' WHEN round(c::DOUBLE, 6) >= 0.7 THEN 'confirm' ELSE 'escalate' END AS decision FROM c")
def decision_confidence(spark, sf_dir):
    k = F.col("event_id")
    c = F.round(encoders.confidence(F.col("value") / 100, F.when(k % 2 == 0, 0.5), F.when(k % 3 == 0, 1.0)), 6)
    return table(spark, sf_dir, "events").select("event_id", c.alias("confidence"), encoders.decision(c).alias("decision"))


@register("SELECT event_id, round(CASE event_id % 5 WHEN 0 THEN 0.95 WHEN 1 THEN 0.8 WHEN 2 THEN (CASE WHEN s >= 0.99 THEN 0.95 WHEN s >= 0.9 THEN 0.85 WHEN s >= 0.8 THEN 0.75 WHEN s >= 0.7 THEN 0.65 WHEN s >= 0.6 THEN 0.55 WHEN s >= 0.5 THEN 0.45 WHEN s >= 0.4 THEN 0.35 WHEN s >= 0.3 THEN 0.3 ELSE 0.2 END) WHEN 3 THEN 0.7 ELSE (CASE WHEN s > 0.5 THEN least(s * 0.7, 0.7) WHEN s > 0.3 THEN least(s * 0.5, 0.4) ELSE 0.2 END) END::DOUBLE, 6) AS confidence, event_id % 2 = 0 AS teach FROM (SELECT event_id, (event_id % 100) / 100.0 s FROM events)")
def answer_confidence(spark, sf_dir):
    k = F.col("event_id")
    kind = F.when(k % 5 == 0, "unsat").when(k % 5 == 1, "generic_csp").when(k % 5 == 2, "learned").when(k % 5 == 3, "meta")
    s = (k % 100) / 100
    c = encoders.answer_confidence(kind, s, F.array(F.lit("ordered"), F.lit("bounded")), s)
    return table(spark, sf_dir, "events").select("event_id", F.round(c, 6).alias("confidence"), encoders.needs_teaching(F.lit(0.5), F.when(k % 2 == 0, 0).otherwise(5)).alias("teach"))


@register("WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) v, list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) / 64 m FROM embeddings) SELECT vec_id, array_to_string(list_transform(v, lambda x: greatest(-1, least(1, round_even(x / m, 0)))::INTEGER), ',') AS t FROM q")
def ternary_weights(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return e.select("vec_id", F.array_join(F.transform(encoders.ternary(F.col("v")), lambda x: x.cast("string")), ",").alias("t"))


def labelled(spark, sf_dir):
    """Examples whose labels follow from their vectors: the places at which a domain's, a task's and a strategy's marks stand."""
    e = signs(spark, sf_dir).select("vec_id", "v")
    at = lambda names, k: F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(F.col("vec_id") + k, F.lit(len(names))) + 1).cast("int"))
    task = F.element_at(F.create_map(*[x for d in decisions.DOMAINS for x in (F.lit(d), F.element_at(F.array(*[F.lit(t) for t in decisions.TASKS[d]]), (F.pmod(F.col("vec_id"), F.lit(4)) + 1).cast("int")))]), F.col("domain"))
    rows = e.withColumn("domain", at(decisions.DOMAINS, 0)).withColumn("task", task).withColumn("strategy", at(decisions.STRATEGIES, 1))
    three = F.array(*[vectors.named(F.concat(F.lit(p), F.col(c)), DIM) for p, c in (("d", "domain"), ("t", "task"), ("s", "strategy"))])
    return rows.select("vec_id", vectors.sign(vectors.total(three, DIM)).alias("vec"), "domain", "task", "strategy")


@register("SELECT vec_id, true AS domain, true AS strategy, true AS sure FROM embeddings")
def routing(spark, sf_dir):
    """Routers trained on labelled vectors send every one of them to its own domain and strategy."""
    rows = labelled(spark, sf_dir)
    r = decisions.Router(DIM, quantised=False)
    r.train(rows, 300)
    got = r.route(rows.select("vec_id", "vec", F.col("domain").alias("d"), F.col("strategy").alias("s")))
    return got.select("vec_id", (F.col("d") == F.col("domain")).alias("domain"), (F.col("s") == F.col("strategy")).alias("strategy"), (F.col("routed") > 0).alias("sure"))


@register("SELECT vec_id AS key, true AS known, 'escalate' AS lone FROM embeddings WHERE vec_id % 20 = 0")
def decisions_made(spark, sf_dir):
    known, asked = remembered(spark, sf_dir)
    r = decisions.Router(DIM)
    rows = asked.select(F.col("id").alias("key"), "vec")
    got = decisions.decided(rows, known, r)
    lone = decisions.decided(rows, known.limit(0), r).select("key", F.col("decision").alias("lone"))
    return got.join(lone, "key").select("key", F.col("idx").isNotNull().alias("known"), "lone")


@register("SELECT 'd' || label AS domain, count(*) AS n FROM embeddings GROUP BY label UNION ALL SELECT 'seen', count(*) FROM embeddings WHERE vec_id % 3 <> 1")
def learning_outcomes(spark, sf_dir):
    known, _ = remembered(spark, sf_dir)
    how = F.when(F.col("vec_id") % 3 == 0, "success").when(F.col("vec_id") % 3 == 1, "failure").otherwise("partial")
    new = signs(spark, sf_dir).select(F.col("vec_id").alias("seq"), F.col("v").alias("key"), F.col("v").alias("value"), F.lit("seen").alias("domain"), how.alias("outcome"))
    return memory.stats(decisions.learned(known, new))


@register("WITH e AS (SELECT vec_id i, label l, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE -1 END) v FROM embeddings), g AS (SELECT DISTINCT a.i FROM e a JOIN e b ON b.i % 50 = 0 AND list_dot_product(a.v::DOUBLE[], b.v::DOUBLE[]) / 64 >= 0.9) SELECT 'd' || l AS domain, count(*) AS n FROM e WHERE i NOT IN (SELECT i FROM g) GROUP BY l UNION ALL SELECT 'right', count(*) FROM e WHERE i % 50 = 0")
def learning_corrections(spark, sf_dir):
    """Corrections supersede all patterns like theirs."""
    known, _ = remembered(spark, sf_dir)
    new = signs(spark, sf_dir).filter("vec_id % 50 = 0").select(F.col("vec_id").alias("seq"), F.col("v").alias("key"), F.col("v").alias("value"), F.lit("right").alias("domain"))
    return memory.stats(decisions.corrected(known, new, 0.9))


@register("SELECT p_partkey AS k, " + marks_sql(fold_sql([bound_sql("'action'", "p_brand"), bound_sql("'action'", "p_type")])) + " AS v FROM part")
def plan_vectors(spark, sf_dir):
    step = lambda c: F.array(F.struct(F.lit("action").alias("role"), F.col(c).alias("filler")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), marks(decisions.plan_vector(F.array(step("p_brand"), step("p_type")), DIM)).alias("v"))


STRATEGY = "id string, title string, description string, tags array<string>, effectiveness double, query_prototypes array<string>"


def strategies(spark):
    return spark.createDataFrame([
        ("a", "Time boxes", "Work in short boxes of time", ["focus", "time"], 0.8, ["how do I keep my focus"]), ("b", "Small steps", "Cut large tasks", ["task"], 0.6, ["this task is too large"]),
        ("c", "Sleep", "Rest before learning", ["rest", "focus"], 0.5, None),
    ], STRATEGY)


@register("SELECT c_custkey AS key, unnest(['a', 'c']) AS id, unnest([1, 2]) AS rank, unnest([1.8, 1.5])::DOUBLE AS score FROM customer")
def advice(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit("how do I keep my focus").alias("text"), F.array(F.lit("focus?")).alias("goals"))
    return decisions.advised(rows, strategies(spark), 256).select("key", "id", "rank", F.round("score", 6).alias("score"))


@register("SELECT conv_id, turn, contains(lower(text), 'find') AND regexp_matches(lower(text), 'cheapest|price|flight|hotel') OR regexp_matches(lower(text), '" + "|".join(decisions.OUTSIDE) + "') AS outside, len(regexp_extract_all(text, '\\b(\\d+)\\b')) AS numbers FROM conversations")
def outside_questions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", decisions.needs_outside(F.col("text")).alias("outside"), F.size(decisions.amounts(F.col("text"))["numbers"]).cast("long").alias("numbers"))


@register("SELECT p_partkey AS key, ['debug', 'focus', 'schedule', 'budget'][(p_partkey % 4 + 1)::INTEGER] AS kind FROM part")
def advice_kinds(spark, sf_dir):
    said = F.element_at(F.array(F.lit("a Bug in code"), F.lit("cannot concentrate on my task"), F.lit("schedule the day"), F.lit("allocate money")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), decisions.advice_kind(said).alias("kind"))


@register("SELECT p_partkey AS key, ['sorting', 'debugging', 'comparison'][(p_partkey % 3 + 1)::INTEGER] AS prototype, 1::INTEGER AS rank FROM part")
def prototype_matches(spark, sf_dir):
    said = F.element_at(F.array(*[F.lit(decisions.PROTOTYPES[k]) for k in ("sorting", "debugging", "comparison")]), (F.col("p_partkey") % 3 + 1).cast("int"))
    got = decisions.prototype_matches(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), said.alias("text")), 256, 1)
    return got.select("key", "prototype", "rank")


@register("SELECT count(*) AS problems, format('{:.1f}', 100.0 * count(*) FILTER (p_partkey % 2 = 0) / count(*)) AS memory, format('{:.1f}', 100.0 * count(*) FILTER (p_partkey % 2 = 1) / count(*)) AS steps, '0.0' AS leaf FROM part")
def decomposition(spark, sf_dir):
    known = spark.createDataFrame([(0, "arrange items by a key", "use sort")], "seq long, text string, solution string")
    said = F.when(F.col("p_partkey") % 2 == 0, "arrange items by a key").otherwise(decisions.PROTOTYPES["debugging"])
    got = decisions.problem_steps(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), said.alias("text")), 256, known)
    return decisions.rates(got)


@register("SELECT 'r' || label AS relation, 'r' || label AS canonical, 1::INTEGER AS size FROM (SELECT DISTINCT label FROM embeddings)")
def relation_clusters(spark, sf_dir):
    """Vectors of their own names are far from alike: every relation is a group."""
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("r"), F.col("label").cast("string")).alias("relation")).distinct()
    return decisions.relation_clusters(rows.select("relation", vectors.named(F.col("relation"), 256).alias("vec")), 256)


@register("WITH e AS (SELECT vec_id i, list_transform(embedding, lambda x: x::DOUBLE) v FROM embeddings) SELECT a.i::VARCHAR AS relation, b.i::VARCHAR AS other, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 6) AS sim FROM e a JOIN e b ON a.i <> b.i WHERE a.i % 20 = 0 AND list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.7")
def relation_similar(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("relation"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return decisions.synonyms(e.filter("cast(relation as long) % 20 = 0"), e).select("relation", "other", F.round("sim", 6).alias("sim"))


@register("SELECT * FROM (VALUES ('city', 'place', true), ('place', 'city', true), ('city', 'person', false), ('composer', 'composition', true), ('cat', 'cat', true), ('car', 'cart', false)) t(a, b, ok)")
def type_matches(spark, sf_dir):
    rows = spark.createDataFrame([("city", "place"), ("place", "city"), ("city", "person"), ("composer", "composition"), ("cat", "cat"), ("car", "cart")], "a string, b string")
    return decisions.type_matches(rows, schema.subsumption(spark))
