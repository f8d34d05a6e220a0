"""Registered queries of vectors, memory, word vectors and senses, each with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import vectors
from lattica.operators import memory, wordvec
from lattica.queries import CONTENT, register, table

DIM = 64


def named_sql(name: str, dim: int = DIM) -> str:
    h = " || ".join(f"md5({name} || ':{k}')" for k in range(-(-dim // 32)))
    return f"list_transform(range(1, {dim + 1}), lambda at_: CASE WHEN substr({h}, at_, 1) >= '8' THEN -1 ELSE 1 END)"


def marks_sql(v: str) -> str:
    return f"array_to_string(list_transform({v}, lambda x: CASE WHEN x >= 0 THEN '+' ELSE '-' END), '')"


def marks(c):
    return F.concat_ws("", F.transform(c, lambda x: F.when(x >= 0, "+").otherwise("-")))


def signs(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", vectors.sign(F.col("embedding")).alias("v"))


@register(f"SELECT p_partkey AS k, {marks_sql(named_sql('p_name'))} AS v FROM part")
def vec_named(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), marks(vectors.named(F.col("p_name"), DIM)).alias("v"))


@register(
    "WITH q AS (SELECT p_partkey k, " + ", ".join(f"{named_sql(x)} {n}" for x, n in (("'brand'", "a"), ("p_brand", "b"), ("'type'", "c"), ("p_type", "d"), ("'name'", "e"), ("p_name", "f"))) + " FROM part) "
    f"SELECT k, {marks_sql('list_transform(range(1, 65), lambda i: a[i] * b[i] + c[i] * d[i] + e[i] * f[i])')} AS v FROM q"
)
def vec_record(spark, sf_dir):
    pair = lambda r, c: F.struct(F.lit(r).alias("role"), F.col(c).alias("filler"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), marks(vectors.record(F.array(pair("brand", "p_brand"), pair("type", "p_type"), pair("name", "p_name")), DIM)).alias("v"))


@register(
    f"WITH q AS (SELECT p_partkey k, {named_sql('p_brand')} a, {named_sql('p_type')} b, {named_sql('p_name')} c, " + named_sql("'_seq_identity'") + " s FROM part) "
    f"SELECT k, {marks_sql('list_transform(range(1, 65), lambda i: a[i] * s[i] + b[i] * s[(i + 62) % 64 + 1] + c[i] * s[(i + 61) % 64 + 1])')} AS v FROM q"
)
def vec_sequence(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), marks(vectors.ordered(F.array("p_brand", "p_type", "p_name"), DIM)).alias("v"))


@register("WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END) b FROM embeddings) SELECT vec_id, array_to_string(list_transform(range(1, 65), lambda i: (b[(i + 47) % 64 + 1] + b[(i + 15) % 64 + 1]) % 2), '') AS bits FROM q")
def vec_rule90(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.when(x >= 0, 1).otherwise(0)).alias("b"))
    return e.select("vec_id", F.concat_ws("", F.transform(vectors.rule90(F.col("b"), 16), lambda x: x.cast("string"))).alias("bits"))


@register("SELECT vec_id, 256::INTEGER AS width, true AS plain, true AS same FROM embeddings")
def vec_reservoir(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.when(x >= 0, 1).otherwise(0)).alias("b"))
    r, twice = vectors.reservoir(F.col("b")), vectors.reservoir(F.col("b"))
    return e.select("vec_id", r.alias("r"), twice.alias("t")).select("vec_id", F.size("r").alias("width"), F.forall("r", lambda x: x.isin(1, -1)).alias("plain"), (F.col("r") == F.col("t")).alias("same"))


@register(
    f"WITH q AS (SELECT p_partkey k, {named_sql('p_brand')} a, {named_sql('p_type')} b, {named_sql('p_name')} c FROM part), r AS (SELECT k, c, list_transform(range(1, 65), lambda i: CASE WHEN a[i] + b[i] >= 0 THEN 1 ELSE -1 END) ab FROM q) "
    f"SELECT k, {marks_sql('list_transform(range(1, 65), lambda i: ab[i] + c[i])')} AS v FROM r"
)
def vec_folded(spark, sf_dir):
    v = [vectors.named(F.col(c), DIM) for c in ("p_brand", "p_type", "p_name")]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), marks(vectors.folded(F.array(*v))).alias("v"))


@register("WITH p AS (SELECT label, vec_id % 3 - 1 w, unnest(range(1, 65)) i, unnest(embedding) x FROM embeddings), s AS (SELECT label, i, sum(w * CASE WHEN x >= 0 THEN 1 ELSE -1 END) s FROM p GROUP BY ALL) SELECT label, string_agg(CASE WHEN s >= 0 THEN '+' ELSE '-' END, '' ORDER BY i) AS v FROM s GROUP BY label")
def vec_weighted_bundle(spark, sf_dir):
    return vectors.bundled(signs(spark, sf_dir), ["label"], "v", F.col("vec_id") % 3 - 1).select("label", marks(F.col("v")).alias("v"))


@register(
    f"WITH q AS (SELECT p_partkey k, substr(p_type, 1, 2) t FROM part), c AS (SELECT k, t, {named_sql(chr(39) + '__char_' + chr(39) + ' || lower(substr(t, 1, 1))')} a, {named_sql(chr(39) + '__char_' + chr(39) + ' || lower(substr(t, 2, 1))')} b FROM q) "
    f"SELECT k, {marks_sql('list_transform(range(1, 65), lambda i: a[i] + b[(i + 62) % 64 + 1] + a[i] * b[(i + 62) % 64 + 1])')} AS v FROM c"
)
def vec_token(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), marks(vectors.token_vector(F.substring("p_type", 1, 2), DIM)).alias("v"))


PATTERNS = f"WITH e AS (SELECT vec_id i, label l, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE -1 END) v FROM embeddings), s AS (SELECT q.i q, e.i, e.l, list_dot_product(q.v::DOUBLE[], e.v::DOUBLE[]) / {DIM} c FROM e q JOIN e ON q.i % 20 = 0)"
WEIGHED = (
    f", g AS (SELECT *, 1.0 * (0.1 + 0.9 / (1 + exp(-100.0 * (c - 0.05)))) * c * {DIM} lg FROM s), w AS (SELECT *, exp(lg - max(lg) OVER (PARTITION BY q)) x, row_number() OVER (PARTITION BY q ORDER BY lg DESC, i DESC) r FROM g), "
    "z AS (SELECT *, x / sum(x) OVER (PARTITION BY q) y FROM w)"
)


def remembered(spark, sf_dir):
    e = signs(spark, sf_dir)
    new = e.select(F.col("vec_id").alias("seq"), F.col("v").alias("key"), vectors.named(F.col("vec_id").cast("string"), DIM).alias("value"), F.concat(F.lit("d"), F.col("label").cast("string")).alias("domain"))
    empty = spark.createDataFrame([], memory.PATTERN)
    return memory.stored(empty, new), e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("id"), F.col("v").alias("vec"))


@register(PATTERNS + WEIGHED + f" SELECT q AS query_id, i AS pattern_id, round(c, 6) AS sim, round(y, 6) AS weight, {marks_sql(named_sql('i::VARCHAR'))} AS value FROM z WHERE r <= 5 AND c >= 0.1")
def mem_retrieve_topk(spark, sf_dir):
    known, asked = remembered(spark, sf_dir)
    got = memory.retrieve(asked, known, 5, min_similarity=0.1)
    return got.select(F.col("id").alias("query_id"), F.col("idx").alias("pattern_id"), F.round("sim", 6).alias("sim"), F.round("weight", 6).alias("weight"), marks(F.col("value")).alias("value"))


@register(PATTERNS + ", x AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, i DESC) r FROM s WHERE i % 20 <> 0) SELECT q AS query_id, i AS pattern_id, round(c, 6) AS sim FROM x WHERE r = 1 AND c >= 0.3")
def mem_update(spark, sf_dir):
    """Once the queries' own patterns are superseded, by ones that say the opposite, each finds the best of the others."""
    known, asked = remembered(spark, sf_dir)
    far = asked.select(F.col("id").alias("seq"), F.transform("vec", lambda x: x * 0).alias("key"), F.col("vec").alias("value"), F.lit("moved").alias("domain"))
    now = memory.superseded(known, asked.select(F.col("id").alias("idx")), far)
    got = memory.retrieve(asked, now, 1, damped=False, min_similarity=0.3)
    return got.select(F.col("id").alias("query_id"), F.col("idx").alias("pattern_id"), F.round("sim", 6).alias("sim"))


@register("SELECT 'd' || label AS domain, count(*) AS n FROM embeddings WHERE vec_id % 20 <> 0 GROUP BY label UNION ALL SELECT 'moved', count(*) FROM embeddings WHERE vec_id % 20 = 0")
def mem_stats(spark, sf_dir):
    known, asked = remembered(spark, sf_dir)
    new = asked.select(F.col("id").alias("seq"), F.col("vec").alias("key"), F.col("vec").alias("value"), F.lit("moved").alias("domain"))
    return memory.stats(memory.superseded(known, asked.select(F.col("id").alias("idx")), new))


@register("SELECT count(*) AS patterns, count(*) FILTER (vec_id % 20 <> 0) AS active FROM embeddings")
def mem_counts(spark, sf_dir):
    known, asked = remembered(spark, sf_dir)
    return memory.counts(memory.superseded(known, asked.select(F.col("id").alias("idx")), spark.createDataFrame([], "seq long, key array<int>, value array<int>, domain string")))


@register("SELECT e.event_id, round(0.1 + 0.9 / (1 + exp(-100.0 * (value / 1000 - 0.05))), 9) AS beta FROM events e")
def mem_idp_beta(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(memory.beta_of(F.col("value") / 1000, 1.0, 100.0, 0.05), 9).alias("beta"))


@register("SELECT vec_id AS id, vec_id AS idx, 1.0::DOUBLE AS sim, true AS settled FROM embeddings WHERE vec_id % 20 = 0")
def mem_refine(spark, sf_dir):
    """Queries that are patterns, whose values are the patterns themselves, stay where they are."""
    known, asked = remembered(spark, sf_dir)
    same = known.groupBy("key").agg(*[F.min_by(c, "idx").alias(c) for c in ("idx", "domain", "active")]).withColumn("value", F.col("key"))  # of copies the first, each time
    same = same.select(*known.columns)
    whole = same.select("idx", "key").withColumnRenamed("idx", "k_idx")
    first = asked.join(whole, F.col("vec") == F.col("key")).select("id", "k_idx")
    got = memory.refine(asked, same)
    return got.join(first, "id").select("id", F.when(F.col("idx") == F.col("k_idx"), F.col("id")).alias("idx"), F.round("sim", 6).alias("sim"), (F.col("rounds") == 1).alias("settled"))


@register("SELECT vec_id AS id, a AS aspect FROM embeddings, (VALUES ('discover_entities'), ('discover_constraints'), ('find_solution'), ('validate_result')) t(a) WHERE vec_id % 20 = 0")
def mem_decompose(spark, sf_dir):
    known, asked = remembered(spark, sf_dir)
    return memory.decomposed(asked, known, DIM).select("id", "aspect")


# --- word vectors over all turns of the conversations

WD = 32
TURNS = "w AS (SELECT conv_id, turn, text, " + CONTENT.format(t="text") + " ws FROM conversations), t AS (SELECT row_number() OVER () s, ws FROM w WHERE len(ws) >= 2), o AS (SELECT s, unnest(ws) w FROM t), k AS (SELECT s, w, count(*) k FROM o GROUP BY ALL), "
ENV = f"v AS (SELECT w, unnest(range(1, {WD + 1})) i, unnest({named_sql('w', WD)}) x FROM (SELECT DISTINCT w FROM k)), "
MODEL = (
    TURNS + ENV + "tot AS (SELECT s, i, sum(k * x) t FROM k JOIN v USING (w) GROUP BY s, i), c AS (SELECT w, i, sum(k * (t - x)) c FROM k JOIN tot USING (s) JOIN v USING (w, i) GROUP BY w, i), "
    "m AS (SELECT w, list(CASE WHEN c + x >= 0 THEN 1.0::DOUBLE ELSE -1.0 END ORDER BY i) m FROM c JOIN v USING (w, i) GROUP BY w)"
)


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "text")


@register("WITH " + MODEL + " SELECT c.w AS word, (SELECT sum(k) FROM k WHERE k.w = c.w)::BIGINT AS freq, string_agg(c::BIGINT::VARCHAR, ',' ORDER BY i) AS ctx FROM c GROUP BY c.w")
def wordvec_train(spark, sf_dir):
    model = wordvec.train(turns(spark, sf_dir), WD)
    return model.select("word", "freq", F.concat_ws(",", F.transform("ctx", lambda x: x.cast("long").cast("string"))).alias("ctx"))


@register("WITH " + MODEL + " SELECT w AS word, " + marks_sql("m") + " AS mem FROM m")
def wordvec_memory(spark, sf_dir):
    model = wordvec.train(turns(spark, sf_dir), WD)
    return wordvec.memories(model, WD).select("word", marks(F.col("mem")).alias("mem"))


@register("WITH " + MODEL + " SELECT c.w AS word, (SELECT sum(k) FROM k WHERE k.w = c.w)::BIGINT AS freq, string_agg(c::BIGINT::VARCHAR, ',' ORDER BY i) AS ctx FROM c GROUP BY c.w")
def wordvec_incremental(spark, sf_dir):
    """Training on the odd turns, then on the even ones."""
    t = turns(spark, sf_dir)
    model = wordvec.merged(wordvec.train(t.filter("seq % 2 = 1"), WD), wordvec.train(t.filter("seq % 2 = 0"), WD))
    return model.select("word", "freq", F.concat_ws(",", F.transform("ctx", lambda x: x.cast("long").cast("string"))).alias("ctx"))


@register("WITH " + MODEL + f", p AS (SELECT DISTINCT ws[1] a, ws[2] b FROM t UNION SELECT ws[1], 'unheard' FROM t) SELECT a, b, coalesce(round(list_dot_product(x.m, y.m) / {WD}, 6), 0) AS sim FROM p LEFT JOIN m x ON x.w = a LEFT JOIN m y ON y.w = b")
def wordvec_similarity(spark, sf_dir):
    t = turns(spark, sf_dir)
    ws = wordvec.spoken(t).filter("size(ws) >= 2")
    pairs = ws.select(F.col("ws")[0].alias("a"), F.col("ws")[1].alias("b")).union(ws.select(F.col("ws")[0], F.lit("unheard"))).distinct()
    return wordvec.similarities(pairs, wordvec.train(t, WD), WD).select("a", "b", F.round("sim", 6).alias("sim"))


@register("WITH " + MODEL + f", a AS (SELECT DISTINCT ws[1] w FROM t WHERE len(ws[1]) = 5), s AS (SELECT x.w, y.w near, round(list_dot_product(x.m, y.m) / {WD}, 6) AS sim FROM m x JOIN a ON a.w = x.w JOIN m y ON x.w <> y.w) SELECT w AS word, near, sim, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY sim DESC, near) r FROM s) WHERE r <= 5")
def wordvec_neighbours(spark, sf_dir):
    """Of the five-letter words that open a turn, among all words."""
    t = turns(spark, sf_dir)
    asked = wordvec.spoken(t).filter("size(ws) >= 2").select(F.col("ws")[0].alias("word")).filter("length(word) = 5")
    return wordvec.neighbours(asked, wordvec.train(t, WD), WD, 5).select("word", "near", F.round("sim", 6).alias("sim"), "rank")


@register("WITH " + MODEL + f", u AS (SELECT conv_id * 1000 + turn AS key, unnest(ws) w FROM w), q AS (SELECT key, i, sum(x) t FROM (SELECT key, unnest(range(1, {WD + 1})) i, unnest(coalesce(m.m, {named_sql('u.w', WD)}::DOUBLE[])) x FROM u LEFT JOIN m ON m.w = u.w) GROUP BY key, i), f AS (SELECT key, string_agg(CASE WHEN t >= 0 THEN '+' ELSE '-' END, '' ORDER BY i) v FROM q GROUP BY key) "
          f"SELECT key, coalesce(v, {marks_sql(named_sql('key::VARCHAR', WD))}) AS vec FROM (SELECT conv_id * 1000 + turn AS key FROM conversations) LEFT JOIN f USING (key)")
def wordvec_encode(spark, sf_dir):
    t = turns(spark, sf_dir)
    got = wordvec.encoded(t.withColumnRenamed("seq", "key"), wordvec.train(t, WD), WD)
    return got.select("key", marks(F.col("vec")).alias("vec"))


@register("WITH " + TURNS + f"n AS (SELECT count(DISTINCT w) n FROM k) SELECT {WD} AS dim, n AS words, (SELECT count(*) FROM t) AS sentences, floor(n * {WD} / 1024)::BIGINT AS kb FROM n")
def wordvec_stats(spark, sf_dir):
    t = turns(spark, sf_dir)
    return wordvec.stats(wordvec.train(t, WD), t, WD)


@register()
def wordvec_clusters(spark, sf_dir):
    """Order-dependent clusters; the tests hold them against a plain loop."""
    return wordvec.sense_info(wordvec.clusters(turns(spark, sf_dir), WD))


@register("WITH " + TURNS + "x AS (SELECT w, count(DISTINCT s) n FROM o GROUP BY w) SELECT w AS word, n FROM x")
def wordvec_cluster_sizes(spark, sf_dir):
    """Every sentence of a word is in one of its clusters."""
    return wordvec.grouped(turns(spark, sf_dir), WD).groupBy("word").agg(F.sum("n").alias("n"))


@register()
def wordvec_senses(spark, sf_dir):
    """The sense of each turn's first content word; the tests hold it against a plain loop."""
    t = turns(spark, sf_dir)
    asked = wordvec.spoken(t).select(F.col("seq").alias("key"), F.get("ws", F.lit(0)).alias("word"), "ws")
    return wordvec.senses(asked, wordvec.grouped(t, WD), WD).filter("word is not null")


LEMMA = "CASE " + " ".join(f"WHEN {{w}} LIKE '%{e}' AND length({{w}}) - {len(e)} >= 3 THEN left({{w}}, length({{w}}) - {len(e)})" for e in wordvec.ENDINGS) + " ELSE {w} END"
FREE = "list_filter(" + CONTENT.format(t="text") + ", lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in wordvec.FRAME) + ", 'text'))"
GLOSS = f"d AS (SELECT doc_id, lang, {FREE} ws FROM documents), l AS (SELECT doc_id, lang, w, {LEMMA.format(w='w')} m FROM (SELECT doc_id, lang, unnest(ws) w FROM d)), s AS (SELECT lang, dense_rank() OVER (ORDER BY lang) - 1 sense FROM (SELECT DISTINCT lang FROM documents)), g AS (SELECT sense, word, count(*) cnt FROM (SELECT lang, w word FROM l UNION ALL SELECT lang, m FROM l) JOIN s USING (lang) GROUP BY ALL)"


def lesk_tables(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    langs = d.select("lang").distinct()
    from pyspark.sql import Window

    ranked = langs.withColumn("sense", (F.row_number().over(Window.orderBy("lang")) - 1).cast("int"))  # one row per language
    return d.join(F.broadcast(ranked), "lang").select("doc_id", F.lit("Text").alias("entity"), "sense", "text")


@register(f"WITH {GLOSS} SELECT sense, word, cnt FROM g")
def lesk_glosses(spark, sf_dir):
    """One sense per language, all documents its examples."""
    return wordvec.glosses(lesk_tables(spark, sf_dir)).select("sense", "word", "cnt")


@register(
    f"WITH {GLOSS}, t AS (SELECT doc_id, m word, count(*) tf FROM l GROUP BY ALL), h AS (SELECT doc_id, sense, sum(1 + 0.5 * least(tf, cnt)) score FROM t JOIN g USING (word) GROUP BY ALL), "
    "b AS (SELECT doc_id, sense, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sense) r FROM h) WHERE r = 1) "
    "SELECT d.doc_id AS key, CASE WHEN len(ws) = 0 THEN 0 ELSE coalesce(b.sense, -1) END::INTEGER AS sense, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN b USING (doc_id)"
)
def lesk_resolve(spark, sf_dir):
    rows = lesk_tables(spark, sf_dir)
    return wordvec.resolve(rows.select(F.col("doc_id").alias("key"), "entity", "text"), wordvec.glosses(rows))


@register(f"WITH {GLOSS} SELECT 'text' AS entity, max(sense) + 1 AS senses, (SELECT count(*) FROM g WHERE sense = 1) AS words FROM g")
def lesk_counts(spark, sf_dir):
    g = wordvec.glosses(lesk_tables(spark, sf_dir))
    words = wordvec.gloss_words(g, "Text", 1).agg(F.count("*").alias("words"))
    return wordvec.gloss_counts(g).join(F.broadcast(words), F.lit(True))
