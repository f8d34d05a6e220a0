"""Facts out of text: sentences and clauses, statements, orders of events, pronouns, and what may be taught. Column expressions
over tables of texts; there is no parser of syntax, so clauses are cut at connectives, not at verbs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica import languages
from lattica.functions import text as tx


def sentences_of(texts: DataFrame) -> DataFrame:
    """(key, n, sentence): the sentences of rows (key, text), numbered from 0."""
    parts = F.filter(F.transform(F.split("text", r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")
    return texts.select("key", F.posexplode(parts).alias("n", "sentence"))


def clauses(sentence: Column) -> Column:
    """array<string>: the clauses of a sentence, cut at commas and semicolons before a conjunction or adverb, and at and, but, or, because, which."""
    low = F.regexp_replace(F.lower(sentence), r"[.!?]+\s*$", "")
    marked = F.regexp_replace(low, r"\s*[;,]\s+(?:and|but|or|so|yet|which|who|because|while|then|after|before)\s+|\s*;\s*|\s+(?:but|because|which)\s+|\s+and\s+then\s+", tx.BREAK)
    return F.filter(F.transform(F.split(marked, tx.BREAK), lambda c: F.trim(c)), lambda c: c != "")


def facts_of(texts: DataFrame) -> DataFrame:
    """(key, n, subject, relation, object): what the sentences of rows (key, text) state. A sentence of which the statements are found
    whole gives those; else its clauses are read one by one. Repeats within a text go."""
    s = sentences_of(texts)
    whole = tx.statements(F.regexp_replace("sentence", r"[.!?]+\s*$", ""))
    each = F.flatten(F.transform(clauses(F.col("sentence")), lambda c: tx.statements(c)))
    found = s.select("key", "n", F.when(F.size(clauses(F.col("sentence"))) > 1, each).otherwise(whole).alias("f"))
    rows = found.select("key", "n", F.explode("f").alias("f")).select("key", "n", *[tx.entity_name(F.col("f.subject")).alias("subject"), F.col("f.relation").alias("relation"), tx.entity_name(F.col("f.object")).alias("object")])
    return rows.filter("subject <> '' and object <> '' and subject <> object").groupBy("key", "subject", "relation", "object").agg(F.min("n").alias("n")).select("key", "n", "subject", "relation", "object")


def orderings(texts: DataFrame, lang: str = "en") -> DataFrame:
    """(key, n, first, relation, second, connective): events that connectives of time put in order.

    'After A, B' and 'B after A': A stands before B; 'A before B' the same; 'A and then B' and a sentence that opens with such an
    adverb follow what stands before; other connectives give the relation of their table. A then in a sentence with a condition
    orders nothing."""
    language = languages.get(lang)
    con = language.connectives
    adverbs = sorted([w for w, c in con.items() if c.role == "adverb"], key=len, reverse=True)
    openers = sorted([w for w, c in con.items() if c.role != "adverb"], key=len, reverse=True)
    rel = F.create_map(*[F.lit(x) for w, c in con.items() for x in (w, c.relation)])
    s = sentences_of(texts).withColumn("low", F.regexp_replace(F.lower("sentence"), r"[.!?]+\s*$", ""))
    s = s.withColumn("before", F.lag("low").over(Window.partitionBy("key").orderBy("n")))
    event = lambda c: F.trim(F.regexp_replace(c, r"^(?:and|but|so)\s+|[,;]\s*$", ""))
    row = lambda a, r, b, w: F.struct(event(a).alias("first"), r.alias("relation"), event(b).alias("second"), w.alias("connective"))
    get = lambda p, i: F.regexp_extract("low", p, i)
    adv, opn = "|".join(adverbs), "|".join(openers)
    # an opener in front: Opener A, B
    front = rf"^({opn})\s+([^,]+),\s*(.+)$"
    inner = rf"^(.+?[^,]),?\s+({opn})\s+([^,]+)$"
    joined = rf"^(.+?),?\s+(?:and\s+)?({adv})\s+(.+)$"
    lead = rf"^({adv})\b,?\s+(.+)$"

    def placed(w: Column, sub: Column, main: Column) -> Column:
        """sub is the clause that w opens; main the other: how main stands to sub is the table's relation."""
        r = F.element_at(rel, w)
        return F.when(r == "after", row(sub, F.lit("before"), main, w)).otherwise(row(main, r, sub, w))

    conditional = F.rlike("low", F.lit(rf"\b(?:{'|'.join(language.conditional_markers)})\b"))
    barred = conditional & get(joined, 2).isin([w for w, c in con.items() if c.conditional])
    lone = lambda c: F.rlike(c, F.lit(rf"^(?:the\s+)?(?:{'|'.join(language.time_nouns)})$"))
    w_lead = get(lead, 1)
    sequence = F.when(F.element_at(rel, w_lead) == "after", row(get(lead, 2), F.lit("before"), F.col("before"), w_lead)).otherwise(row(F.col("before"), F.element_at(rel, w_lead), get(lead, 2), w_lead))
    w_in = get(joined, 2)
    chained = F.when(F.element_at(rel, w_in) == "after", row(get(joined, 3), F.lit("before"), get(joined, 1), w_in)).otherwise(row(get(joined, 1), F.element_at(rel, w_in), get(joined, 3), w_in))
    found = (
        F.when(F.rlike("low", F.lit(front)), placed(get(front, 1), get(front, 2), get(front, 3)))
        .when(F.rlike("low", F.lit(lead)) & F.col("before").isNotNull(), sequence)
        .when(F.rlike("low", F.lit(joined)) & ~F.rlike("low", F.lit(lead)) & ~barred, chained)
        .when(F.rlike("low", F.lit(inner)) & ~lone(get(inner, 3)), placed(get(inner, 2), get(inner, 3), get(inner, 1)))
    )
    return s.select("key", "n", found.alias("f")).filter("f is not null").select("key", "n", "f.first", "f.relation", "f.second", "f.connective").filter("first <> '' and second <> ''")


def ordering_facts(texts: DataFrame, lang: str = "en") -> DataFrame:
    """(key, subject, relation, object) of `orderings`."""
    return orderings(texts, lang).select("key", F.col("first").alias("subject"), "relation", F.col("second").alias("object"))


def pronoun_map(facts: DataFrame, lang: str = "en") -> DataFrame:
    """(key, n, pronoun, name): for facts (key, n, subject, ..) whose subject is a pronoun the last subject before that is none."""
    pronouns = list(languages.get(lang).pronouns)
    named = F.when(~F.col("subject").isin(pronouns), F.col("subject"))
    past = F.last(named, True).over(Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    return facts.withColumn("name", past).filter(F.col("subject").isin(pronouns) & F.col("name").isNotNull()).select("key", "n", F.col("subject").alias("pronoun"), "name").distinct()


def resolved(facts: DataFrame, pronouns: DataFrame, lang: str = "en") -> DataFrame:
    """facts (key, n, subject, relation, object) with pronouns as the names of pronouns (key, n, pronoun, name); facts in which this, that or
    it stand for what was said (before such a verb) are left out. Without any pronoun known, facts stay as they are."""
    language = languages.get(lang)
    stem = F.regexp_replace(F.split("relation", "_")[0], "(?:s|ed|ing)$", "")
    vague = (F.col("subject").isin("this", "that") & stem.isin(*language.deixis_verbs)) | ((F.col("subject") == "it") & stem.isin(*language.it_verbs))
    s = pronouns.select("key", "n", F.col("pronoun").alias("subject"), F.col("name").alias("_s"))
    o = pronouns.select("key", "n", F.col("pronoun").alias("object"), F.col("name").alias("_o"))
    out = facts.filter(~vague).join(s, ["key", "n", "subject"], "left").join(o, ["key", "n", "object"], "left")
    return out.select("key", "n", F.coalesce("_s", "subject").alias("subject"), "relation", F.coalesce("_o", "object").alias("object")).filter("subject <> object")


def taught(rows: DataFrame) -> DataFrame:
    """Rows (subject, relation, object) as they are taught, lower-cased and relations with underscores, each with `wrong`: null, or why it is
    refused (names have one to five words, differ, and relations two letters or more). Other columns stay with their rows."""
    tidy = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    n = lambda c: F.when(F.coalesce(F.length(c), F.lit(0)) == 0, 0).otherwise(F.size(F.split(c, " ")))
    others = [c for c in rows.columns if c not in ("subject", "relation", "object")]
    out = rows.select(*others, tidy("subject").alias("subject"), F.regexp_replace(tidy("relation"), " ", "_").alias("relation"), tidy("object").alias("object"))
    wrong = F.when(~n("subject").between(1, 5), "subject").when(~n("object").between(1, 5), "object").when(F.coalesce(F.length("relation"), F.lit(0)) < 2, "relation").when(F.col("subject") == F.col("object"), "same")
    return out.withColumn("wrong", wrong)


def entities_in(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(key, name, at): the names (name) that stand in texts (key, text) as whole words, and where; of names that overlap the longest, the first
    on ties. Texts are cut into word runs up to the longest name's number of words and joined by equality."""
    tokens = F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}_:]+", " "), " "), lambda w: w != "")
    plain = names.select(F.col("name").alias("name"), F.size(F.split("name", " ")).alias("w")).distinct()
    most = plain.agg(F.coalesce(F.max("w"), F.lit(1))).first()[0]
    rows = texts.select("key", tokens.alias("ws")).filter("size(ws) > 0")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda w: F.when(F.size("ws") >= w, F.transform(F.sequence(F.lit(0), F.size("ws") - w), lambda i: F.struct(i.alias("at"), w.alias("w"), F.array_join(F.slice("ws", i + 1, w), " ").alias("name")))).otherwise(F.array().cast("array<struct<at:int,w:int,name:string>>"))))
    hits = rows.select("key", F.explode(runs).alias("r")).select("key", "r.at", "r.w", "r.name").join(plain.select("name"), "name")
    longer = hits.select("key", F.col("at").alias("b"), F.col("w").alias("v"))
    over = (F.col("b") < F.col("at") + F.col("w")) & (F.col("at") < F.col("b") + F.col("v")) & ((F.col("v") > F.col("w")) | ((F.col("v") == F.col("w")) & (F.col("b") < F.col("at"))))
    kept = hits.alias("h").join(longer.alias("l"), (F.col("h.key") == F.col("l.key")) & over, "left_anti")
    return kept.select("key", "name", "at")
