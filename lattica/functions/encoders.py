"""Pages, JSON values and metrics as features and vectors; confidences and decisions; routing on stated rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.text import level
from lattica.functions.vectors import bind, bundle, folded, let, named, reservoir

# Tags and input types that count, and marks of a page.
TAGS = ("div", "span", "form", "input", "button", "a", "select", "textarea", "table", "tr", "td", "img", "ul", "li", "h1", "h2", "h3", "p", "label", "option")
INPUTS = ("text", "email", "password", "checkbox", "radio", "submit", "hidden")


def page_features(html: Column) -> Column:
    """map<string, double> of a page: tag_<t> (its share of the commonest tag's count), input_<t> (a fifth per input, 1 at most),
    form, required, hidden, visible, captcha and submit marks. Only what is there has an entry."""
    low = F.lower(html)
    return let(F.struct(low.alias("low"), F.regexp_extract_all(low, F.lit(r"<([\p{L}\p{N}_]+)"), F.lit(1)).alias("tags")), features_of)


def features_of(page: Column) -> Column:
    low, found = page["low"], page["tags"]
    count = lambda t: F.size(F.filter(found, lambda x: x == t))
    sizes = F.transform(F.array_distinct(found), lambda t: F.size(F.filter(found, lambda x: x == t)))
    most = F.coalesce(F.array_max(sizes), F.lit(1))
    times = lambda p: F.regexp_count(low, F.lit(p))
    has = lambda *xs: F.rlike(low, F.lit("|".join(xs)))
    forms, required = times("<form"), times("required")
    entries = [(f"tag_{t}", count(t) > 0, count(t) / most) for t in TAGS]
    entries += [(f"input_{t}", times(f"type=[\"']{t}[\"']") > 0, F.least(times(f"type=[\"']{t}[\"']") / 5, F.lit(1.0))) for t in INPUTS]
    entries += [
        ("has_form", forms > 0, F.lit(1.0)), ("form_count", forms > 0, F.least(forms / 3, F.lit(1.0))), ("has_required_fields", required > 0, F.lit(1.0)),
        ("required_count", required > 0, F.least(required / 5, F.lit(1.0))), ("has_hidden_elements", has("display:none", "hidden"), F.lit(1.0)),
        ("has_visible_elements", has("display:block", "display: flex"), F.lit(1.0)), ("has_captcha", has("captcha"), F.lit(1.0)), ("has_submit", has("type=[\"']submit[\"']", "<button"), F.lit(1.0)),
    ]
    pairs = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(n).alias("key"), v.cast("double").alias("value"))) for n, test, v in entries]))
    return F.map_from_entries(pairs)


def feature_place(name: Column, width: int = 200) -> Column:
    """sha256(name) modulo width, from its hex digits eight at a time."""
    h = F.sha2(name.cast("binary"), 256)
    parts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(h, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: F.pmod(a * ((1 << 32) % width) + x, F.lit(width).cast("long"))).cast("int")


def feature_bits(features: Column, width: int = 200) -> Column:
    """Bits of which those of features above a half are set; of features that share a place the last by name decides."""
    entries = F.array_sort(F.map_entries(features))
    marks = F.transform(entries, lambda e: F.struct(feature_place(e["key"], width).alias("at"), F.when(e["value"] > 0.5, 1).otherwise(0).alias("bit")))

    def bits(m: Column) -> Column:
        last = lambda i: F.try_element_at(F.filter(m, lambda x: x["at"] == i), F.lit(-1))["bit"]
        return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(last(i), F.lit(0)))

    return let(marks, bits)


def page_vector(html: Column, concepts: list[str], dim: int = 256) -> Column:
    """The reservoir's vector of a page's features, bundled with those of the concepts that its text names (folded in their order)."""
    ca = reservoir(feature_bits(page_features(html)), dim)
    low = F.lower(html)
    named_ = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(c)), named(F.lit(c), dim)) for c in concepts if len(c) > 2]))
    return F.when(F.size(named_) == 0, ca).otherwise(bundle(ca, folded(named_)))


def page_text(html: Column, limit: int = 5000) -> Column:
    """A page's text: without scripts, styles, navigation, header and footer, tags and reference marks, single spaces, the first limit characters."""
    out = html
    for tag in ("script", "style", "nav", "footer", "header"):
        out = F.regexp_replace(out, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    out = F.regexp_replace(out, r"\[(?:[0-9]+|edit|citation needed)\]", " ")
    return F.substring(F.trim(F.regexp_replace(out, r"\s+", " ")), 1, limit)


def json_pairs(value: Column, depth: int = 3) -> Column:
    """array<struct<role, filler>>: each key of a JSON object with the kind of its value, those of nested objects (and of the first object of
    an array) before it, down to depth levels below the top."""
    from lattica.functions.text import json_concept

    v = F.try_parse_json(value)
    kind = lambda x: json_concept(x)

    def level_(x: Column, left: int) -> Column:
        entries = F.map_entries(F.from_json(x, "map<string,string>"))

        def one(e: Column) -> Column:
            own = F.array(F.struct(e["key"].alias("role"), kind(e["value"]).alias("filler")))
            if not left:
                return own
            inner = F.when(e["value"].startswith("{"), e["value"]).when(e["value"].startswith("["), F.get(F.from_json(e["value"], "array<string>"), F.lit(0)))
            return F.concat(F.coalesce(F.when(inner.startswith("{"), level_(inner, left - 1)), F.array().cast("array<struct<role:string,filler:string>>")), own)

        return F.flatten(F.transform(entries, one))

    return F.when(v.isNotNull(), F.coalesce(level_(value, depth), F.array().cast("array<struct<role:string,filler:string>>")))


def pairs_vector(pairs: Column, dim: int = 256) -> Column:
    """Pairs of role and filler bound and folded in order."""
    return folded(F.transform(pairs, lambda p: bind(named(p["role"], dim), named(p["filler"], dim))))


def metric_pairs(metrics: Column) -> Column:
    """map<string, string> of metrics: numbers by their level, other values as they are; keys in their order."""
    def one(e: Column) -> Column:
        n = e["value"].try_cast("double")
        return F.struct(e["key"].alias("role"), F.when(n.isNotNull(), level(n)).otherwise(e["value"]).alias("filler"))

    return F.transform(F.map_entries(metrics), one)


def confidence(router: Column, memory: Column, solver: Column, weights: tuple = (0.4, 0.3, 0.3)) -> Column:
    """The weighted mean of a router's, a memory's and a solver's confidence; a missing memory gives its weight to the router, a missing
    solver to the others in proportion."""
    r, m, z = weights
    r_ = F.when(memory.isNull(), r + m).otherwise(r)
    m_ = F.when(memory.isNull(), 0.0).otherwise(m)
    z_ = F.when(solver.isNull(), 0.0).otherwise(z)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return (router * r_ + zero(memory) * m_ + zero(solver) * z_) / (r_ + m_ + z_)


def decision(c: Column) -> Column:
    return F.when(c >= 0.9, "execute").when(c >= 0.7, "confirm").otherwise("escalate")


def answer_confidence(kind: Column, similarity: Column, primitives: Column, best: Column) -> Column:
    """Confidence of a solution by its kind (null: none): a constraint solution by how many primitives it used, a learned one by its
    similarity, fixed ones for the others; without a solution, by the best similarity that was met on the way."""
    names, n = primitives, F.size(primitives)
    steps = ((0.99, 0.95), (0.90, 0.85), (0.80, 0.75), (0.70, 0.65), (0.60, 0.55), (0.50, 0.45), (0.40, 0.35), (0.30, 0.30))
    learned = F.lit(0.20)
    for least, value in reversed(steps):
        learned = F.when(F.coalesce(similarity, F.lit(0.5)) >= least, value).otherwise(learned)
    bare = names.isNull() | (n == 0) | (names == F.array(F.lit("bounded")))
    none = F.when(best > 0.5, F.least(best * 0.7, F.lit(0.70))).when(best > 0.3, F.least(best * 0.5, F.lit(0.40))).otherwise(0.20)
    return (
        F.when(kind == "generic_csp", F.when(bare, 0.30).otherwise(F.least(F.lit(0.60) + n * 0.10, F.lit(0.90)))).when(kind.isin("unsat", "conversation"), 0.95)
        .when(kind == "learned", learned).when(kind.isin("suggestion", "command"), 0.90).when(kind == "meta", 0.70).otherwise(none)
    )


def needs_teaching(c: Column, facts: Column) -> Column:
    return (c < 0.25) | (facts == 0)


def ternary(weights: Column) -> Column:
    """Weights as -1, 0 and 1: each divided by the mean magnitude, rounded half to even, within one."""
    scale = F.aggregate(weights, F.lit(0.0), lambda a, x: a + F.abs(x)) / F.size(weights)
    return F.transform(weights, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.bround(x / F.greatest(scale, F.lit(1e-8))))).cast("int"))


def ternary_linear(x: Column, rows: Column, bias: Column) -> Column:
    """x through a layer of ternary rows (array of arrays), scaled by each row's mean magnitude."""
    def one(w: Column, i: Column) -> Column:
        scale = F.aggregate(w, F.lit(0.0), lambda a, v: a + F.abs(v)) / F.size(w)
        total = F.aggregate(F.zip_with(x, ternary(w), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
        return total * scale + F.get(bias, i)

    return F.transform(rows, one)


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, v: a + v))
