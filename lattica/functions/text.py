"""Text functions, all built-in expressions (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Articles, compound relations and preposition endings of relation names.
ARTICLES = ("the", "a", "an")
COMPOUND = (
    "capital_of", "part_of", "member_of", "type_of", "kind_of", "sort_of", "pair_of", "piece_of", "set_of", "group_of", "depends_on", "relied_on",
    "based_on", "focused_on", "born_in", "married_to", "compared_to", "related_to", "similar_to", "connected_to", "devoted_to", "committed_to",
    "dedicated_to", "made_by", "created_by", "founded_by", "owned_by",
)
PREPOSITIONS = (
    "to", "in", "at", "for", "with", "from", "on", "of", "into", "onto", "about", "through", "over", "under", "up", "down", "out", "off", "away",
    "back", "between", "among", "against", "toward", "towards",
)
COPULAS = ("is", "are", "was", "were", "be")
# Verbs that join a subject to what it is.
COPULA_VERBS = ("is", "are", "was", "were", "be", "been", "being", "become", "became", "seem", "seemed")
# Prepositions that a trailing phrase can start with.
PP = (
    "on", "in", "at", "from", "to", "by", "for", "with", "into", "through", "during", "before", "after", "about", "near", "over", "above", "below",
    "between", "under", "against", "of",
)
# Phrases that carry nothing in a question.
FILLERS = ("so", "like", "you know", "i mean", "basically", "actually", "well", "right", "i was wondering", "can you tell me", "could you tell me", "do you know")
#: A stop list of our own choice; callers pass their language's.
STOP = ("the", "a", "an", "of", "in", "on", "to", "and", "or", "is", "are", "was", "were", "it", "that", "this", "for", "with", "as", "by", "be", "at", "from")


def tokenize(text: Column) -> Column:
    """Lower-cased words; signs other than ' and - divide, and those two are stripped at the ends."""
    parts = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s'-]", " "), r"\s+")
    return F.filter(F.transform(parts, lambda w: F.regexp_replace(w, "^['-]+|['-]+$", "")), lambda w: w != "")


def content_words(tokens: Column, stop: tuple = STOP) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(*stop) & w.rlike(r"[\p{L}\p{N}]"))


def canonical_relation(relation: Column, lemma: Column | None = None) -> Column:
    """Copulas become is_a, compounds stay, one preposition ending goes if two or more characters are left; lemma, if given, maps the rest."""
    stem = F.regexp_replace(relation, f"^(.{{2,}}?)_({'|'.join(sorted(PREPOSITIONS, key=len, reverse=True))})$", "$1")
    rest = F.coalesce(lemma, stem) if lemma is not None else stem
    return F.when(relation.isin(*COPULAS), "is_a").when(relation.isin(*COMPOUND), relation).otherwise(rest)


def specificity(relation: Column) -> Column:
    return F.when(relation.isin(*COMPOUND), 3).when(relation.contains("_"), 2).otherwise(1)


def entity_name(text: Column) -> Column:
    """Lower-cased, without leading articles, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\s+", " "), f"^ ?(({'|'.join(ARTICLES)}) )+", ""))


def surface_form(sense: Column) -> Column:
    return F.regexp_replace(sense, "_[0-9]+$", "")


def interval(text: Column) -> Column:
    """struct<start, end> of the first year expression by priority; null where there is none or it is empty."""
    low = F.lower(text)

    def pick(pattern: str, start, end) -> tuple[Column, Column]:
        g = lambda i: F.regexp_extract(low, pattern, i).cast("int")
        return low.rlike(pattern), F.struct(start(g).cast("int").alias("start"), end(g).cast("int").alias("end"))

    none = lambda g: F.lit(None)
    year = lambda i: lambda g: g(i)
    cases = [
        pick(r"([0-9]{4})\s*(?:-|to|–|—)\s*([0-9]{4})", year(1), year(2)), pick(r"from\s+([0-9]{4})\s+to\s+([0-9]{4})", year(1), year(2)),
        pick(r"between\s+([0-9]{4})\s+and\s+([0-9]{4})", year(1), year(2)), pick(r"since\s+([0-9]{4})", year(1), none),
        pick(r"(?:until|before)\s+([0-9]{4})", none, year(1)), pick(r"from\s+([0-9]{4})", year(1), none),
        pick(r"during\s+the\s+([0-9]{3})0s", lambda g: g(1) * 10, lambda g: g(1) * 10 + 10),
        pick(r"\b(1[89][0-9]{2}|20[0-2][0-9])\b", year(1), lambda g: g(1) + 1),
    ]
    out = F.when(*cases[0])
    for c, v in cases[1:]:
        out = out.when(c, v)
    return F.when(out["start"].isNull() | out["end"].isNull() | (out["start"] < out["end"]), out)


def is_question(text: Column) -> Column:
    return F.rtrim(text).endswith("?")


def sentences(text: Column) -> Column:
    """A request's parts: fillers go, then parts end at a comma with and, but or or after it, and at semicolons; a part is cut at its
    ands where two words or more stand on every side of each."""
    bare = words_joined(F.regexp_replace(text, rf"(?i)\b({'|'.join(sorted(FILLERS, key=len, reverse=True))})\b", ""))
    marked = F.regexp_replace(bare, "[ ]*;[ ]*|,[ ]*(and|but|or) ", BREAK)
    whole = F.filter(F.transform(F.split(marked, BREAK), lambda p: F.trim(p)), lambda p: p != "")
    return F.flatten(F.transform(whole, divided))


BREAK = "\x1e"


def words_joined(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[\\s]+", " "))


def divided(part: Column) -> Column:
    sides = F.transform(F.split(part, " and "), lambda s: F.trim(s))
    long = F.forall(sides, lambda s: F.size(F.split(s, " ")) > 1)
    return F.when(long, sides).otherwise(F.array(part))


# What a statement can say: (subject, connective, object, relation, where else). A subject or object is one word or many; in
# the relation, * is the word the connective leaves open. The last column names a relation that must not have been found.
# Subjects start where a run of words (or a word) does, so that a text is searched once from each, and no loop nests in another.
MANY, ONE = r"(\w(?:[\w\s]*\w)?)", r"(\w+)"
START = {MANY: r"(?:^|[^\w\s])\s*" + MANY, ONE: r"(?<!\w)" + ONE}
SAYINGS = (
    (MANY, r"is\s+(?:the\s+)?(\w+)\s+of\s+(?:the\s+)?", MANY, "*_of", None),
    (MANY, r"is\s+in\s+(?:the\s+)?", MANY, "in", None),
    (MANY, r"is\s+inside\s+(?:the\s+)?", ONE, "inside", None),
    (MANY, r"is\s+within\s+(?:the\s+)?", ONE, "inside", "inside"),
    (MANY, r"contains\s+(?:the\s+)?", ONE, "contains", None),
    (MANY, r"is\s+part\s+of\s+(?:the\s+)?", MANY, "part_of", None),
    (MANY, r"is\s+before\s+", MANY, "before", None),
    (MANY, r"before\s+", MANY, "before", "before"),
    (ONE, r"is\s+after\s+", ONE, "after", None),
    (ONE, r"after\s+", ONE, "after", "after"),
    (ONE, r"means\s+", ONE, "means", None),
    (ONE, r"is\s+(\w+)\s+to\s+", ONE, "*_to", None),
    (ONE, r"is\s+(\w+)\s+than\s+", ONE, "*_than", None),
)
NAMED = r"([a-z]+_[a-z]+)\s+"  # a relation written out, as in feeds_into
BARED = ("in", "before")  # whose ends lose trailing phrases


def without_phrases(name: Column) -> Column:
    """A name without the prepositions with one word that end it; a word is left at least."""
    ws = F.split(F.trim(name), r"\s+")
    step = lambda a, i: F.when(a["on"] & F.get(ws, F.size(ws) - 2 * i).isin(*PP), F.struct((F.size(ws) - 2 * i).alias("left"), F.lit(True).alias("on"))).otherwise(F.struct(a["left"].alias("left"), F.lit(False).alias("on")))
    upto = F.floor((F.size(ws) - 1) / 2).cast("int")
    left = F.aggregate(F.sequence(F.lit(1), upto), F.struct(F.size(ws).alias("left"), F.lit(True).alias("on")), step, lambda a: a["left"])
    return F.when((F.size(ws) < 3) | ~F.try_element_at(ws, F.lit(-2)).isin(*PP), name).otherwise(F.array_join(F.slice(ws, 1, left), " "))


def statements(text: Column) -> Column:
    """array<struct<subject, relation, object>> that a lower-cased text states, in the order of SAYINGS: the first place where each holds.
    Where none does, a relation written out with an underscore, after a copula or alone."""
    low = F.trim(F.lower(text))
    kind = "array<struct<subject:string,relation:string,object:string>>"

    def said(subject: str, middle: str, obj: str, relation: str) -> Column:
        pattern = rf"(?U){START[subject]}\s+{middle}{obj}"
        open_ = "*" in relation
        get = lambda i: F.regexp_extract(low, pattern, i)
        s, o = get(1), get(3 if open_ else 2)
        if relation in BARED:
            s, o = without_phrases(s), without_phrases(o)
        r = F.concat(get(2), F.lit(relation[1:])) if open_ else F.lit(relation)
        return F.when(F.rlike(low, F.lit(pattern)), F.struct(s.alias("subject"), r.alias("relation"), o.alias("object")))

    found = []
    for subject, middle, obj, relation, other in SAYINGS:
        one = said(subject, middle, obj, relation)
        if other:
            had = [F.rlike(low, F.lit(rf"(?U){START[s]}\s+{m}{o}")) for s, m, o, r, _ in SAYINGS if r == other and (s, m, o) != (subject, middle, obj)]
            one = F.when(~had[0], one)
        found.append(one)
    first = F.array_compact(F.array(*found))

    def written(copula: str) -> Column:
        pattern = rf"(?U){START[ONE]}\s+{copula}{NAMED}(\w+)"
        get = lambda i: F.regexp_extract(low, pattern, i)
        return F.when(F.rlike(low, F.lit(pattern)), F.struct(get(1).alias("subject"), get(2).alias("relation"), get(3).alias("object")))

    spelled = F.coalesce(written(rf"(?:{'|'.join(COPULA_VERBS)})\s+"), written(""))
    return F.when(F.size(first) > 0, first.cast(kind)).otherwise(F.array_compact(F.array(spelled)).cast(kind))


def tag_count(html: Column, tag: str) -> Column:
    """How often a tag is opened."""
    return F.regexp_count(F.lower(html), F.lit(f"<{tag}[ >/]"))


def level(value: Column) -> Column:
    return F.when(value >= 90, "critical").when(value >= 70, "high").when(value >= 30, "medium").otherwise("low")


def json_concept(value: Column) -> Column:
    """The kind of a JSON value given as text: valid or invalid (booleans), number, multiple (array), entity (object), absent, string."""
    v = F.trim(value)
    return (
        F.when(value.isNull() | (v == "null"), "absent").when(v == "true", "valid").when(v == "false", "invalid")
        .when(v.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), "number").when(v.startswith("["), "multiple").when(v.startswith("{"), "entity").otherwise("string")
    )
