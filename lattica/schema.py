"""The data model: facts with provenance, and the default rules, properties and ontology as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TRIPLE = "subject string, relation string, object string, source string, proof string, confidence double, t_start int, t_end int, seq bigint"

# Default composition rules, (first, second) -> result.
SELF_COMPOSED = ("in", "part_of", "before", "after", "inside", "contains", "subset_of", "ancestor_of", "descendant_of", "larger_than", "smaller_than")
CROSS_COMPOSED = (("capital_of", "in", "in"), ("part_of", "in", "in"), ("in", "part_of", "in"))

# Default relation properties.
TRANSITIVE = SELF_COMPOSED + ("equals", "same_as")
SYMMETRIC = ("equals", "same_as", "married_to", "sibling_of", "adjacent_to")
FUNCTIONAL = ("capital_of",)

# One-way inverse names used where no pair was taught.
INVERSES = {"capital_of": "has_capital", "parent_of": "child_of", "part_of": "contains", "in": "contains", "before": "after", "larger_than": "smaller_than"}

# Relation -> (type of its subject, type of its object); relations left out are not constrained.
RELATION_TYPES = {
    "capital_of": ("city", "country"), "located_in": ("place", "place"), "borders": ("country", "country"), "born_in": ("person", "place"),
    "lives_in": ("person", "place"), "married_to": ("person", "person"), "sibling_of": ("person", "person"), "parent_of": ("person", "person"),
    "child_of": ("person", "person"), "founded_by": ("organization", "person"), "employs": ("organization", "person"),
    "subsidiary_of": ("organization", "organization"), "made_by": ("product", "organization"), "invented_by": ("invention", "person"),
    "discovered_by": ("discovery", "person"), "directed_by": ("film", "person"), "composed_by": ("composition", "person"), "painted_by": ("artwork", "person"),
}

# Sets of types no entity can have two of.
DISJOINT = (
    ("city", "country", "continent", "state"), ("person", "organization"), ("animal", "plant"), ("living", "non_living"),
    ("product", "invention", "discovery", "artwork", "film", "composition"),
)

# Type -> its direct supertypes.
SUPERTYPES = {
    "city": ("settlement", "place"), "country": ("place", "geopolitical_entity"), "continent": ("place",), "state": ("place", "geopolitical_entity"),
    "river": ("place", "geographical_feature"), "ocean": ("place", "geographical_feature"), "mountain": ("place", "geographical_feature"),
    "island": ("place", "geographical_feature"), "person": ("living", "entity"), "organization": ("entity",), "product": ("entity",),
    "invention": ("entity",), "discovery": ("entity",), "artwork": ("entity",), "film": ("entity", "artwork"), "composition": ("entity", "artwork"),
    "settlement": ("place",), "place": ("entity",), "living": ("entity",),
}


def rules(spark: SparkSession, extra: list[tuple[str, str, str | None]] = ()) -> DataFrame:
    """(rel1, rel2, target): the default rules, overridden by extra; a null target blocks the pair."""
    table = {(r, r): r for r in SELF_COMPOSED} | {(a, b): c for a, b, c in CROSS_COMPOSED} | {(a, b): c for a, b, c in extra}
    return spark.createDataFrame([(a, b, c) for (a, b), c in table.items()], "rel1 string, rel2 string, target string")


def properties(spark: SparkSession, extra: list[tuple[str, str]] = ()) -> DataFrame:
    """(relation, property), defaults and extra."""
    rows = [*((r, "transitive") for r in TRANSITIVE), *((r, "symmetric") for r in SYMMETRIC), *((r, "functional") for r in FUNCTIONAL), *extra]
    return spark.createDataFrame(sorted(set(rows)), "relation string, property string")


def relation_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, d, g) for r, (d, g) in RELATION_TYPES.items()], "relation string, domain string, range string")


def disjoint_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b) for s in DISJOINT for a in s for b in s if a != b], "type_a string, type_b string")


def subsumption(spark: SparkSession) -> DataFrame:
    """(subtype, supertype): the closure of the hierarchy."""
    def up(t: str) -> set[str]:
        return {x for s in SUPERTYPES.get(t, ()) for x in {s} | up(s)}

    return spark.createDataFrame([(t, s) for t in SUPERTYPES for s in sorted(up(t))], "subtype string, supertype string")
