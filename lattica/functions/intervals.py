"""Relations of half-open year intervals; null ends are open."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The thirteen relations and their inverses.
INVERSE = {
    "before": "after", "after": "before", "meets": "met_by", "met_by": "meets", "overlaps": "overlapped_by", "overlapped_by": "overlaps",
    "starts": "started_by", "started_by": "starts", "during": "contains", "contains": "during", "finishes": "finished_by", "finished_by": "finishes",
    "equals": "equals",
}


def classify(xs: Column, xe: Column, ys: Column, ye: Column) -> Column:
    """The relation of [xs, xe) to [ys, ye), or null. Two intervals open at the end are told apart by start alone: the earlier finishes the later."""
    lo, hi = F.lit(float("-inf")), F.lit(float("inf"))
    a, b, c, d = F.coalesce(xs.cast("double"), lo), F.coalesce(xe.cast("double"), hi), F.coalesce(ys.cast("double"), lo), F.coalesce(ye.cast("double"), hi)
    starts, full = xs.isNotNull() & ys.isNotNull(), xs.isNotNull() & ys.isNotNull() & xe.isNotNull() & ye.isNotNull()
    open_ends = F.when(starts & (a < c), "finishes").when(starts & (a > c), "finished_by")
    return (
        F.when(xs.eqNullSafe(ys) & xe.eqNullSafe(ye), "equals")
        .when(xe.isNull() & ye.isNull(), open_ends)
        .when(b < c, "before").when(d < a, "after").when(b == c, "meets").when(d == a, "met_by")
        .when(full & (c < a) & (b < d), "during").when(full & (a < c) & (d < b), "contains")
        .when(full & (a < c) & (b < d), "overlaps").when(full & (c < a) & (d < b), "overlapped_by")
        .when(starts & (a == c) & (b < d), "starts").when(starts & (a == c) & (d < b), "started_by")
        .when(full & (a > c) & (b == d), "finishes").when(full & (c > a) & (b == d), "finished_by")
    )


def inverse(relation: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in INVERSE.items() for x in kv])[relation]


def relation_of(a: int, b: int, c: int, d: int) -> str:
    """The relation of two closed-ended intervals, from the order of their ends."""
    if b < c or d < a:
        return "before" if b < c else "after"
    if b == c or d == a:
        return "meets" if b == c else "met_by"
    start, end = (a > c) - (a < c), (b > d) - (b < d)
    return {
        (0, 0): "equals", (0, -1): "starts", (0, 1): "started_by", (1, 0): "finishes", (-1, 0): "finished_by",
        (1, -1): "during", (-1, 1): "contains", (-1, -1): "overlaps", (1, 1): "overlapped_by",
    }[start, end]


def composition(spark: SparkSession) -> DataFrame:
    """(first, second, result): all relations x-z that x-y and y-z allow, found by trying every order of six ends."""
    spans = [(a, b) for a in range(6) for b in range(a + 1, 6)]
    rows = {(relation_of(*x, *y), relation_of(*y, *z), relation_of(*x, *z)) for x, y, z in product(spans, repeat=3)}
    return spark.createDataFrame(sorted(rows), "first string, second string, result string")


# The relations that are transitive.
TRANSITIVE = ("before", "after", "during", "contains", "starts", "started_by", "finishes", "finished_by", "equals")


def is_transitive(relation: Column) -> Column:
    return relation.isin(*TRANSITIVE)


def is_symmetric(relation: Column) -> Column:
    return relation == "equals"


def is_asymmetric(relation: Column) -> Column:
    return relation != "equals"


def as_relation(name: Column) -> Column:
    """A relation's name, lower-cased, if it is one of the thirteen."""
    return F.when(F.lower(name).isin(*INVERSE), F.lower(name))


def has_years(start: Column, end: Column) -> Column:
    return start.isNotNull() | end.isNotNull()


def is_interval(start: Column, end: Column) -> Column:
    """Both ends set."""
    return start.isNotNull() & end.isNotNull()


def checked(start: Column, end: Column) -> Column:
    """struct<start, end>; an end that is not after its start is an error."""
    bad = is_interval(start, end) & (start >= end)
    return F.when(bad, F.raise_error(F.concat(F.lit("no interval: "), start.cast("string"), F.lit(" to "), end.cast("string")))).otherwise(F.struct(start.alias("start"), end.alias("end")))


# The composition table of relations, (first, second): what the two together allow.
STATED = {
    ("before", "before"): ("before",),
    ("before", "meets"): ("before",),
    ("before", "overlaps"): ("before",),
    ("before", "starts"): ("before",),
    ("before", "during"): ("before",),
    ("before", "finishes"): ("before",),
    ("before", "equals"): ("before",),
    ("before", "started_by"): ("before",),
    ("before", "finished_by"): ("before",),
    ("before", "contains"): ("before", "meets", "overlaps", "starts", "during", "finishes", "equals", "started_by", "finished_by", "contains"),
    ("before", "overlapped_by"): ("before",),
    ("before", "met_by"): ("before",),
    ("before", "after"): ("before", "meets", "overlaps", "starts", "during", "finishes", "equals", "started_by", "finished_by", "contains", "overlapped_by", "met_by", "after"),
    ("meets", "before"): ("before",),
    ("meets", "meets"): ("before",),
    ("meets", "overlaps"): ("before",),
    ("meets", "starts"): ("before", "meets"),
    ("meets", "during"): ("before",),
    ("meets", "finishes"): ("before",),
    ("meets", "equals"): ("meets",),
    ("meets", "started_by"): ("before", "meets", "overlaps", "starts", "during", "finishes"),
    ("meets", "finished_by"): ("before", "meets"),
    ("meets", "contains"): ("before", "meets", "overlaps", "starts", "during", "finishes", "equals", "started_by", "finished_by", "contains"),
    ("meets", "overlapped_by"): ("before", "meets", "overlaps"),
    ("meets", "met_by"): ("before", "meets", "overlaps", "starts", "during"),
    ("meets", "after"): ("before", "meets", "overlaps", "starts", "during", "finishes", "equals", "started_by", "finished_by", "contains", "overlapped_by", "met_by", "after"),
    ("overlaps", "before"): ("before",),
    ("overlaps", "meets"): ("before",),
    ("overlaps", "overlaps"): ("before", "meets", "overlaps"),
    ("overlaps", "starts"): ("before", "meets", "overlaps"),
    ("overlaps", "during"): ("before", "meets", "overlaps"),
    ("overlaps", "finishes"): ("before", "meets", "overlaps"),
    ("overlaps", "equals"): ("overlaps",),
    ("overlaps", "started_by"): ("before", "meets", "overlaps", "starts", "during", "finishes"),
    ("overlaps", "finished_by"): ("before", "meets", "overlaps"),
    ("overlaps", "contains"): ("before", "meets", "overlaps", "starts", "during", "finishes", "equals", "started_by", "finished_by", "contains"),
    ("overlaps", "overlapped_by"): ("before", "meets", "overlaps", "starts", "during", "finishes", "equals", "started_by", "finished_by", "contains", "overlapped_by"),
    ("overlaps", "met_by"): ("before", "meets", "overlaps", "starts", "during"),
    ("overlaps", "after"): ("before", "meets", "overlaps", "starts", "during", "finishes", "equals", "started_by", "finished_by", "contains", "overlapped_by", "met_by", "after"),
    ("starts", "before"): ("before",),
    ("starts", "meets"): ("before",),
    ("starts", "overlaps"): ("before",),
    ("starts", "starts"): ("starts",),
    ("starts", "during"): ("during",),
    ("starts", "finishes"): ("during",),
    ("starts", "equals"): ("starts",),
    ("starts", "started_by"): ("starts", "during", "finishes", "equals", "started_by", "finished_by"),
    ("starts", "finished_by"): ("during", "finishes"),
    ("starts", "contains"): ("during", "finishes", "equals", "started_by", "finished_by", "contains"),
    ("starts", "overlapped_by"): ("during", "finishes", "overlapped_by"),
    ("starts", "met_by"): ("during", "finishes"),
    ("starts", "after"): ("before", "meets", "overlaps", "starts", "during", "finishes", "equals", "started_by", "finished_by", "contains", "overlapped_by", "met_by", "after"),
    ("during", "before"): ("before",),
    ("during", "meets"): ("before",),
    ("during", "overlaps"): ("before", "meets", "overlaps"),
    ("during", "starts"): ("during",),
    ("during", "during"): ("during",),
    ("during", "finishes"): ("during",),
    ("during", "equals"): ("during",),
    ("during", "started_by"): ("during", "finishes"),
    ("during", "finished_by"): ("during",),
    ("during", "contains"): ("during", "finishes", "equals", "started_by", "finished_by", "contains"),
    ("during", "overlapped_by"): ("during", "finishes", "overlapped_by"),
    ("during", "met_by"): ("during",),
    ("during", "after"): ("before", "meets", "overlaps", "starts", "during", "finishes", "equals", "started_by", "finished_by", "contains", "overlapped_by", "met_by", "after"),
    ("finishes", "before"): ("before",),
    ("finishes", "meets"): ("before",),
    ("finishes", "overlaps"): ("before",),
    ("finishes", "starts"): ("during",),
    ("finishes", "during"): ("during",),
    ("finishes", "finishes"): ("finishes",),
    ("finishes", "equals"): ("finishes",),
    ("finishes", "started_by"): ("during", "finishes", "equals", "started_by", "finished_by"),
    ("finishes", "finished_by"): ("finishes", "equals", "finished_by"),
    ("finishes", "contains"): ("during", "finishes", "equals", "started_by", "finished_by", "contains"),
    ("finishes", "overlapped_by"): ("during", "finishes", "overlapped_by"),
    ("finishes", "met_by"): ("during", "finishes"),
    ("finishes", "after"): ("before", "meets", "overlaps", "starts", "during", "finishes", "equals", "started_by", "finished_by", "contains", "overlapped_by", "met_by", "after"),
    ("equals", "before"): ("before",),
    ("equals", "meets"): ("meets",),
    ("equals", "overlaps"): ("overlaps",),
    ("equals", "starts"): ("starts",),
    ("equals", "during"): ("during",),
    ("equals", "finishes"): ("finishes",),
    ("equals", "equals"): ("equals",),
    ("equals", "started_by"): ("started_by",),
    ("equals", "finished_by"): ("finished_by",),
    ("equals", "contains"): ("contains",),
    ("equals", "overlapped_by"): ("overlapped_by",),
    ("equals", "met_by"): ("met_by",),
    ("equals", "after"): ("after",),
    ("started_by", "before"): ("before",),
    ("started_by", "meets"): ("before", "meets", "overlaps"),
    ("started_by", "overlaps"): ("before", "meets", "overlaps"),
    ("started_by", "starts"): ("starts", "started_by"),
    ("started_by", "during"): ("overlaps", "starts", "during", "started_by", "finishes"),
    ("started_by", "finishes"): ("overlaps", "starts", "during", "finishes", "started_by", "finished_by"),
    ("started_by", "equals"): ("started_by",),
    ("started_by", "started_by"): ("started_by",),
    ("started_by", "finished_by"): ("overlaps", "starts", "during", "finishes", "started_by", "finished_by"),
    ("started_by", "contains"): ("contains", "started_by", "finished_by", "overlapped_by"),
    ("started_by", "overlapped_by"): ("overlaps", "overlapped_by", "met_by", "after"),
    ("started_by", "met_by"): ("overlaps", "met_by", "after"),
    ("started_by", "after"): ("after",),
    ("finished_by", "before"): ("before",),
    ("finished_by", "meets"): ("before",),
    ("finished_by", "overlaps"): ("before", "meets", "overlaps"),
    ("finished_by", "starts"): ("overlaps", "during", "finishes"),
    ("finished_by", "during"): ("overlaps", "during", "finishes"),
    ("finished_by", "finishes"): ("finishes", "finished_by"),
    ("finished_by", "equals"): ("finished_by",),
    ("finished_by", "started_by"): ("overlaps", "during", "finishes", "started_by", "finished_by", "equals", "contains"),
    ("finished_by", "finished_by"): ("finished_by",),
    ("finished_by", "contains"): ("contains", "finished_by"),
    ("finished_by", "overlapped_by"): ("overlaps", "overlapped_by"),
    ("finished_by", "met_by"): ("overlaps", "met_by"),
    ("finished_by", "after"): ("after",),
    ("contains", "before"): ("before",),
    ("contains", "meets"): ("before", "meets", "overlaps"),
    ("contains", "overlaps"): ("before", "meets", "overlaps"),
    ("contains", "starts"): ("starts", "during", "started_by"),
    ("contains", "during"): ("during",),
    ("contains", "finishes"): ("finishes", "during", "finished_by"),
    ("contains", "equals"): ("contains",),
    ("contains", "started_by"): ("started_by", "contains", "overlapped_by"),
    ("contains", "finished_by"): ("finished_by", "contains"),
    ("contains", "contains"): ("contains",),
    ("contains", "overlapped_by"): ("overlapped_by", "contains"),
    ("contains", "met_by"): ("overlapped_by", "met_by", "after"),
    ("contains", "after"): ("after",),
    ("overlapped_by", "before"): ("before",),
    ("overlapped_by", "meets"): ("before", "meets"),
    ("overlapped_by", "overlaps"): ("before", "meets", "overlaps", "starts", "during", "finishes"),
    ("overlapped_by", "starts"): ("overlaps", "during", "finishes"),
    ("overlapped_by", "during"): ("overlaps", "during", "finishes"),
    ("overlapped_by", "finishes"): ("overlaps", "finishes"),
    ("overlapped_by", "equals"): ("overlapped_by",),
    ("overlapped_by", "started_by"): ("overlaps", "overlapped_by", "starts", "during", "finishes", "started_by", "finished_by", "equals", "contains"),
    ("overlapped_by", "finished_by"): ("overlaps", "overlapped_by", "finishes", "finished_by"),
    ("overlapped_by", "contains"): ("overlapped_by", "contains"),
    ("overlapped_by", "overlapped_by"): ("overlapped_by", "contains"),
    ("overlapped_by", "met_by"): ("overlapped_by", "met_by", "after"),
    ("overlapped_by", "after"): ("after",),
    ("met_by", "before"): ("before", "meets", "overlaps", "starts", "during"),
    ("met_by", "meets"): ("overlaps", "starts", "during"),
    ("met_by", "overlaps"): ("overlaps", "starts", "during"),
    ("met_by", "starts"): ("overlaps", "during", "finishes"),
    ("met_by", "during"): ("overlaps", "during", "finishes"),
    ("met_by", "finishes"): ("overlaps", "finishes"),
    ("met_by", "equals"): ("met_by",),
    ("met_by", "started_by"): ("overlapped_by", "met_by", "after"),
    ("met_by", "finished_by"): ("overlapped_by", "met_by", "after"),
    ("met_by", "contains"): ("overlapped_by", "met_by", "after"),
    ("met_by", "overlapped_by"): ("overlapped_by", "met_by", "after"),
    ("met_by", "met_by"): ("after",),
    ("met_by", "after"): ("after",),
    ("after", "before"): ("before", "meets", "overlaps", "starts", "during", "finishes", "equals", "started_by", "finished_by", "contains", "overlapped_by", "met_by", "after"),
    ("after", "meets"): ("overlapped_by", "met_by", "after"),
    ("after", "overlaps"): ("overlapped_by", "met_by", "after"),
    ("after", "starts"): ("overlapped_by", "met_by", "after"),
    ("after", "during"): ("overlapped_by", "met_by", "after"),
    ("after", "finishes"): ("overlapped_by", "met_by", "after"),
    ("after", "equals"): ("after",),
    ("after", "started_by"): ("after",),
    ("after", "finished_by"): ("after",),
    ("after", "contains"): ("after",),
    ("after", "overlapped_by"): ("after",),
    ("after", "met_by"): ("after",),
    ("after", "after"): ("after",),
}


def stated_composition(spark: SparkSession) -> DataFrame:
    """(first, second, result): the table as it is stated; a pair that is not in it allows all relations. It departs from the computed one
    in more than half of its cells, so what is derived by it must be checked against the intervals themselves."""
    rows = [(a, b, c) for a in INVERSE for b in INVERSE for c in STATED.get((a, b), tuple(INVERSE))]
    return spark.createDataFrame(rows, "first string, second string, result string")
