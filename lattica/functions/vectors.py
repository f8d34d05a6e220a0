"""Vectors of +1 and -1 as array columns: built-in higher-order functions, and numpy where many named vectors are added."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, also where body uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sign(v: Column) -> Column:
    """Zero counts as +1."""
    return F.transform(v, lambda x: F.when(x >= 0, 1).otherwise(-1))


def bind(a: Column, b: Column) -> Column:
    """Element-wise product; its own inverse. Unequal lengths give null elements."""
    return F.zip_with(a, b, lambda x, y: x * y)


def permute(v: Column, shift: int | Column) -> Column:
    """Rolled right by shift."""
    k = F.pmod(F.lit(shift) if isinstance(shift, int) else shift, F.size(v)).cast("int")
    return F.concat(F.slice(v, F.size(v) - k + 1, k), F.slice(v, F.lit(1), F.size(v) - k))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / F.size(a)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def named(name: Column, dim: int) -> Column:
    """The vector of a name: place i is -1 where hex digit i of md5(name:0) md5(name:1) ... is 8 or more."""
    text = F.concat(*[F.md5(F.concat(name, F.lit(f":{k}")).cast("binary")) for k in range(-(-dim // 32))])
    return let(text, lambda t: F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.when(F.substring(t, i, F.lit(1)) >= "8", -1).otherwise(1)))


@lru_cache(maxsize=1 << 16)
def own(word: str, dim: int) -> np.ndarray:
    """The same vector as `named`."""
    text = "".join(hashlib.md5(f"{word}:{k}".encode()).hexdigest() for k in range(-(-dim // 32)))[:dim]
    return np.where(np.frombuffer(text.encode(), np.uint8) >= ord("8"), -1, 1).astype(np.int32)


def named_total(names: Column, dim: int, signs: bool = False) -> Column:
    """The sum of the vectors of an array of names, or its signs: array<int>; null for a null array."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<int>")
    def run(rows: pd.Series) -> pd.Series:
        seen = {}

        def one(ws):
            if ws is None:
                return None
            ws = tuple(ws)
            if ws not in seen:
                v = sum((own(w, dim) for w in ws), np.zeros(dim, np.int32))
                seen[ws] = np.where(v >= 0, 1, -1).astype(np.int32) if signs else v
            return seen[ws]

        return pd.Series([one(ws) for ws in rows], dtype=object)

    return run(names)


def summed(df: DataFrame, keys: list[str], vector: str, weight: Column | None = None, others: tuple = ()) -> DataFrame:
    """Per group of keys the sum of its vectors (weighted), array<double>, and further aggregates: one array per group and task is
    kept and shuffled, never a row per place."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    v = array_to_vector(F.transform(vector, lambda x: x.cast("double")))
    if weight is not None:  # weights may be negative, which the summarizer refuses: they are multiplied in
        w = weight.cast("double")
        v = array_to_vector(F.transform(vector, lambda x: x.cast("double") * w))
    # the summarizer keeps means, so its sums are off by rounding
    return df.groupBy(*keys).agg(F.transform(vector_to_array(Summarizer.sum(v)), lambda x: F.round(x, 6)).alias(vector), *others)


def bundled(df: DataFrame, keys: list[str], vector: str, weight: Column | None = None) -> DataFrame:
    """Per group of keys the majority vector (ties +1)."""
    return summed(df, keys, vector, weight).withColumn(vector, sign(F.col(vector)))


def bundle(*vectors: Column) -> Column:
    """The majority of some vector columns (ties +1); one is unchanged."""
    total = vectors[0]
    for v in vectors[1:]:
        total = F.zip_with(total, v, lambda x, y: x + y)
    return vectors[0] if len(vectors) == 1 else sign(total)


def folded(vectors: Column) -> Column:
    """An array of vectors bundled two by two from the left, ties +1 at every step (so their order matters)."""
    first = F.get(vectors, F.lit(0))
    return F.aggregate(F.slice(vectors, 2, F.greatest(F.size(vectors) - 1, F.lit(0))), first, lambda a, v: sign(F.zip_with(a, v, lambda x, y: x + y)))


def record(pairs: Column, dim: int) -> Column:
    """array<struct<role, filler>> as one vector: the majority of role bound with filler."""
    parts = F.transform(pairs, lambda p: bind(named(p["role"], dim), named(p["filler"], dim)))
    return sign(total(parts, dim))


def ordered(names: Column, dim: int) -> Column:
    """A sequence of names as one vector: each bound with the identity rolled by its place."""
    rolled = lambda identity: F.transform(names, lambda n, i: bind(named(n, dim), permute(identity, i)))
    return sign(total(let(named(F.lit("_seq_identity"), dim), rolled), dim))


def total(parts: Column, dim: int) -> Column:
    zero = F.array_repeat(F.lit(0), dim)
    return F.aggregate(parts, zero, lambda a, v: F.zip_with(a, v, lambda x, y: (x + y).cast("int")))


def rule90(bits: Column, steps: int) -> Column:
    """Bits after some steps of the automaton in which each becomes its left neighbour xor its right one, the ends meeting."""
    turn = lambda v: F.zip_with(permute(v, 1), permute(v, -1), lambda x, y: x.bitwiseXOR(y))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), bits, lambda v, _: turn(v)) if steps else bits


def projected(bits: Column, width: int, seed: int = 42, picks: int = 3) -> Column:
    """width bits, each the xor of picks seeded places of an array of bits of any length (none: 0, 1)."""
    b = F.when(F.size(bits) == 0, F.array(F.lit(0), F.lit(1))).otherwise(bits)

    def picked(v: Column):
        def one(i: Column) -> Column:
            out = None
            for k in range(picks):
                at = F.pmod(F.xxhash64(F.lit(seed), i, F.lit(k)), F.size(v)).cast("int")
                out = F.get(v, at) if out is None else out.bitwiseXOR(F.get(v, at))
            return out

        return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), one)

    return let(b, picked)


def reservoir(bits: Column, width: int = 256, steps: int = 50, seed: int = 42) -> Column:
    """The vector of +1 and -1 that a bit array leads to: projected on width places, then `rule90`."""
    return F.transform(rule90(projected(bits, width, seed), steps), lambda x: x * 2 - 1)


def char_vector(letter: Column, dim: int) -> Column:
    return named(F.concat(F.lit("__char_"), F.lower(letter)), dim)


def token_vector(token: Column, dim: int) -> Column:
    """A word by its letters: each rolled by its place, and pairs of letters bound, all bundled."""
    letters = F.filter(F.split(token, ""), lambda c: c != "")
    singles = F.transform(letters, lambda c, i: permute(char_vector(c, dim), i))
    pairs = F.transform(F.slice(letters, 1, F.greatest(F.size(letters) - 1, F.lit(0))), lambda c, i: bind(char_vector(c, dim), permute(char_vector(F.get(letters, i + 1), dim), F.lit(1))))
    return sign(total(F.concat(singles, pairs), dim))


def phrase_vector(tokens: Column, dim: int) -> Column:
    """Words by place: each word's vector rolled by its index and bound with one of four roles in turn, bundled."""
    parts = F.transform(tokens, lambda t, i: bind(permute(token_vector(t, dim), i), named(F.concat(F.lit("role_"), F.pmod(i, F.lit(4)).cast("string")), dim)))
    return sign(total(parts, dim))
