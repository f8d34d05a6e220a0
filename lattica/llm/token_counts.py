"""Token counts (operator 8): pieces are counted once per distinct pre-token and summed per document.

A pre-token is a run of spaces with the run of other characters after it; line feeds stand alone. No piece of the
vocabulary reaches across such a border (checked when the model is loaded), so the pieces of a text are those of
its pre-tokens and their counts add up. Ids are never materialised.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated results; other columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import counted_keys, hot_rows, looked_up, materialize, short, with_uid

BORDER = re.compile(rb" *[^ \n]+| +|\n")
SPACE = "▁".encode()


def pretokens(text: bytes) -> list[bytes]:
    """Pre-tokens of a text; the tokenizer puts one space before a text and reads U+2581 as a space."""
    return BORDER.findall(b" " + text.replace(SPACE, b" ")) if text else []


def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def check_borders(model) -> None:
    """Raise unless no piece has a space after another character, or a line feed: pre-tokens are then exact."""
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if "▁" in piece.lstrip("▁") or "\n" in piece:
            raise ValueError(f"piece {piece!r} crosses a pre-token border")
    if model.encode("\n", out_type=str) != ["▁", "<0x0A>"] or len(model.encode(" \n ")) != 3:
        raise ValueError("the model does not keep a leading line feed and spaces apart")


def pieces_of(model, tokens: list[bytes]) -> list[int]:
    """Pieces of each pre-token. A line feed in front keeps the added leading space away; both count one piece."""
    return [len(x) - 2 for x in model.encode(["\n" + t.decode() for t in tokens], num_threads=1)]


def piece_table(docs: DataFrame, model_path: str) -> DataFrame:
    """(key, n, tokens): every distinct pre-token (the digest of a long one), its count in the corpus and its number of pieces."""

    def run(batches):
        model = load(model_path)
        for pdf in batches:
            yield pdf.assign(tokens=pieces_of(model, list(pdf["key"])), key=[short(k) for k in pdf["key"]])

    return counted_keys(docs, pretokens).mapInPandas(run, "key binary, n long, tokens long")


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, hot: int = 1 << 17) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of docs (doc_id, text).

    hot bounds the broadcast: the most frequent pre-tokens (long ones by digest). All others meet the whole table in
    a sort-merge join, after being counted within their document.
    """
    spark = docs.sparkSession
    check_borders(load(model_path))
    table = materialize(piece_table(docs, model_path), "pieces")
    near = spark.sparkContext.broadcast(hot_rows(table, hot, ["tokens"]))

    def spread(batches):
        known = near.value.dict()
        for pdf in batches:
            for a in range(0, len(pdf), 500):
                uid, key, n, tokens, size, doc = [], [], [], [], [], []
                for u, d, x in zip(*(pdf[c].iloc[a : a + 500] for c in ("uid", "doc_id", "text")), strict=True):
                    raw = b"" if x is None else x.encode()
                    total, rest = 0, []
                    for t, k in Counter(pretokens(raw)).items():
                        t = short(t) if len(t) > 64 else t
                        got = known.get(t)
                        if got is None:
                            rest.append((t, k))
                        else:
                            total += got * k
                    m = len(rest)
                    uid += [u] * (m + 1)
                    key += [None, *[t for t, _ in rest]]
                    n += [1, *[k for _, k in rest]]
                    tokens += [total] + [0] * m
                    size += [len(raw)] + [None] * m
                    doc += [d] + [None] * m
                yield pd.DataFrame({"uid": uid, "key": key, "n": n, "tokens": tokens, "size": pd.array(size, "Int64"), "doc": pd.array([None if pd.isna(x) else int(x) for x in doc], "Int64")})

    rows = with_uid(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    out = looked_up(rows, spread, table, ["tokens"], "size long, doc long")
    n = F.round("tokens").cast("long")
    return out.select(F.col("doc").alias("doc_id"), F.col("size").alias("n_bytes"), n.alias("n_tokens"), (n > limit).alias("over_limit"))
