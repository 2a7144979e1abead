"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

A row's place is computed, not sorted for: row number r goes to position p = perm(r), shard p mod k and slot p div k.
The permutation is a balanced Feistel network on the smallest even number of bits that holds n; positions of n or
more are walked on (the network is applied again) until they fall below n, so it is a bijection on 0 to n - 1.

Defined results: null texts have no bytes (size 1) and CRC 0; an empty table gives no rows; repeated rows are
separate rows with places of their own; other columns of the input pass through ``shard_rows`` unchanged, and a
column of its own name (``size``, ``shard``, ...) is replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.numbering import numbered

ROUNDS = 6


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser, keyed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(key)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def feistel(rows: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The position of each row number below ``n``: a bijection for each seed."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [int(k) for k in _mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64), (seed * 0x9E3779B97F4A7C15 + 1) % 2**64)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for key in keys:
            left, right = right, left ^ (_mixed(right, key) & mask)
        return (left << shift) | right

    out = once(rows.astype(np.uint64))
    while len(beyond := np.flatnonzero(out >= np.uint64(n))):
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot and grown_shard.

    The law is ``rows``: shard counts differ by one at most. The texts themselves are not shuffled when the caller
    drops them first: see ``shard_places``.
    """
    ours = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rest = docs.drop(*ours)
    return _placed(rest.select(F.struct("*").alias("_doc"), rest[key].alias("_key"), rest[text].alias("_text")), shards, seed)


def shard_places(docs: DataFrame, shards: int = 8, seed: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Only the key and the place of each row: the shuffle carries no text."""
    return _placed(docs.select(F.struct(key).alias("_doc"), F.col(key).alias("_key"), F.col(text).alias("_text")), shards, seed)


def _placed(packed: DataFrame, shards: int, seed: int) -> DataFrame:
    """The columns of ``_doc`` (packed, so that none clashes with ours) and the places, from _doc, _key and _text."""
    text = F.col("_text")
    rows = packed.select(
        "_doc", "_key",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64("_key", text).alias("_hash"),
    )

    @F.pandas_udf("long")
    def position(row: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series(feistel(row.to_numpy(), int(total.iloc[0]), seed)) if len(row) else row

    placed = numbered(rows, "_hash", ["_hash", "_key", "size", "text_crc32"]).withColumn("_at", position("row_no", "row_total"))
    return placed.select(
        "_doc.*", "size", "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod(F.col("_at"), F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"_at div {int(shards)}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
