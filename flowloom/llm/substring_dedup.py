"""Substring deduplication by content-defined chunks.

A gear rolling hash runs over the bytes of each text; a chunk ends where the hash is the largest within REACH bytes on both
sides. Ends depend on nearby bytes only, so an insertion moves the chunks around it and no others. Chunks are
compared by digest across documents; runs of adjacent chunks that other documents also hold are repeated passages.

A passage that two documents share loses at most its first and last chunk in part, so a run of ``least_bytes`` bytes is
found in any passage of about twice that.

Runs of one character or of a short period have no largest hash; there a chunk ends after MOST_BYTES.

Defined results: null and empty texts have no chunks; rows of equal doc_id (of any type) are one document, whatever their texts, and
repeats within a document don't count; rows with a null doc_id are documents named by the hash of their text, which come
after all others; rows equal in id and text give one result; very long texts are chunked whole, one at a time; an empty table gives no
rows; extra columns are ignored by ``repeated_passages`` and kept by ``without_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.plans.scratch import written

REACH = 16
#: The longest chunk.
MOST_BYTES = 1024
#: Bytes that a reported run has at least: over 50 words of running text mostly, but not always, leave more than this
#: between their outer chunks.
LEAST_BYTES = 160
#: A value for each byte, from a 64-bit mixer.
GEAR = ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(29)).astype(np.uint32)
#: A digest with more than this share of all shared chunks is hot; there are fewer than 1 / HOT_SHARE of them, at any size.
HOT_SHARE = 1e-4
#: Parts into which a hot digest is dealt, by document.
SALTS = 64


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash of the 16 bytes up to each place, by doubling the window."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        if len(h) > k:
            more = h.copy()
            more[k:] += h[:-k] << np.uint32(k)
            h = more
    return h * np.uint32(0x9E3779B1)


def _largest_of(h: np.ndarray, n: int) -> np.ndarray:
    """The largest of each ``n`` adjacent values, by doubling."""
    width = 1
    while width * 2 <= n:
        h = np.maximum(h[:-width], h[width:])
        width *= 2
    rest = n - width
    return np.maximum(h[: len(h) - rest], h[rest:]) if rest else h


def chunk_ends(data: bytes) -> np.ndarray:
    """The ends of the chunks of ``data``; the last is its length. Of equal hashes within reach the leftmost ends a chunk."""
    if not data:
        return np.zeros(0, np.int64)
    h = np.maximum(rolling(np.frombuffer(data, np.uint8)), 1)
    pad = np.zeros(REACH, h.dtype)
    before = _largest_of(np.concatenate([pad, h[:-1]]), REACH)
    after = _largest_of(np.concatenate([h, pad]), REACH + 1)
    ends = np.flatnonzero((h == after) & (h > before)) + 1
    ends = ends if len(ends) and ends[-1] == len(data) else np.r_[ends, len(data)]
    sizes = np.diff(ends, prepend=0)
    if sizes.max() <= MOST_BYTES:
        return ends
    return np.concatenate([np.r_[np.arange(e - n + MOST_BYTES, e, MOST_BYTES), e] for e, n in zip(ends, sizes)])


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, hash (of the text), begin, end (in UTF-8 bytes) and digest of every chunk of every whole text."""
    id_type = docs.schema["doc_id"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, begins, ends, digests, held = [], [], [], [], 0
            for i, text in enumerate(batch.column(2)):
                data = (text.as_py() or "").encode()
                stop = chunk_ends(data)
                start = np.r_[0, stop[:-1]] if len(stop) else stop
                rows.append(np.full(len(stop), i, np.int32))
                begins.append(start)
                ends.append(stop)
                digests.append(np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(start.tolist(), stop.tolist())), np.uint64, len(stop)))
                held += len(stop)
                if held > 200_000:
                    yield table(batch, rows, begins, ends, digests)
                    rows, begins, ends, digests, held = [], [], [], [], 0
            if held:
                yield table(batch, rows, begins, ends, digests)

    def table(batch: pa.RecordBatch, rows: list, begins: list, ends: list, digests: list) -> pa.RecordBatch:
        at = pa.array(np.concatenate(rows))
        ours = [pa.array(np.concatenate(begins).astype(np.int32)), pa.array(np.concatenate(ends).astype(np.int32)), pa.array(np.concatenate(digests).view(np.int64))]
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *ours], ["doc_id", "hash", "begin", "end", "digest"])

    keyed = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    return keyed.mapInArrow(cut, f"doc_id {id_type.simpleString()}, hash long, begin int, end int, digest long")


def _shared(every: DataFrame) -> DataFrame:
    """digest, _n, and the first holder (_first, or _first_hash among documents without an id) of chunks that two documents or more hold."""
    nameless = F.when(F.col("doc_id").isNull(), F.col("hash"))
    held = every.groupBy("digest").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"), F.min(nameless).alias("_first_hash"), F.max(nameless).alias("_last_hash"), F.count("*").alias("_n"))
    two = (F.col("_first") != F.col("_last")) | (F.col("_first_hash") != F.col("_last_hash")) | (F.col("_first").isNotNull() & F.col("_first_hash").isNotNull())
    return held.filter(two).drop("_last", "_last_hash")


def _with_first(every: DataFrame, shared: DataFrame) -> DataFrame:
    """``every`` chunk that is ``shared``, with the columns of its first holder. Hot digests are dealt to SALTS parts each, so no task gets one whole."""
    total = shared.agg(F.sum("_n").alias("n")).first()["n"] or 0  # one number
    is_hot = F.col("_n") > F.lit(total * HOT_SHARE)
    hot = shared.filter(is_hot).select("digest", F.lit(True).alias("_hot"))  # below 1 / HOT_SHARE rows
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("doc_id", "hash"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    dealt = every.join(F.broadcast(hot), "digest", "left").withColumn("_salt", salt).drop("_hot")
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(shared.withColumn("_salt", F.explode(salts)).drop("_n"), ["digest", "_salt"])


def _stretches(begin: np.ndarray, end: np.ndarray, first: np.ndarray, least: int) -> list[tuple[int, int, int, bool]]:
    """(begin, end, chunks, first) of one text's shared chunks, in order of place: runs of at least ``least`` bytes, parted where first changes."""
    out = []
    for run in np.split(np.arange(len(begin)), np.flatnonzero(begin[1:] != end[:-1]) + 1):
        if end[run[-1]] - begin[run[0]] < least:
            continue
        parts = [[begin[p[0]], end[p[-1]], len(p), first[p[0]]] for p in np.split(run, np.flatnonzero(np.diff(first[run])) + 1)]
        joined: list[list] = []
        for part in parts:
            part[3] = part[3] or part[1] - part[0] < least  # short stretches join the first copy around them
            if joined and joined[-1][3] == part[3]:
                joined[-1][1:3] = [part[1], joined[-1][2] + part[2]]
            else:
                joined.append(part)
        out += [(int(a), int(b), int(n), bool(f)) for a, b, n, f in joined if b - a >= least]
    return out


def repeated_passages(docs: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """doc_id, begin, end, chunks, first: passages of ``least_bytes`` bytes or more that other documents hold too.

    first: this copy is to be kept, for no document of a smaller id holds this stretch. A run of shared chunks is parted where
    that changes, so what is not first is held whole by smaller ids, and the rest stays. Stretches of less than
    ``least_bytes`` that smaller ids hold aren't repeats of them: they stay with the first copy around them.
    """
    return _passages(docs, least_bytes).drop("hash")


def _passages(docs: DataFrame, least_bytes: int) -> DataFrame:
    """The passages, with the hash of the text that they stand in."""
    every = chunks(docs)
    held = _with_first(every, written(_shared(every), "shared-chunks"))
    first = F.coalesce(F.col("doc_id") == F.col("_first"), F.col("_first").isNull() & (F.col("hash") == F.col("_first_hash")))
    # begin, length and first in one number: a set of them is a text's chunks, rows that repeat or not
    packed = F.shiftleft(F.col("begin").cast("long"), 32) + (F.col("end") - F.col("begin")).cast("long") * 2 + first.cast("long")
    texts = held.groupBy("doc_id", "hash").agg(F.sort_array(F.collect_set(packed)).alias("_chunks"))

    @F.pandas_udf("array<struct<begin:int,end:int,chunks:long,first:boolean>>")
    def runs(held: pd.Series) -> pd.Series:
        out = []
        for x in held:
            begin, size = x >> 32, (x & 0xFFFFFFFF) >> 1
            out.append([dict(zip(("begin", "end", "chunks", "first"), r)) for r in _stretches(begin, begin + size, (x & 1).astype(bool), least_bytes)])
        return pd.Series(out, dtype=object)

    return texts.select("doc_id", "hash", F.explode(runs("_chunks")).alias("p")).select("doc_id", "hash", "p.*")


def without_repeats(docs: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``docs`` with every repeated passage cut out of all documents but the first that holds it; each chunk stays where it is first."""
    gone = _passages(docs, least_bytes).filter("NOT first").groupBy(F.col("doc_id").alias("_id"), F.col("hash").alias("_h")).agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("_cuts"))

    @F.pandas_udf("string")
    def cut(text: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for t, spans in zip(text, cuts):
            if t is None or spans is None:
                out.append(t)
                continue
            data, at, kept = t.encode(), 0, []
            for s in spans:
                kept.append(data[at : s["begin"]])
                at = s["end"]
            out.append(b"".join([*kept, data[at:]]).decode(errors="ignore"))
        return pd.Series(out, dtype=object)

    rows = docs.select(F.struct("*").alias("_doc"))  # packed, so that no column of the input clashes with ours
    joined = rows.join(gone, F.col("_doc.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("_doc.text") == F.col("_h")), "left")
    return joined.select("_doc", cut("_doc.text", "_cuts").alias("_left")).select(F.col("_doc").withField("text", F.col("_left")).alias("_doc")).select("_doc.*")
