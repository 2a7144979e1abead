"""Media columns: WAV bytes in a binary column, read by the wave module, and spectral-peak fingerprints.

``wav_of_bytes`` stores a payload losslessly as 8-bit mono samples; ``payload_of_wav`` reads it back with ``wave``.
``fingerprints`` takes short-time Fourier transforms (Hann windows of 576 samples, hop 288), keeps the strongest bin of each of six
bands in frames where it stands out, and pairs each peak with the next peaks in time: (frame, f1, f2, gap) as a
time-coded array. A file is read in slices of frames, so memory is bounded by the slice, not by the file. ``stored_media`` writes
both columns to the shared folder, and all digests are taken from what is read back.

Defined results: a null text is the empty payload; a payload is padded with bytes 255 to a positive multiple of 576;
equal payloads have equal files and features; silence has no peaks and an empty array; repeated rows and null ids are
documents like any other; an empty table gives no rows; extra columns pass through ``with_media``, where columns named media or
fingerprint are replaced, and are left out of ``media_digests``.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.plans.scratch import written

FRAME, HOP, RATE = 576, 288, 8000
#: Edges of the bands of spectral bins in which peaks are sought; bin 0 (the mean) is left out.
BANDS = (1, 10, 20, 40, 80, 160, 289)
#: A peak pairs with the peaks of this many later frames, and at most FAN of them.
AHEAD, FAN = 3, 3
SLICE = 2048
#: Bytes of stored columns that a reader decodes at once.
ROW_GROUP = 16 << 20
_HANN = np.hanning(FRAME).astype(np.float32)
FINGERPRINT = T.ArrayType(T.StructType([T.StructField("t", T.IntegerType()), T.StructField("hash", T.IntegerType())]))


def padded(payload: bytes) -> bytes:
    """The payload with bytes 255 up to a positive multiple of FRAME."""
    return payload + b"\xff" * (max(1, -(-len(payload) // FRAME)) * FRAME - len(payload))


def wav_of_bytes(payload: bytes) -> bytes:
    """A WAV file whose 8-bit samples are the payload."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def payload_of_wav(media: bytes) -> bytes:
    """The samples of a WAV file; raises if it isn't 8-bit mono."""
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not an 8-bit mono file")
        return w.readframes(w.getnframes())


def peaks(media: bytes) -> np.ndarray:
    """(frame, bin) of the spectral peaks of a WAV file, in order."""
    found = []
    with wave.open(io.BytesIO(media), "rb") as w:
        kept, at = np.zeros(0, np.float32), 0
        while raw := w.readframes(SLICE * HOP):
            kept = np.concatenate([kept, (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128])
            n = (len(kept) - FRAME) // HOP + 1
            if n < 1:
                continue
            frames = np.lib.stride_tricks.as_strided(kept, (n, FRAME), (kept.strides[0] * HOP, kept.strides[0]))
            power = np.abs(np.fft.rfft((frames - frames.mean(axis=1, keepdims=True)) * _HANN, axis=1)).astype(np.float32)
            floor = 2 * power[:, 1:].mean(axis=1)
            for lo, hi in zip(BANDS, BANDS[1:]):
                top = power[:, lo:hi].argmax(axis=1)
                strong = np.flatnonzero(power[np.arange(n), lo + top] > np.maximum(floor, 1e-3))
                found.append(np.stack([at + strong, lo + top[strong]], axis=1))
            kept, at = kept[n * HOP :], at + n
    if not found:
        return np.zeros((0, 2), np.int64)
    both = np.concatenate(found)
    return both[np.lexsort((both[:, 1], both[:, 0]))]


def fingerprints(media: bytes) -> np.ndarray:
    """(t, hash) of peak pairs: hash holds both bins (9 bits each) and the gap in frames."""
    p = peaks(media)
    pairs = []
    for step in range(1, FAN + 1):
        a, b = p[:-step], p[step:]
        gap = b[:, 0] - a[:, 0]
        near = gap <= AHEAD
        pairs.append(np.stack([a[near, 0], (a[near, 1] << 16) | (b[near, 1] << 4) | gap[near]], axis=1))
    both = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    return both[np.lexsort((both[:, 1], both[:, 0]))]


@F.pandas_udf(T.BinaryType())
def wav_column(text: pd.Series) -> pd.Series:
    """Text -> WAV file of its padded UTF-8 bytes."""
    return text.map(lambda t: wav_of_bytes(padded((t or "").encode())))


def fingerprint_column(media: Column) -> Column:
    """WAV file -> its time-coded fingerprints."""
    return F.arrays_zip(_marks(media)["t"].alias("t"), _marks(media)["hash"].alias("hash"))


@F.pandas_udf(T.StructType([T.StructField(name, T.ArrayType(T.IntegerType())) for name in ("t", "hash")]))
def _marks(media: pd.Series) -> pd.DataFrame:
    found = [fingerprints(m).astype(np.int32) for m in media]
    return pd.DataFrame({"t": [x[:, 0] for x in found], "hash": [x[:, 1] for x in found]})


def with_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns media (WAV bytes) and fingerprint."""
    return docs.drop("media", "fingerprint").withColumn("media", wav_column(F.col(text))).withColumn("fingerprint", fingerprint_column("media"))


DIGESTS = T.StructType(
    [T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType())]
)


@F.pandas_udf(DIGESTS)
def payload_digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """What the samples of a stored file say."""
    for media in batches:
        payloads = [payload_of_wav(m) for m in media]
        yield pd.DataFrame([(len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])) for p in payloads], columns=DIGESTS.names)


def stored_media(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, media and fingerprint of each document, written to the shared folder and read back."""
    rows = docs.select(F.col(key), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("_text"))
    # small row groups: a reader decodes one at a time
    return written(with_media(rows, "_text").drop("_text"), "media", **{"parquet.block.size": str(ROW_GROUP)})


def media_digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document the digests of its stored file and its stored fingerprints, with these as the last column."""
    marks = F.array_join(F.transform("fingerprint", lambda x: F.concat_ws(":", x["t"], x["hash"])), ",")
    feature = F.concat_ws(":", F.size("fingerprint"), F.substring(F.sha2(marks, 256), 1, 32))
    back = stored_media(docs, text, key).withColumn("_d", payload_digest("media"))
    return back.select(key, "n_bytes", "_d.*", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), "fingerprint")
