"""N-gram Jaccard join by adaptive multi-match prefixes.

A document is the set of its distinct word shingles. Tokens are ordered rarest first; a set and any partner that is
similar enough share at least l tokens within the first n - c + l tokens of each, where c is the least overlap that any
partner needs. Each document takes the l that its estimated candidates (document frequencies of its prefix tokens)
make cheapest: a longer prefix, and correspondingly more shared prefix tokens before a pair is verified. Pairs are
bounded by size and by the tokens left after each match, and are verified on the whole texts. Before that, a bitmap of
each set (which of BITS buckets hold an odd number of its tokens) bounds a pair from below: sets differ in at least as
many tokens as their bitmaps differ in bits.

Document frequencies cover every token of every document. They travel packed: a task sends, for each range of tokens, the
distinct tokens of a batch of documents as one binary, and gets back which of them are frequent; ranges are small at any size.

Links are found for components, not as all pairs of a group: (1) each class of equal sets is verified against one hub, the
document of its prefix buckets with the rarest-first position nearest the front; (2) what is linked becomes one
component, and only pairs of different components that share enough prefix tokens are verified. No link between
different components is left out, and a group of n near copies costs about n verifications.

Defined results: null or wordless texts have no shingles and link with nothing (component_id is their own doc_id); fewer
words than a shingle make one shingle; equal texts are one class, of which one row is verified; rows with a null doc_id take part, and the smallest
doc_id ignores nulls; very long texts are shingled whole, one at a time; an empty table gives no rows; extra columns are
ignored by ``components`` and kept by ``one_per_component``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.numbering import looked_up, row_order
from flowloom.operators.components import connected_components
from flowloom.plans.scratch import new_path, written

KEY_BITS = 48
#: Tokens (and documents) that a task packs at once, and tokens in a range of keys.
BATCH_TOKENS, BATCH_DOCS, RANGE_TOKENS = 250_000, 50_000, 1 << 18
#: Bits of a set's bitmap.
BITS = 512
#: The longest extension of a prefix that is tried, and what a candidate's verification costs in postings.
MOST_MATCHES = 4
#: Bytes of text in a bucket of the table of texts.
BUCKET_BYTES = 32 << 20

PACKED = "part int, batch string, base int, size int, blob binary, extra binary, info binary"
PROFILE = "doc_id string, hash long, n int, digest string, matches int, bits array<long>, keys array<long>, places array<int>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    w = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space divides
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), len(w))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = len(w) - words + 1
    out = h[:n].copy()
    for j in range(1, words):
        out = _mix(out) + h[j : j + n]
    return np.unique(_mix(out))


def bitmap(tokens: np.ndarray) -> bytes:
    """Which of BITS buckets hold an odd number of the tokens."""
    return np.packbits((np.bincount((tokens & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def _pack(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(blob: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _rank(df: np.ndarray) -> np.ndarray:
    """Document frequencies in 255 steps: exact up to 127, then logarithmic. Only their order and rough size count."""
    return np.where(df < 128, df, np.minimum(255, 128 + 4 * np.log2(np.maximum(df, 128) / 128))).astype(np.uint8)


def _frequency(rank: np.ndarray) -> np.ndarray:
    return np.where(rank < 128, rank, 128 * 2.0 ** ((rank.astype(float) - 128) / 4))


class JaccardJoin:
    """The join of ``docs`` (doc_id, text) with itself: shingles of ``words`` words, at least ``percent`` % similar."""

    def __init__(self, docs: DataFrame, words: int = 5, percent: int = 80):
        self.words, self.percent = words, percent
        self.id_type = docs.schema["doc_id"].dataType
        self.docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
        size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0  # one number
        ranges = max(8, min(4096, size // 6 // RANGE_TOKENS), size // 6 // (1 << 22))
        self.part_bits = int(ranges - 1).bit_length()
        #: A row per document: PROFILE. keys and places are the prefix tokens that other documents have, and where they stand.
        self.profile = written(self._profile(), "shingle-profile")
        #: _h, _text: each text once, in buckets of its hash, so that what is looked up goes to the texts and no text moves.
        self.laid = self._laid(max(1, size // BUCKET_BYTES))
        self.repeats = self.laid.count() < self.profile.count()

    def _laid(self, least: int) -> DataFrame:
        """The table of texts: at least ``least`` buckets, a multiple of the shuffle's partitions, so that each bucket is one task's file."""
        spark = self.docs.sparkSession
        tasks, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"texts_{uuid.uuid4().hex}"
        each = self.docs.groupBy(F.col("hash").alias("_h")).agg(F.max("text").alias("_text"))  # copies meet in their own tasks first
        each.write.bucketBy(-(-least // tasks) * tasks, "_h").options(path=new_path(spark, "texts"), compression="zstd").saveAsTable(name)
        return spark.table(name)

    # frequencies and prefixes

    def _profile(self) -> DataFrame:
        words, percent, bits = self.words, self.percent, self.part_bits
        width = -(-(KEY_BITS - bits) // 8)

        def packed(batch: list[tuple], number: int) -> pd.DataFrame:
            sets = [b[3] for b in batch]
            sizes = np.array([len(s) for s in sets])
            keys = np.concatenate(sets) >> np.uint64(64 - KEY_BITS)
            owners = np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(keys, kind="stable")
            distinct, counts = np.unique(keys, return_counts=True)
            parts = (distinct >> np.uint64(KEY_BITS - bits)).astype(np.int64)
            begins = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]) if len(parts) else np.zeros(0, int)
            ends = np.r_[begins[1:], len(parts)].astype(int)
            rest = distinct & np.uint64((1 << (KEY_BITS - bits)) - 1)
            few = np.minimum(counts, 65535).astype("<u2")
            info = json.dumps({"doc_id": [b[0] for b in batch], "hash": [b[1] for b in batch], "n": sizes.tolist(), "digest": [b[2] for b in batch], "bits": [bitmap(s).hex() for s in sets]}).encode()
            # the same name if the task is run again: what was sent before and what is sent later must fit
            name = f"{TaskContext.get().partitionId()}-{number}-{xxhash.xxh3_64_hexdigest(info)}"
            rows = [(-1 - xxhash.xxh32_intdigest(name) // 2, name, 0, len(distinct), owners[order].astype("<u2").tobytes(), few.tobytes(), info)]
            rows += [(int(parts[a]), name, int(a), int(b - a), _pack(rest[a:b], width), few[a:b].tobytes(), None) for a, b in zip(begins, ends)]
            return pd.DataFrame(rows, columns=[c.split()[0] for c in PACKED.split(", ")])

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept, tokens, number = [], 0, 0
            for frame in batches:
                for doc_id, h, text in zip(frame["doc_id"], frame["hash"], frame["text"]):
                    s = shingles(text, words)
                    kept.append((doc_id, int(h), xxhash.xxh3_128_hexdigest(s.tobytes()), s))
                    tokens += len(s)
                    if tokens >= BATCH_TOKENS or len(kept) >= BATCH_DOCS:
                        yield packed(kept, number)
                        kept, tokens, number = [], 0, number + 1
            if kept:
                yield packed(kept, number)

        def count(frame: pd.DataFrame) -> pd.DataFrame:
            if frame["part"].iloc[0] < 0:  # what a batch keeps for itself
                return frame
            keys = [_unpack(b, width) for b in frame["blob"]]
            counts = np.concatenate([np.frombuffer(b, "<u2") for b in frame["extra"]]).astype(np.int64)
            every, where = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(where, counts, len(every)).astype(np.int64)[where]
            rows, at = [], 0
            for part, name, base, n, own in zip(frame["part"], frame["batch"], frame["base"], frame["size"], keys):
                df = total[at : at + n]
                at += n
                often = df > 1
                if often.any():
                    rows.append((part, name, base, n, np.packbits(often).tobytes(), _rank(df[often]).tobytes(), _pack(own[often], width)))
            return pd.DataFrame(rows, columns=frame.columns)

        def prefixes(frame: pd.DataFrame) -> pd.DataFrame:
            head = frame[frame["part"] < 0].iloc[0]
            info = json.loads(head["info"])
            n = np.array(info["n"], np.int64)
            counts, owners = np.frombuffer(head["extra"], "<u2").astype(np.int64), np.frombuffer(head["blob"], "<u2").astype(np.int64)
            at, rank, key = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)], [np.zeros(0, np.uint64)]
            for row in frame[frame["part"] >= 0].itertuples():
                at.append(row.base + np.flatnonzero(np.unpackbits(np.frombuffer(row.blob, np.uint8))[: row.size]))
                rank.append(np.frombuffer(row.extra, np.uint8))
                key.append(_unpack(row.info, width) | np.uint64(row.part << (KEY_BITS - bits)))
            at, rank, key = np.concatenate(at), np.concatenate(rank), np.concatenate(key)
            # each frequent token once for every document of the batch that has it
            starts = np.r_[0, np.cumsum(counts)][at]
            copies = counts[at]
            which = np.repeat(np.arange(len(at)), copies)
            owner = owners[starts[which] + np.arange(len(which)) - np.repeat(np.cumsum(copies) - copies, copies)]
            order = np.lexsort((key[which], rank[which], owner))
            which, owner = which[order], owner[order]
            held = np.bincount(owner, minlength=len(n))
            first = np.r_[0, np.cumsum(held)]
            rows = []
            for i in range(len(n)):
                mine = which[first[i] : first[i + 1]]
                place = n[i] - held[i] + np.arange(held[i])
                need = -(-percent * n[i] // 100)
                cost = np.maximum(_frequency(rank[mine]) - 1, 0)
                best, least = 1, None
                for m in range(1, int(min(MOST_MATCHES, max(1, need))) + 1):
                    inside = place < n[i] - need + m
                    estimate = cost[inside].sum() / m + inside.sum()
                    if least is None or estimate < least:
                        best, least = m, estimate
                inside = place < n[i] - need + best
                rows.append((info["doc_id"][i], info["hash"][i], int(n[i]), info["digest"][i], best, np.frombuffer(bytes.fromhex(info["bits"][i]), "<i8"), key[mine][inside].astype(np.int64), place[inside].astype(np.int32)))
            return pd.DataFrame(rows, columns=[c.split()[0] for c in PROFILE.split(", ")])

        sent = self.docs.mapInPandas(pack, PACKED)
        return sent.groupBy("part").applyInPandas(count, PACKED).groupBy("batch").applyInPandas(prefixes, PROFILE)

    # classes of equal sets, candidates, verification

    def classes(self) -> DataFrame:
        """digest, n, matches, keys, places, and the row (doc_id, hash) that stands for the class."""
        return self.profile.filter("n > 0").groupBy("digest").agg(
            F.min(F.struct("doc_id", "hash")).alias("row"), F.first("n").alias("n"), F.first("matches").alias("matches"), F.first("bits").alias("bits"), F.first("keys").alias("keys"), F.first("places").alias("places"),
        )

    def _postings(self) -> DataFrame:
        """key, digest, n, matches, place, for tokens that two classes or more hold in their prefixes."""
        every = self.classes().select("digest", "n", "matches", F.explode(F.arrays_zip("keys", "places")).alias("p")).select(F.col("p.keys").alias("key"), "digest", "n", "matches", F.col("p.places").alias("place"))
        hub = every.groupBy("key").agg(F.count("*").alias("_c"), F.min(F.struct("place", "digest", "n", "matches")).alias("hub")).filter("_c > 1").drop("_c")
        return every.join(hub, "key")

    def _least_overlap(self, n: Column, m: Column) -> Column:
        p, whole = self.percent, 100 + self.percent
        return F.floor(((n + m) * p + (whole - 1)) / whole)

    def _may_match(self, n: Column, i: Column, k: Column, m: Column, j: Column, l: Column) -> Column:
        """Whether a token at places i and j of sets of n and m tokens can be among the first matches of a similar pair."""
        sizes = (F.least(n, m) * 100 >= F.greatest(n, m) * self.percent)
        return sizes & (F.least(n - i, m - j) + F.least(k, l) - 1 >= self._least_overlap(n, m))

    def _bitmaps_allow(self, n: Column, bits: Column, m: Column, other: Column) -> Column:
        """Whether bitmaps leave room for the overlap that sets of n and m tokens need."""
        apart = sum((F.bit_count(bits[i].bitwiseXOR(other[i])) for i in range(1, BITS // 64)), F.bit_count(bits[0].bitwiseXOR(other[0])))
        return apart <= n + m - 2 * self._least_overlap(n, m)

    def texts(self, wanted: DataFrame, name: str) -> DataFrame:
        """The text of each wanted digest (in column ``name``) beside its other columns: that of one row of the class."""
        rows = self.classes().select("digest", F.col("row.hash").alias("_h"))
        named = wanted.join(rows, wanted[name] == rows["digest"]).select(*wanted.columns, "_h")
        return named.join(self.laid, "_h").select(*wanted.columns, F.col("_text").alias("text"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """a, b, shared, n_a, n_b of the pairs (digests a and b) that are similar enough, from the whole texts."""
        words, percent = self.words, self.percent
        pairs = written(pairs.select("a", "b").distinct(), "pairs")

        a = self.texts(pairs, "a")
        b = self.texts(pairs.select("b").distinct(), "b").withColumnRenamed("text", "_other")

        @F.pandas_udf(T.StructType([T.StructField("shared", T.LongType()), T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType())]))
        def overlap(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            last, held = None, None
            for left, right in batches:
                out = []
                for x, y in zip(left, right):
                    if y != last or held is None:
                        last, held = y, shingles(y, words)
                    own = shingles(x, words)
                    out.append((len(np.intersect1d(own, held, assume_unique=True)), len(own), len(held)))
                yield pd.DataFrame(out, columns=["shared", "n_a", "n_b"])

        both = a.join(b, "b").select("a", "b", overlap("text", "_other").alias("o")).select("a", "b", "o.*")
        return both.filter(F.col("shared") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("shared")) * percent).dropDuplicates(["a", "b"])

    def links(self) -> DataFrame:
        """a, b: links between classes, enough of them to join every component; and the components that they make."""
        postings = written(self._postings(), "postings")
        h = F.col("hub")
        near = postings.filter(F.col("digest") != h["digest"]).filter(self._may_match(F.col("n"), F.col("place"), F.col("matches"), h["n"], h["place"], h["matches"]))
        counted = near.groupBy("digest", F.col("hub.digest").alias("b")).agg(F.count("*").alias("c"))
        star = counted.groupBy(F.col("digest").alias("a")).agg(F.max(F.struct("c", "b")).alias("m")).select("a", "m.b")
        first = written(self.verified(star).select("a", "b"), "links")
        found = connected_components(first, "a", "b")
        second = written(self.verified(self._across(postings, found)).select("a", "b"), "links")
        return first.unionByName(second)

    def _across(self, postings: DataFrame, found: DataFrame) -> DataFrame:
        """Pairs of different components that share enough prefix tokens, from the rows outside each token's largest component."""
        rows = postings.drop("hub").join(found.withColumnRenamed("node", "digest"), "digest", "left").withColumn("comp", F.coalesce("component", "digest")).drop("component")
        # a row is of use only if its token is near enough to the front for the smallest set of its bucket
        least = rows.groupBy("key").agg(F.min("n").alias("_least"), F.max("matches").alias("_most"))
        p = self.percent
        reach = (F.col("n") - F.col("place") + F.least(F.col("matches"), F.col("_most")) - 1) * (100 + p) >= (F.col("n") + F.greatest(F.col("_least"), F.ceil(F.col("n") * p / 100))) * p
        rows = written(rows.join(least, "key").filter(reach).drop("_least", "_most"), "rows")
        sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "comp")).alias("m"), F.count("*").alias("comps")).filter("comps > 1")
        bits = self.profile.filter("n > 0").groupBy("digest").agg(F.first("bits").alias("bits"))
        mixed = written(rows.join(sizes.select("key", F.col("m.comp").alias("main")), "key").join(bits, "digest"), "mixed")
        x = mixed.filter("comp <> main").select("key", *[F.col(c).alias(f"x_{c}") for c in ("digest", "n", "matches", "bits", "place", "comp")])
        y = mixed.select("key", "main", *[F.col(c).alias(f"y_{c}") for c in ("digest", "n", "matches", "bits", "place", "comp")])
        met = x.join(y, "key").filter(F.col("x_comp") != F.col("y_comp")).filter((F.col("y_comp") == F.col("main")) | (F.col("x_digest") < F.col("y_digest")))
        met = met.filter(self._may_match(F.col("x_n"), F.col("x_place"), F.col("x_matches"), F.col("y_n"), F.col("y_place"), F.col("y_matches")))
        met = met.filter(self._bitmaps_allow(F.col("x_n"), F.col("x_bits"), F.col("y_n"), F.col("y_bits")))
        shared = met.groupBy(F.col("x_digest").alias("a"), F.col("y_digest").alias("b")).agg(F.count("*").alias("c"), F.min(F.least("x_matches", "y_matches")).alias("least"))
        return shared.filter("c >= least").select("a", "b")

    def components(self) -> DataFrame:
        """doc_id, hash (of the text), n_shingles, component_id and group (names the component; null without words): a row per document."""
        found = written(connected_components(self.links(), "a", "b"), "components")
        docs = self.profile.select(F.col("doc_id").cast(self.id_type).alias("doc_id"), "hash", "digest", F.col("n").cast("long").alias("n_shingles"))
        wordy = docs.filter("n_shingles > 0")
        per = wordy.groupBy("digest").agg(F.min("doc_id").alias("_least"), F.count("*").alias("_docs")).join(found.withColumnRenamed("node", "digest"), "digest", "left")
        per = written(per.select("digest", "_docs", "_least", F.coalesce("component", "digest").alias("group")), "classes")
        groups = written(per.groupBy("group").agg(F.min("_least").alias("component_id"), F.count("*").alias("_n")), "groups")
        named = written(looked_up(per.drop("_least"), groups, "group"), "classes")
        out = looked_up(wordy, named, "digest", "_docs").select("doc_id", "hash", "n_shingles", "component_id", "group")
        return out.unionByName(docs.filter("n_shingles = 0").select("doc_id", "hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("string").alias("group")))


def components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of each document."""
    return JaccardJoin(docs, words, percent).components().drop("hash", "group")


def one_per_component(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (null last), then text hash, then hash of the whole row.

    Rows without words all stay, also repeated ones.
    """
    found = written(JaccardJoin(docs, words, percent).components().filter("n_shingles > 0"), "near-copies")
    rank = F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "hash")
    kept = written(found.groupBy("group").agg(F.min(rank).alias("_kept"), F.count("*").alias("_n")), "kept")
    gone = looked_up(found, kept, "group").filter(rank != F.col("_kept")).select("doc_id", "hash").distinct().withColumn("_again", F.lit(False))
    # rows that agree in id and text: of these one is taken, whatever else the table holds
    again = found.groupBy("doc_id", "hash").agg(F.count("*").alias("_n")).filter("_n > 1").select("doc_id", "hash", F.lit(True).alias("_again"))
    marks = gone.unionByName(again).groupBy(F.col("doc_id").alias("_id"), F.col("hash").alias("_h")).agg(F.min("_again").alias("_again"))
    marks = written(marks, "near-copies")
    twice = written(marks.filter("_again").drop("_again"), "repeated-rows")
    rows = docs.select(F.struct("*").alias("_doc"), row_order(docs).alias("_order"))  # packed, so that no column of the input clashes with ours
    same = F.col("_doc.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("_doc.text") == F.col("_h"))
    once = rows.join(marks, same, "left_anti").select("_doc")
    if twice.isEmpty():  # the texts are shuffled once less
        return once.select("_doc.*")
    repeated = rows.join(twice, same, "left_semi").groupBy(F.col("_doc.doc_id").alias("_id"), F.xxhash64("_doc.text").alias("_h")).agg(F.min_by("_doc", "_order").alias("_doc"))
    return once.unionByName(repeated.select("_doc")).select("_doc.*")
