"""Benchmark decontamination by a distributed positional inverted index.

One pass over the training texts indexes every term, whatever the benchmark. The index is dealt by documents, as in a
search cluster: a shard holds some BATCH_WORDS words of whole documents, and for each of its terms the sorted list of
positions, numbered through the shard's documents with a gap after each. Windows of ``length`` consecutive words of each
benchmark item are the phrases sought. Corpus counts of their terms order each window's terms, rarest first; a window with a
term that the corpus lacks cannot occur. In each shard the lists of a window's terms are shifted by the terms' offsets and
intersected, rarest first, so each list only shrinks what is left; what all of them hold is an occurrence. Lists of the two
rarest terms that meet only within ``slop`` words give proximity matches. No text is looked at again.

A frequent term's list is spread over all shards, and no posting moves between tasks. The benchmark is the query set: its
windows are taken in blocks of BLOCK_WINDOWS, so what is sent to tasks is bounded.

Defined results: null or wordless texts have no words, hits or items; an item with a null id is the item ''; repeated
rows of documents each get their own result and repeated items count once per id; very long texts are indexed whole,
one at a time; empty tables give no hits or no rows; extra columns are ignored here, and kept by
``without_contaminated``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.plans.scratch import written

#: Windows of a block: ten times as many short rows are sent to tasks at once (some 20 MB).
BLOCK_WINDOWS = 20_000
#: Words of a shard; a longer document is a shard of its own.
BATCH_WORDS = 1_000_000
#: A shard is a row group of its own, so writers and readers hold one at a time. A bound in bytes alone doesn't give that: Parquet
#: first looks at its size after 100 rows, and 100 shards are gigabytes.
ONE_AT_A_TIME = {"parquet.block.row.count.limit": "1"}
SHARD = "rows array<string>, ids array<string>, sizes array<int>, terms array<string>, counts array<int>, posts array<int>"
#: ASCII bytes that aren't letters or digits divide words, A-Z become a-z, other bytes stay.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8."""
    return (text or "").encode().translate(WORD_BYTES).split()


def word_column(text: Column) -> Column:
    """The same words, as a column."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def item_windows(benchmark: DataFrame, length: int = 10) -> DataFrame:
    """item, window: the phrases of each item, words joined by spaces; a shorter item is one phrase."""
    words = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), word_column(F.col("text")).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(length - 1), F.lit(1)))
    return words.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, length), " "))).alias("window")).distinct()


def postings(docs: DataFrame) -> DataFrame:
    """The index, a row per shard: its documents (rows, ids, sizes in words) and terms, with the number and the list of positions of each term."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ids, held, total = [], [], [], 0
        for batch in batches:
            for doc_id, row, text in zip(*batch.columns):
                rows.append(row.as_py())
                ids.append(doc_id.as_py())
                held.append(words_of(text.as_py()))
                total += len(held[-1])
                if total >= BATCH_WORDS:
                    yield shard(rows, ids, held)
                    rows, ids, held, total = [], [], [], 0
        if held:
            yield shard(rows, ids, held)

    def shard(rows: list, ids: list, held: list[list[bytes]]) -> pa.RecordBatch:
        sizes = np.array([len(w) for w in held])
        numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        terms = np.fromiter((numbers[x] for w in held for x in w), np.int64, sizes.sum())
        place = np.arange(len(terms)) + np.repeat(np.arange(len(held)), sizes)  # a gap after each document
        order = np.argsort(terms, kind="stable")
        names = [c.split()[0] for c in SHARD.split(", ")]
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        columns = [one(rows, pa.string()), one(ids, pa.string()), one(sizes, pa.int32()), one([x.decode() for x in numbers], pa.string()), one(np.bincount(terms, minlength=len(numbers)), pa.int32()), one(place[order], pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names)

    keyed = docs.select(F.col("doc_id").cast("string").alias("doc_id"), row_key().alias("row"), "text")
    return keyed.mapInArrow(index, SHARD)


class Shard:
    """Position lists of one row of the index."""

    def __init__(self, rows: list[str], sizes: np.ndarray, terms: list[str], counts: np.ndarray, posts: np.ndarray):
        self.rows, self.posts, self.number = rows, posts, {t: i for i, t in enumerate(terms)}
        self.ends = np.cumsum(counts)
        self.begins = self.ends - counts
        self.base = np.cumsum(sizes) - sizes + np.arange(len(sizes))

    def list_of(self, term: str) -> np.ndarray:
        i = self.number.get(term)
        return np.zeros(0, np.int32) if i is None else self.posts[self.begins[i] : self.ends[i]]

    def phrase(self, terms: list[tuple[str, int]]) -> np.ndarray:
        """Where all terms, given rarest first with their offsets, stand in their places."""
        if not all(t in self.number for t, _ in terms):
            return np.zeros(0, np.int32)
        left = self.list_of(terms[0][0]) - terms[0][1]
        for term, offset in terms[1:]:
            if not len(left):
                break
            left = left[_member(left + offset, self.list_of(term))]
        return left

    def near(self, terms: list[tuple[str, int]], slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rarest term, and how far (1 to ``slop``) the next one is from its place beside it, in the same document."""
        (t, i), (u, j) = terms[:2]
        a, b = self.list_of(t), self.list_of(u)
        if not len(a) or not len(b):
            return a[:0], a[:0]
        best = np.full(len(a), slop + 1)
        own = self.document(a)
        for step in range(-slop, slop + 1):
            if step:
                other = a - i + j + step
                met = _member(other, b)
                best[met] = np.minimum(best[met], np.where(self.document(other[met]) == own[met], abs(step), slop + 1))
        met = best <= slop
        return a[met], best[met]

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, places, "right") - 1


def _member(wanted: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which of ``wanted`` are in the sorted ``held``."""
    return held[np.minimum(np.searchsorted(held, wanted), len(held) - 1)] == wanted


def row_key() -> Column:
    """Names a row by its id and text. Rows equal in both have equal results, so they may share a key."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex(F.xxhash64("text")))


class Index:
    """The positional index of ``docs``, and the phrases of ``benchmark`` in it."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, length: int = 10):
        self.id_type = docs.schema["doc_id"].dataType
        self.windows = written(item_windows(benchmark, length), "windows")
        self.shards = written(postings(docs), "postings", **ONE_AT_A_TIME)
        #: doc_id, row, n_words: a row per document.
        self.documents = self.shards.select(F.explode(F.arrays_zip("ids", "rows", "sizes")).alias("d")).select(F.col("d.ids").alias("doc_id"), F.col("d.rows").alias("row"), F.col("d.sizes").cast("long").alias("n_words"))
        distinct = self.windows.select("window").distinct()
        blocks = max(1, -(-distinct.count() // BLOCK_WINDOWS))
        self._parts = [self._ranked(distinct.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k)) for k in range(blocks)]

    def _ranked(self, block: DataFrame) -> DataFrame:
        """window and rare: the (n, term, offset) of each window that can occur, rarest first."""
        each = block.select("window", F.posexplode(F.split("window", " ")).alias("offset", "term"))
        held = self.shards.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.counts").alias("n"))
        counts = held.join(F.broadcast(each.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
        known = each.join(counts, "term", "left").groupBy("window").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset"))).alias("rare"))
        return written(known.filter(F.col("rare")[0]["n"] > 0), "ranked")

    def _each_shard(self, ranked: DataFrame, find: Callable[[Shard, list], tuple[np.ndarray, np.ndarray, int]]) -> DataFrame:
        """window, row, start and value, from the places, values and offset in the window that ``find`` gives for each shard and window."""
        block = [(r["window"], [(x["term"], x["offset"]) for x in r["rare"]]) for r in ranked.collect()]  # BLOCK_WINDOWS rows at most
        sent = ranked.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, sizes, terms, counts, posts in zip(*batch.columns):
                    ints = lambda x: x.values.to_numpy()
                    shard = Shard(rows.as_py(), ints(sizes), terms.as_py(), ints(counts), ints(posts))
                    out: list[list] = [[], [], [], []]
                    for window, rare in sent.value:
                        places, values, offset = find(shard, rare)
                        if len(places):
                            doc = shard.document(places)
                            for column, more in zip(out, ([window] * len(places), [shard.rows[d] for d in doc], (places - shard.base[doc] - offset).tolist(), values.tolist())):
                                column += more
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32())], ["window", "row", "start", "value"])

        return self.shards.select("rows", "sizes", "terms", "counts", "posts").mapInArrow(search, "window string, row string, start long, value int")

    def phrases(self) -> DataFrame:
        """window, row, start, size: the exact occurrences, where the shifted lists of all of a window's terms meet."""

        def find(shard: Shard, rare: list) -> tuple[np.ndarray, np.ndarray, int]:
            places = shard.phrase(rare)
            return places, np.full(len(places), len(rare)), 0

        return written(reduce(DataFrame.unionByName, [self._each_shard(ranked, find) for ranked in self._parts]).withColumnRenamed("value", "size"), "phrases")

    def proximity(self, slop: int = 10) -> DataFrame:
        """window, row, start, apart: the two rarest terms within ``slop`` words of their places in the phrase, but not in them.

        ``start`` is where the phrase would begin by the rarest term's place; it may lie before the document.
        """

        def find(shard: Shard, rare: list) -> tuple[np.ndarray, np.ndarray, int]:
            none = np.zeros(0, int)
            return (*(shard.near(rare, slop) if len(rare) > 1 else (none, none)), rare[0][1])

        return reduce(DataFrame.unionByName, [self._each_shard(ranked, find) for ranked in self._parts]).withColumnRenamed("value", "apart")

    def spans(self, phrases: DataFrame | None = None) -> DataFrame:
        """row, spans: the distinct (start, size) hit in each document, in order."""
        return (self.phrases() if phrases is None else phrases).groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("spans"))

    def hits(self) -> DataFrame:
        """row, n_hit, items: words inside any occurrence, and the items that occur, as sorted strings."""
        found = self.phrases()
        covered = F.aggregate(
            "spans", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n")),
            lambda a, s: F.struct(F.greatest(a["upto"], s["start"] + s["size"]).alias("upto"), (a["n"] + F.greatest(F.lit(0).cast("long"), s["start"] + s["size"] - F.greatest(a["upto"], s["start"]))).alias("n")),
        )["n"]
        items = found.select("window", "row").distinct().join(self.windows, "window").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
        return self.spans(found).select("row", covered.alias("n_hit")).join(items, "row")

    def report(self) -> DataFrame:
        """A row per document: doc_id, row, n_words, n_hit, items."""
        joined = self.documents.join(written(self.hits().dropDuplicates(["row"]), "hits"), "row", "left")
        return joined.select(
            F.col("doc_id").cast(self.id_type).alias("doc_id"), "row", "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, length: int = 10) -> DataFrame:
    """``docs`` without documents that hold a benchmark phrase. Only the keys of contaminated rows are joined."""
    hit = written(Index(docs.select("doc_id", "text"), benchmark, length).phrases().select(F.col("row").alias("_row")).distinct(), "contaminated")
    rows = docs.select(F.struct("*").alias("_doc"), row_key().alias("_key"))  # packed, so that no column of the input clashes with ours
    return rows.join(hit, F.col("_key") == F.col("_row"), "left_anti").select("_doc.*")
