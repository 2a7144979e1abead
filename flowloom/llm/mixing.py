"""Mixing sources to target weights, in DataFrame functions only.

Each source's documents, in a pseudorandom but fixed order, form one stream of words that is cut into blocks of
``block_words`` words. The mix is a sequence of slots; each slot of a shard draws its source from the targets (so a
shard's source counts are one multinomial draw). The k-th slot of a source takes block perm(k mod blocks) of epoch
k div blocks, where perm is a keyed permutation of the block numbers, and slots and blocks are joined by (source, block).

The multinomial totals miss the targets by a random few slots; these are settled, so that each source fills exactly
the slots that its target asks for: surplus draws are left out and missing ones added, at random shards both.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating, and share ``share`` times all words. None
gets more than ``most`` times its own words; the excess goes to the others by weight.

Defined results: a null text has no words and is never taken; an empty table gives no rows; repeated rows are separate
documents; a null source is a source of its own; a null doc_id is a document like any other; words of very long texts are
counted whole; extra columns are ignored by ``Mix`` and kept by ``mixed_documents``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.llm.numbering import bucket_of, row_order
from flowloom.plans.scratch import written

WORD = r"[^\x20\x09-\x0D]+"
#: Cells into which the unit interval is cut, to look up the source of a draw by an equi-join.
CELLS = 1024
#: Rounds of the block permutation. Each round swaps half of all pairs i, key - i.
ROUNDS = 16
#: Shards of which the draws are summed up at once.
SHARD_RANGE = 4096


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> sid, weight and target, by filling the sources in order of cap / weight.

    The windows below run over sources, one row each, not over documents.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.withColumn("sid", rank).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("sid"), F.lit(len(weights))) + 1))
    capped = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fill = W.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    everything = fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = capped.withColumn("level", left / weight_left)
    open_level = F.max(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))).over(W.partitionBy())
    shared = level.withColumn("open_level", open_level)
    return shared.select(
        "source", "sid", "source_size", "weight",
        F.least(F.col("cap"), F.coalesce(F.col("open_level") * F.col("weight"), F.col("cap"))).alias("target"),
    )


def permuted(index: Column, n: Column, *keys: Column) -> Column:
    """A keyed permutation of 0 to n - 1 (swap-or-not shuffle): each round maps i to key - i mod n if a bit of their larger says so."""

    def reflected(x: Column, turn: Column) -> Column:
        key = F.pmod(F.xxhash64(*keys, turn), n)
        other = F.pmod(key - x, n)
        return F.when(F.pmod(F.xxhash64(F.greatest(x, other), turn, *keys), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), reflected)


class Mix:
    """The mix of a table. ``documents``, ``slots`` and ``pieces`` are DataFrames; texts are never shuffled for them."""

    def __init__(self, docs: DataFrame, block_words: int = 128, shard_slots: int = 4096, seed: int = 0, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, identity: Column | None = None):
        self.block_words, self.shard_slots, self.seed = block_words, shard_slots, seed
        sized = docs.select(
            "doc_id", "source", word_count(F.col("text")).alias("size"), (F.xxhash64("doc_id", "text") if identity is None else identity).alias("_hash"),
        ).withColumn("_bucket", bucket_of(F.col("_hash")))
        sized = written(sized, "mix-sized")
        buckets = sized.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
        totals = buckets.groupBy("source").agg(F.sum("_words").alias("source_size"))
        self.targets = written(self._with_slots(targets(totals, weights, share, most)), "mix-targets")
        earlier = W.partitionBy("sid").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
        starts = (
            buckets.join(self.targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
            .withColumn("_start", F.coalesce(F.sum("_words").over(earlier), F.lit(0)))
            .select(F.col("source").alias("_source"), F.col("_bucket").alias("_b"), "sid", "source_size", "target", "_start")
        )
        within = W.partitionBy("sid", "_bucket").orderBy("_hash", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
        #: doc_id, source, size, sid, source_size, target and start: where the document's words begin in its source's stream.
        self.documents = written(
            sized.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")))
            .withColumn("start", F.col("_start") + F.sum("size").over(within) - F.col("size"))
            .select("doc_id", "source", "size", "sid", "source_size", "target", "start", "_hash"),
            "mix-documents",
        )
        self.spark = docs.sparkSession

    def _with_slots(self, goals: DataFrame) -> DataFrame:
        """Blocks of each source and the slots that its target fills: whole epochs, then enough blocks for the rest."""
        blocks = F.ceil(F.col("source_size") / F.lit(self.block_words))
        epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
        rest = F.col("target") - epochs * F.col("source_size")
        return goals.withColumn("blocks", blocks.cast("long")).withColumn("fills", (epochs * blocks + F.ceil(rest / F.lit(self.block_words))).cast("long"))

    def shard_counts(self) -> DataFrame:
        """shard, sid, first, n: a multinomial draw of source counts for each shard, settled to the totals in ``fills``."""
        total = self.targets.agg(F.coalesce(F.sum("fills"), F.lit(0)).alias("n")).first()["n"]  # one number
        self.shards = max(1, -(-total // self.shard_slots))
        reach = W.orderBy("sid")
        upto = F.sum("fills").over(reach.rowsBetween(W.unboundedPreceding, 0))
        share = self.targets.filter("fills > 0").withColumn("hi", upto / F.lit(float(max(1, total)))).withColumn("lo", F.coalesce(F.lag("hi").over(reach), F.lit(0.0)))
        last = F.max("sid").over(W.partitionBy())
        share = share.withColumn("hi", F.when(F.col("sid") == last, F.lit(1.0)).otherwise(F.col("hi")))
        cells = share.select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
        draws = self.spark.range(total).select(
            F.expr(f"id div {self.shard_slots}").alias("shard"),
            (F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit(self.seed)), 11) / F.lit(float(2**53))).alias("u"),
        ).withColumn("cell", F.floor(F.col("u") * CELLS))
        drawn = written(draws.join(cells, "cell").filter("lo <= u AND u < hi").groupBy("shard", "sid").agg(F.count("*").alias("drawn")), "mix-draws")
        # running numbers of each source's draws: over ranges of shards first, then within a range
        drawn = drawn.withColumn("range", F.expr(f"shard div {SHARD_RANGE}"))
        ranges = drawn.groupBy("sid", "range").agg(F.sum("drawn").alias("_d"))
        ranges = ranges.withColumn("_before", F.coalesce(F.sum("_d").over(W.partitionBy("sid").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        inside = W.partitionBy("sid", "range").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
        placed = drawn.join(ranges.drop("_d"), ["sid", "range"]).withColumn("first", F.col("_before") + F.coalesce(F.sum("drawn").over(inside), F.lit(0)))
        got = self.targets.filter("fills > 0").select("sid", "fills").join(ranges.groupBy("sid").agg(F.sum("_d").alias("had")), "sid", "left").withColumn("had", F.coalesce("had", F.lit(0)))
        #: sid, fills and had: slots that a source's target asks for, and its draws.
        self.settled = written(got, "mix-settled")
        more = self.settled.filter("fills > had").select("sid", F.col("had").alias("first"), (F.col("fills") - F.col("had")).alias("n"))
        dealt = more.select(
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"), "sid", "first",
        ).select(F.pmod(F.xxhash64("sid", "i", F.lit(self.seed)), F.lit(self.shards)).alias("shard"), "sid", (F.col("first") + F.col("i")).alias("first"), F.lit(1).cast("long").alias("n"))
        return placed.select("shard", "sid", "first", F.col("drawn").alias("n")).unionByName(dealt)

    def slots(self) -> DataFrame:
        """shard, sid, turn (number of the slot within its source), epoch and block."""
        # few short rows that unfold to very many: dealt out before they do
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        each = self.shard_counts().repartition(tasks, "shard", "sid", "first").select("shard", "sid", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("turn"))
        goal = self.targets.filter("blocks > 0").select("sid", "blocks").join(self.settled, "sid")
        sized = each.join(F.broadcast(goal), "sid")  # a row per source
        # of surplus draws those go that a permutation of all draws puts behind the target: the rest are numbered by their places in it
        surplus = F.when(F.col("had") > F.col("fills"), permuted(F.col("turn"), F.col("had"), F.col("sid"), F.lit(self.seed + 1))).otherwise(F.col("turn"))
        # made by a generator, which is evaluated once, however often the number is used
        kept = sized.select("shard", "sid", "blocks", "fills", F.explode(F.array(surplus)).alias("turn")).filter("turn < fills")
        epoch = F.expr("turn div blocks")
        return kept.select("shard", "sid", "turn", epoch.alias("epoch"), permuted(F.expr("turn % blocks"), F.col("blocks"), F.col("sid"), epoch, F.lit(self.seed)).alias("block"))

    def blocks(self) -> DataFrame:
        """sid, block, start (names the document), from and to: which words of which documents make up each block."""
        n = F.lit(self.block_words)
        spans = self.documents.filter("size > 0").select(
            "sid", "start", "size", F.explode(F.sequence(F.expr(f"start div {self.block_words}"), F.expr(f"(start + size - 1) div {self.block_words}"))).alias("block"),
        )
        return spans.select(
            "sid", "block", "start",
            F.greatest(F.col("block") * n - F.col("start"), F.lit(0)).alias("from"),
            F.least((F.col("block") + 1) * n - F.col("start"), F.col("size")).alias("to"),
        )

    def pieces(self) -> DataFrame:
        """The mix: shard, turn, epoch, sid, block, start, from, to. Slots and blocks meet by index, so a hot source is spread."""
        return self.slots().join(self.blocks(), ["sid", "block"])

    def taken(self) -> DataFrame:
        """A row per document: doc_id, source, size, source_size, target and taken (words in the mix, repeats counted)."""
        got = self.pieces().groupBy("sid", "start").agg(F.sum(F.col("to") - F.col("from")).alias("_got")).withColumn("_some", F.lit(True))
        docs = self.documents.withColumn("_some", F.col("size") > 0)
        return docs.join(got, ["sid", "start", "_some"], "left").select(
            "doc_id", "source", "size", "source_size", "target", F.coalesce(F.col("_got"), F.lit(0)).cast("long").alias("taken"),
        )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix as documents: for each document and epoch a row with the words that the mix takes, in the input's columns.

    A document taken whole keeps its text as it is; of others the taken words are joined by spaces. Documents of which
    the mix takes nothing go. ``n_chars`` is recounted where present. Empty documents are never taken. Rows equal in all
    columns are copies: each is taken by itself, and all show the columns of one.
    """
    mix = Mix(docs, identity=row_order(docs), **settings)
    epochs = mix.pieces().groupBy("sid", "start", "epoch").agg(F.sort_array(F.collect_set(F.struct("from", "to"))).alias("_spans"))
    named = mix.documents.filter("size > 0").select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_h"), "sid", "start", F.col("size").alias("_size"))
    wanted = written(epochs.join(named, ["sid", "start"]).select("_id", "_h", "epoch", "_spans", "_size"), "mix-wanted")
    copies = written(named.groupBy("_id", "_h").agg(F.count("*").alias("_n")).filter("_n > 1").select("_id", "_h"), "mix-copies")
    # packed, so that no column of the input clashes with ours
    rows = docs.select(F.struct("*").alias("_doc"), row_order(docs).alias("_row"))

    def same(other: DataFrame) -> Column:
        return F.col("_doc.doc_id").eqNullSafe(other["_id"]) & (F.col("_row") == other["_h"])

    single = rows.join(copies, same(copies), "left_anti")
    one_of_many = rows.join(copies, same(copies), "left_semi").groupBy(F.col("_doc.doc_id").alias("_key"), "_row").agg(F.first("_doc").alias("_doc")).select("_doc", "_row")
    joined = single.unionByName(one_of_many).join(wanted, same(wanted))
    taken_words = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"])
    words = F.split(F.regexp_replace("_doc.text", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+")
    # an array of one splits a text once, and only if it is cut
    part = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform("_spans", lambda s: F.slice(w, (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int")))), " "))[0]
    out = joined.select("_doc", F.when(taken_words >= F.col("_size"), F.col("_doc.text")).otherwise(part).alias("_taken"))
    whole = F.col("_doc").withField("text", F.col("_taken"))
    if "n_chars" in docs.columns:
        whole = whole.withField("n_chars", F.length("_taken").cast(docs.schema["n_chars"].dataType))
    return out.select(whole.alias("_doc")).select("_doc.*")
