"""The trie of conversations' common beginnings, by partition refinement.

Equal conversations are first taken together, as one row with a weight. Then all start in one class (the root). Turn by
turn each active class is split by what its members say next; a class that one distinct conversation is left in retires, and
the rest of that conversation is emitted as a chain without branches. When no class is active the levels fold back from the
deepest to the root, which adds up leaves and savings. There are as many rounds as the longest beginning that two
different conversations share has turns; a round touches the active members' next turns only.

No task sees a whole class, conversation or group of equal ones: classes and groups are split by grouped minima and counts,
whose facts go back to hot keys by broadcast (at most 1 / HOT_SHARE of them); places in a conversation and the words
up to them are running sums over ranges. Only the SHA-256 of a node's ids, which is sequential by definition, passes one task
a node: as pieces of ``PIECE`` ids, streamed.

Defined results: a null turn comes first, a null role or text is empty, turns of equal number are ordered by role, text (first
``HEAD`` characters) and digest, so repeated rows are turns of their own; rows without a conversation id belong to none and
are left out; an empty table gives no rows, a conversation without turns is a member of the root; columns besides the named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.numbering import looked_up
from flowloom.operators.ranges import numbered, running
from flowloom.plans.scratch import written

#: Characters of role and text that order turns of equal number.
HEAD = 128
#: Ids that are joined to one string at once.
PIECE = 1024
WORD = r"[^\x20\x09-\x0D]+"
NO_IDS = hashlib.sha256(b"").hexdigest()


def numbered_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (1, 2, ... in order), label (a digest of role and text) and words of the text."""
    who, said = F.coalesce(F.col(f"`{role}`"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    narrow = rows.filter(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.left(who, F.lit(HEAD)).alias("who"), F.left(said, F.lit(HEAD)).alias("head"),
        F.unhex(F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said), 256)).alias("label"), F.regexp_count(said, F.lit(WORD)).cast("long").alias("words"),
    )
    return numbered(narrow, ["turn", "who", "head", "label"], ["conv_id"], "pos").select("conv_id", (F.col("pos") + 1).alias("pos"), "label", "words")


def with_borrowed_heads(turns: DataFrame, donor: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Every conversation with its first ``heads`` turns replaced by those of ``donor`` (all if that has fewer, none if it is absent).

    ``donor`` and ``heads`` (at most ``most``) are expressions over conv_id. Returns the turns, and conv_id of all
    conversations, those without turns too.
    """
    sizes = written(turns.groupBy("conv_id").agg(F.count("*").alias("_n")), "sizes")
    asked = sizes.select("conv_id", "_n", donor.alias("donor"), heads.alias("h"))
    given = sizes.select(F.col("conv_id").alias("donor"), F.least("_n", F.lit(most)).alias("has"))
    convs = written(asked.join(given, "donor", "left").select("conv_id", "_n", "donor", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("shared")), "heads")
    lent = turns.filter(F.col("pos") <= most).withColumnRenamed("conv_id", "donor")
    head = convs.select("conv_id", "donor", "shared").join(lent, "donor").filter("pos <= shared").select("conv_id", "pos", "label", "words")
    own = looked_up(turns, convs.select("conv_id", "h", "shared", "_n"), "conv_id").filter("pos > h")
    return head.unionByName(own.select("conv_id", (F.col("shared") + F.col("pos") - F.col("h")).alias("pos"), "label", "words")), convs.select("conv_id")


def _ends(members: DataFrame) -> DataFrame:
    """rep, ends: the digest of each group's ids, ascending. ``members``: rep, weight, conv_id."""
    said = lambda ids: F.array_join(F.transform(F.array_sort(ids), lambda x: x.cast("string")), ",")
    out = members.filter(F.col("weight") <= PIECE).groupBy("rep").agg(F.sha2(said(F.collect_list("conv_id")), 256).alias("ends"))
    large = members.filter(F.col("weight") > PIECE).select("rep", "conv_id")
    if large.isEmpty():
        return out
    pieces = numbered(large, ["conv_id"], ["rep"], "place").groupBy("rep", F.expr(f"place div {PIECE}").alias("piece")).agg(said(F.collect_list("conv_id")).alias("ids"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            for rep, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if rep != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()])], ["rep", "ends"])
                    now, state = rep, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()])], ["rep", "ends"])

    streamed = pieces.repartition("rep").sortWithinPartitions("rep", "piece").select("rep", "ids").mapInArrow(digests, "rep long, ends string")
    return out.unionByName(streamed)


def _distinct(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct conversations (rep, weight, n_turns, total, ends) and their turns (rep, pos, label, words, upto), by place."""
    marks = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("pos", "label")).alias("a"), F.bit_xor(F.xxhash64("label", "pos")).alias("b"), F.sum("words").alias("total"))
    none = F.lit(0).cast("long")
    mark = F.struct(*[F.coalesce(c, none).alias(c) for c in ("n", "a", "b", "total")])
    marked = written(convs.distinct().join(marks, "conv_id", "left").select("conv_id", mark.alias("mark")), "marks")
    groups = written(marked.groupBy("mark").agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight")), "groups")
    members = written(looked_up(marked, groups.withColumn("_n", F.col("weight")), "mark").select("rep", "weight", "conv_id"), "members")
    one = groups.select("rep", "weight", F.col("mark.n").alias("n_turns"), F.col("mark.total").alias("total"))
    reps = written(one.join(_ends(members), "rep"), "distinct")
    kept = looked_up(turns, reps.select(F.col("rep").alias("conv_id"), F.lit(True).alias("kept"), F.col("n_turns").alias("_n")), "conv_id").filter("kept")
    steps = running(kept.select(F.col("conv_id").alias("rep"), "pos", "label", "words"), F.col("words"), ["pos"], ["rep"], "upto")
    return reps, written(steps.repartitionByRange("pos", "rep").sortWithinPartitions("pos", "rep"), "steps")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per distinct beginning: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv_id, pos (1 to n without gaps), label (equal for equal turns), words. ``convs``: conv_id of every conversation.
    """
    turns = written(turns.select("conv_id", "pos", "label", "words"), "turns")
    reps, steps = _distinct(turns, convs)
    top = reps.agg(F.min("rep").alias("cls"), F.sum("weight").alias("n_convs"), F.max(F.when(F.col("n_turns") == 0, F.col("ends"))).alias("ends"))
    root = top.filter("cls IS NOT NULL").select("cls", F.lit(None).cast("long").alias("parent"), "n_convs", F.lit(0).cast("long").alias("words"), "ends")
    levels, tails = [written(root, "level")], []
    active = reps.crossJoin(F.broadcast(top.select("cls")))  # top is one row
    while True:
        depth = len(levels)
        at = steps.filter(F.col("pos") == depth).select("rep", "label", "words", "upto")
        here = written(active.filter(F.col("n_turns") >= depth).join(at, "rep").withColumn("key", F.struct("cls", "label")).drop("cls", "label"), "split")
        ended = F.max(F.when(F.col("n_turns") == depth, F.col("ends")))
        facts = written(here.groupBy("key").agg(F.min("rep").alias("cls"), F.count("*").alias("_n"), F.sum("weight").alias("n_convs"), F.max("words").alias("node_words"), ended.alias("node_ends")), "classes")
        left = facts.agg(F.count("*").alias("all"), F.count_if(F.col("_n") > 1).alias("split")).first()
        if not left["all"]:
            break
        moved = written(looked_up(here, facts.select("key", "cls", "_n", F.col("_n").alias("n_reps")), "key"), "moved")
        tails.append(moved.filter("n_reps = 1").select("rep", F.lit(depth).cast("long").alias("depth"), F.col("key.cls").alias("parent"), "weight", "n_turns", "total", "ends", ((F.col("weight") - 1) * (F.col("total") - F.col("upto") + F.col("words"))).alias("saved")))
        levels.append(facts.filter("_n > 1").select("cls", F.col("key.cls").alias("parent"), "n_convs", F.col("node_words").alias("words"), F.col("node_ends").alias("ends")))
        if not left["split"]:
            break
        active = moved.filter("n_reps > 1").select("rep", "weight", "n_turns", "total", "ends", "cls")
    return _folded(levels, tails).unionByName(_chains(tails, steps)) if tails else _folded(levels, tails)


def _folded(levels: list[DataFrame], tails: list[DataFrame]) -> DataFrame:
    """The nodes of more than one distinct conversation, and the root, with leaves and savings added up from the deepest level."""
    out, below = None, None
    for depth in range(len(levels) - 1, -1, -1):
        children = tails[depth].select("parent", F.lit(1).cast("long").alias("leaves"), "saved") if depth < len(tails) else None
        if below is not None:
            nodes = below.select("parent", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
            children = nodes if children is None else children.unionByName(nodes)
        level = levels[depth]
        if children is None:
            sums = level.select("cls", F.lit(None).cast("long").alias("n_children"), F.lit(None).cast("long").alias("leaves"), F.lit(None).cast("long").alias("saved"))
        else:
            sums = children.groupBy(F.col("parent").alias("cls")).agg(F.count("*").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        below = written(
            level.join(sums, "cls", "left").select(
                F.col("cls").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
                ((F.col("n_convs") - 1) * F.col("words") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_IDS)).alias("ends_sha256"),
            ),
            "folded",
        )
        out = below if out is None else out.unionByName(below)
    return out.withColumnRenamed("parent", "parent_conv_id")


def _chains(tails: list[DataFrame], steps: DataFrame) -> DataFrame:
    """The nodes of one distinct conversation each: a chain from the turn at which it retired to its last."""
    retired = tails[0]
    for tail in tails[1:]:
        retired = retired.unionByName(tail)
    facts = written(retired.select("rep", "depth", "parent", "weight", "n_turns", "total", "ends", F.col("n_turns").alias("_n")), "tails")
    each = looked_up(steps, facts, "rep").filter(F.col("pos") >= F.col("depth"))
    last = F.col("pos") == F.col("n_turns")
    return each.select(
        F.col("rep").alias("conv_id"), F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("depth"), F.col("parent")).otherwise(F.col("rep")).alias("parent_conv_id"), F.col("weight").alias("n_convs"),
        F.when(last, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("weight") - 1) * (F.col("total") - F.col("upto") + F.col("words"))).alias("saved_tokens"),
        F.when(last, F.col("ends")).otherwise(F.lit(NO_IDS)).alias("ends_sha256"),
    )
