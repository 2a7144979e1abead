"""Chat formatting by schema fingerprints, in DataFrame functions only.

Records come as JSON in whatever layout their publisher chose. The nested field paths of a record (from
``schema_of_variant``, without types or values) are hashed; the hash selects a mapping, which is data: JSON paths and
roles. The mapping turns the record into canonical turns, an array of (role, text).

A turn is written as ``<turn role>``, newline, text, ``</turn>``, newline. Inside texts and roles, ``%`` becomes ``%25``
and the ``<`` of a control string becomes ``%3C``, so control strings occur only as controls and the text can be read back.

Defined results: a null text or role is empty; a conversation with a null id is a conversation; turns are ordered by
(turn, role, text), nulls first, and repeated rows are repeated turns; no rows give no conversations; a record whose
fingerprint no mapping knows has null turns, never a guess; a record of LARGE_BYTES or more that doesn't parse is an
error, for it may be whole and beyond the limit of Spark's variants; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Publishers' role names.
ROLES = {"human": "user", "prompter": "user", "customer": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: layout name -> (an example record, how to read it). ``each``: path of an array, with paths of role and text in each
#: element; ``fixed``: (role, path) pairs in order. ``roles``: the names that a layout's publishers use; where there are none,
#: roles are taken as they are. ``also``: records of another shape that are read alike.
LAYOUTS: dict[str, dict] = {
    "messages": {"like": '{"messages":[{"content":"","role":""}]}', "also": '{"messages":[]}', "each": ("$.messages", "$.role", "$.content")},
    "conversations": {"like": '{"conversations":[{"from":"","value":""}]}', "also": '{"conversations":[]}', "each": ("$.conversations", "$.from", "$.value"), "roles": ROLES},
    "turns": {"like": '{"turns":[{"speaker":"","text":""}]}', "also": '{"turns":[]}', "each": ("$.turns", "$.speaker", "$.text"), "roles": ROLES},
    "prompt_response": {"like": '{"prompt":"","response":""}', "fixed": (("user", "$.prompt"), ("assistant", "$.response"))},
    "prompt_completion": {"like": '{"completion":"","prompt":""}', "fixed": (("user", "$.prompt"), ("assistant", "$.completion"))},
    "question_answer": {"like": '{"answer":"","question":""}', "fixed": (("user", "$.question"), ("assistant", "$.answer"))},
    "instruction": {"like": '{"instruction":"","output":""}', "fixed": (("user", "$.instruction"), ("assistant", "$.output"))},
    "instruction_input": {"like": '{"input":"","instruction":"","output":""}', "fixed": (("system", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))},
    "nested_data": {"like": '{"data":{"assistant":"","system":"","user":""}}', "fixed": (("system", "$.data.system"), ("user", "$.data.user"), ("assistant", "$.data.assistant"))},
}
#: Turns of which the places are summed up at once.
BLOCK_TURNS = 256
#: Spark's variants hold 128 MiB at most, and beyond that try_parse_json gives null as for what isn't JSON. A variant has its
#: own overhead, so the size of the record that no longer fits is below that by an amount that depends on its layout.
LARGE_BYTES = 16 << 20


def field_paths(parsed: Column) -> Column:
    """The nested field names of a parsed record, in code point order, without the types of its leaves."""
    shape = F.schema_of_variant(parsed)
    return F.regexp_replace(shape, r": (STRING|VOID|BIGINT|DOUBLE|BOOLEAN|DECIMAL\(\d+,\d+\)|VARIANT)", "")


def fingerprint(parsed: Column) -> Column:
    """A hash of the nested field paths of a parsed record; null where it isn't JSON."""
    return F.when(parsed.isNotNull(), F.xxhash64(field_paths(parsed)))


def _texts(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _turn(role: Column, text: Column, roles: dict[str, str] | None = None) -> Column:
    named = F.coalesce(F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])[role], role) if roles else role
    return F.struct(_texts(named).alias("role"), _texts(text).alias("text"))


def _element(role: str, text: str, roles: dict[str, str] | None) -> Callable[[Column], Column]:
    return lambda v: _turn(F.try_variant_get(v, role, "string"), F.try_variant_get(v, text, "string"), roles)


def canonical_turns(parsed: Column, layout_hash: Column, layouts: dict[str, dict] = LAYOUTS) -> Column:
    """The turns of a parsed record in the layout that its fingerprint names; null for unknown layouts."""
    out = F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout in layouts.values():
        if "each" in layout:
            many, role, text = layout["each"]
            turns = F.transform(F.try_variant_get(parsed, many, "array<variant>"), _element(role, text, layout.get("roles")))
        else:
            turns = F.array(*[_turn(F.lit(role), F.try_variant_get(parsed, path, "string")) for role, path in layout["fixed"]])
        known = F.lit(False)
        for example in (layout["like"], layout.get("also", layout["like"])):
            known = known | (layout_hash == fingerprint(F.try_parse_json(F.lit(example))))
        out = F.when(known, turns).otherwise(out)
    return out


def escaped(text: Column) -> Column:
    """``text`` without control strings, reversibly."""
    return F.replace(F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("<turn"), F.lit("%3Cturn")), F.lit("</turn"), F.lit("%3C/turn"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def _escaped_role(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit(">"), F.lit("%3E")), F.lit("\n"), F.lit("%0A"))


def _unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(F.replace(role, F.lit("%3E"), F.lit(">")), F.lit("%0A"), F.lit("\n")))


def formatted(turns: Column) -> Column:
    """The training text of canonical turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<turn "), _escaped_role(t["role"]), F.lit(">\n"), escaped(t["text"]), F.lit("</turn>\n"))), "")


def _places(sizes: Column) -> Column:
    """The sum of all earlier ``sizes`` for each: within blocks of BLOCK_TURNS and over the blocks, so long arrays aren't copied for each of their elements."""
    zero, n = F.lit(0).cast("long"), F.lit(BLOCK_TURNS)

    def before(values: Column) -> Column:
        return F.aggregate(
            values, F.struct(zero.alias("sum"), F.array().cast("array<long>").alias("got")), lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.array_append(a["got"], a["sum"]).alias("got")),
        )["got"]

    starts = F.when(F.size(sizes) > 0, F.sequence(F.lit(0), (F.size(sizes) - 1).cast("int"), n)).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda i: F.slice(sizes, i + 1, n))
    totals = before(F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: a + x)))
    return F.flatten(F.zip_with(blocks, totals, lambda b, t: F.transform(before(b), lambda x: x + t)))


def parts(text: Column) -> Column:
    """What a formatted text says: head (role) and body (text), as written (escaped), from and n (code points) of each turn."""
    turns = F.filter(F.split(text, "</turn>\n"), lambda x: x != "")
    cut = F.transform(turns, lambda x: F.struct(F.substring_index(x, ">\n", 1).alias("head"), x.alias("all")))
    cut = F.transform(cut, lambda x: F.struct(F.substr(x["head"], F.lit(7)).alias("head"), F.substr(x["all"], F.length(x["head"]) + 3).alias("body")))
    frame = F.lit(len("<turn >\n</turn>\n"))
    # an array of one makes the cut turns once for both uses
    return F.transform(F.array(cut), lambda c: F.zip_with(
        c, _places(F.transform(c, lambda x: (F.length(x["head"]) + F.length(x["body"]) + frame).cast("long"))),
        lambda x, at: F.struct(x["head"].alias("head"), x["body"].alias("body"), (at + F.length(x["head"]) + F.lit(len("<turn >\n"))).cast("int").alias("from"), F.length(x["body"]).alias("n")),
    ))[0]


def turns_of(text: Column) -> Column:
    """Canonical turns read back from a formatted text."""
    return F.transform(parts(text), lambda p: F.struct(_unescaped_role(p["head"]).alias("role"), unescaped(p["body"]).alias("text")))


def loss_mask(text: Column, roles: tuple[str, ...] = ("assistant",)) -> Column:
    """The spans (from, n in code points, counted from 0) of a formatted text that a model is trained on."""
    return F.transform(F.filter(parts(text), lambda p: _unescaped_role(p["head"]).isin(*roles)), lambda p: F.struct(p["from"], p["n"]))


def masked_text(text: Column, mask: Column) -> Column:
    """The text under a loss mask, unescaped span by span, nothing between."""
    return F.array_join(F.transform(mask, lambda s: unescaped(F.substr(text, s["from"] + 1, s["n"]))), "")


def records_of_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows -> conv_id and record, a JSON record in the layout that suits the conversation's shape.

    A user and an assistant turn are a prompt and its response; a system, a user and an assistant turn are nested data;
    other conversations of these three roles are from/value pairs under their publisher's names; all else, with whatever
    roles, is messages. A conversation is one training example and so one row; a common first turn or host does not group
    conversations.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    said = lambda i: F.col("_turns")[i]["content"]
    shape = F.transform("_turns", lambda t: t["role"])
    messages = F.transform("_turns", lambda t: F.struct(t["content"].alias("content"), t["role"].alias("role")))
    published = lambda role: F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    pairs = F.transform("_turns", lambda t: F.struct(published(t["role"]).alias("from"), t["content"].alias("value")))
    named = lambda *roles: shape == F.array(*[F.lit(r) for r in roles])
    record = (
        F.when(named("user", "assistant"), F.to_json(F.struct(said(0).alias("prompt"), said(1).alias("response"))))
        .when(named("system", "user", "assistant"), F.to_json(F.struct(F.struct(said(2).alias("assistant"), said(0).alias("system"), said(1).alias("user")).alias("data"))))
        .when(F.forall(shape, lambda r: r.isin("user", "assistant", "system")), F.to_json(F.struct(pairs.alias("conversations"))))
        .otherwise(F.to_json(F.struct(messages.alias("messages"))))
    )
    return grouped.select("conv_id", record.alias("record"))


def format_records(records: DataFrame, record: str = "record", large_bytes: int = LARGE_BYTES) -> DataFrame:
    """Adds layout_hash, turns, formatted and mask to records of any known layouts; ``record`` and clashing columns go.

    Fails on a record of ``large_bytes`` or more that doesn't parse, rather than lose its turns.
    """
    ours = ["layout_hash", "turns", "formatted", "mask"]
    parsed = records.drop(*ours).withColumn("_parsed", F.try_parse_json(record))
    lost = F.col("_parsed").isNull() & (F.octet_length(record) >= large_bytes)
    error = F.raise_error(F.concat(F.lit("a record doesn't parse, or is too large for a variant; its bytes: "), F.octet_length(record).cast("string"))).cast("long")
    parsed = parsed.withColumn("layout_hash", F.when(lost, error).otherwise(fingerprint(F.col("_parsed"))))
    out = parsed.withColumn("turns", canonical_turns(F.col("_parsed"), F.col("layout_hash"))).withColumn("formatted", formatted(F.col("turns")))
    return out.withColumn("mask", loss_mask(F.col("formatted"))).drop(record, "_parsed")
