"""JSON of unknown shape as rows, and the per-class measurements in it.

A document becomes a row for each of its values, level by level: ``variant_explode`` opens all objects and arrays of a level in one
narrow pass, without a shuffle and without a schema, so documents of any shape and depth can stand in one column. There are as many
passes as the deepest document has levels; each is written, so none is computed twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators import attribution, coherence, reports
from flowloom.plans.scratch import written

NOT_SUPPLIED = "not_supplied"


#: Kinds by the first word of a value's schema.
KINDS = {"OBJECT": "object", "ARRAY": "array", "VOID": "null", "STRING": "string", "BOOLEAN": "boolean", "BIGINT": "number", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number"}


def _kind(value: Column) -> Column:
    """The schema is read once, not once a kind: that of a container takes a walk through all of it."""
    shape = F.schema_of_variant(value)
    names = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.regexp_extract(shape, "^[A-Z]+", 0)), F.lower(shape))


def _once(column: Column) -> Column:
    """Made by a generator, which is evaluated once, however often the column is used."""
    return F.explode(F.array(column))


def _read(level: DataFrame) -> DataFrame:
    """A level with kind, number and text; only containers keep their value, for the next level."""
    level = level.select("*", _once(F.when(F.col("value").isNull(), "malformed").otherwise(_kind(F.col("value")))).alias("kind"))
    kind, value = F.col("kind"), F.col("value")
    number = F.when(kind == "number", F.try_variant_get("value", "$", "double"))
    text = F.when(kind.isin("string", "number", "boolean"), F.try_variant_get("value", "$", "string"))
    return level.withColumns({"number": number, "text": text, "value": F.when(kind.isin("object", "array"), value)})


def json_paths(docs: DataFrame, json: str, keys: list[str]) -> DataFrame:
    """``keys`` and path, steps, kind, number, text of each value of a JSON column, containers included. [M21]

    ``path`` is like ``$.a[0].b``; ``steps`` holds the same keys and places apart, so that keys with dots stay whole. ``kind`` is
    object, array, string, number, boolean, null, or malformed (path ``$``) where a text isn't JSON or repeats a key in an object.
    ``number`` and ``text`` are the value where the kind is number, or string, number or boolean. A null document has no rows;
    repeated documents have rows each.
    """
    clash = {"path", "steps", "kind", "number", "text"} & set(keys)
    if clash:
        raise ValueError(f"keys would clash with columns of the result: {sorted(clash)}")
    given = docs.select(*keys, _once(docs[json]).alias("text")).filter("text IS NOT NULL")
    level = given.select(*keys, F.lit("$").alias("path"), F.array().cast("array<string>").alias("steps"), _once(F.try_parse_json("text")).alias("value"))
    levels = []
    while True:
        level = written(_read(level), "json-level")
        levels.append(level)
        inner = level.filter(F.col("kind").isin("object", "array"))
        if inner.isEmpty():
            break
        opened = inner.alias("outer_row").lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("outer_row.value").outer()).alias("inner_row"))
        key, pos, value = F.col("inner_row.key"), F.col("inner_row.pos").cast("string"), F.col("inner_row.value")
        step = F.when(F.col("outer_row.kind") == "object", F.concat(F.lit("."), key)).otherwise(F.concat(F.lit("["), pos, F.lit("]")))
        level = opened.select(
            *[F.col(f"outer_row.{k}").alias(k) for k in keys], F.concat(F.col("outer_row.path"), step).alias("path"),
            F.concat(F.col("outer_row.steps"), F.array(F.coalesce(key, pos))).alias("steps"), value.alias("value"))
    every = levels[0]
    for one in levels[1:]:
        every = every.unionByName(one)
    return every.select(*keys, "path", "steps", "kind", "number", "text")


def per_class(paths: DataFrame, prefix: list[str], fields: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """``keys``, cls and a double for each of ``fields`` (name in the JSON -> column), of the objects by class below ``prefix``. [M21]

    A field that is absent, null or no number is null; a text that reads as a number is one. A class whose object is there but
    empty keeps a row.
    """
    keys, deep = keys or [], len(prefix)
    here = F.slice("steps", 1, deep) == F.array(*[F.lit(p) for p in prefix])
    rows = paths.filter(here & (F.size("steps") >= deep + 1)).withColumn("cls", F.get("steps", F.lit(deep)))
    number = F.coalesce("number", F.when(F.col("kind") == "string", F.col("text").try_cast("double")))
    mine = lambda f: (F.size("steps") == deep + 2) & (F.get("steps", F.lit(deep + 1)) == f)
    return rows.groupBy(*keys, "cls").agg(*[F.max(F.when(mine(f), number)).alias(name) for f, name in fields.items()])


def structural_coherence(edges: DataFrame, stage: DataFrame, expectations: DataFrame | None = None) -> DataFrame:
    """cls, ours, literature, measured, agreement, n_edges and the measurements: three topologies of each class compared. [M21, M22]

    ``edges``: cls, src, dst of the explanations' edges; ``stage``: cls, n_src, n_dst and more measurements, which pass;
    ``expectations``: cls, literature, given by the user. A class that is in one of the first two only has an indeterminate
    topology in the other; without an expectation the literature is not_supplied.
    """
    ours = attribution.topology(edges).select("cls", F.col("kind").alias("ours")).join(edges.groupBy("cls").agg(F.count("*").alias("n_edges")), "cls")
    measured = stage.join(reports.stage_topology(stage.select("cls", "n_src", "n_dst")).withColumnRenamed("topology", "measured"), "cls")
    if expectations is None:
        expectations = edges.sparkSession.createDataFrame([], "cls string, literature string")
    missing = {"cls", "literature"} - set(expectations.columns)
    if missing:
        raise ValueError(f"the expectations lack columns: {sorted(missing)}")
    both = ours.join(measured, "cls", "full").join(expectations.select("cls", "literature"), "cls", "left")
    both = both.withColumns({"ours": F.coalesce("ours", F.lit("indeterminate")), "measured": F.coalesce("measured", F.lit("indeterminate")), "literature": F.coalesce("literature", F.lit(NOT_SUPPLIED)), "n_edges": F.coalesce("n_edges", F.lit(0))})
    kept = [c for c in stage.columns if c != "cls"]
    return both.select("cls", "ours", "literature", "measured", coherence.three_way_agreement(F.col("ours"), F.col("literature"), F.col("measured")).alias("agreement"), "n_edges", *kept)
