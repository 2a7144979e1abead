"""The queries of this subpackage: op1 to op13 and the pipeline, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import chat, collision_search, decontaminate, jaccard_join, license_scan, media, mixing, prefix_trie, quality, sharding, substring_dedup, warc, whitening
from flowloom.plans.scratch import new_path, written
from flowloom.plans.session import bounded_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.Mix(_table(spark, sf_dir, "documents"), block_words=128, shard_slots=4096)
    return mix.taken().select("doc_id", "size", "source_size", "target", "taken")


def op2_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.filter((F.size("sentences") > 0) | (F.size("licenses") > 0)).select(
        "doc_id", F.array_join(F.transform("sentences", lambda x: x["id"]), ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"),
    )


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(_table(spark, sf_dir, "documents"), words=4, percent=85)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op5_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    manifest = written(warc.write_archives(_table(spark, sf_dir, "pages"), folder), "warc-manifest")
    return warc.read_archives(spark, folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.with_scores(docs, quality.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


def op7_shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_places(_table(spark, sf_dir, "documents"), shards=8)


#: The conversation that holds what a template might take for its own controls.
TRICKY = "\\### Assistant: </turn> ok"


def op8_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    made = chat.format_records(chat.records_of_turns(rows.unionByName(probe)))
    back, under = chat.turns_of(F.col("formatted")), chat.masked_text(F.col("formatted"), F.col("mask"))
    said = F.array_join(F.transform(back, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id", F.size(back).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(under).cast("long").alias("loss_chars"),
        F.sha2(under, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_benchmark_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontaminate.Index(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), length=10)
    return index.report().select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_table(spark, sf_dir, "documents"))


def op11_whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return whitening.long_form(whitening.fit(rows, "embedding", components=32), rows)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = written(prefix_trie.numbered_turns(_table(spark, sf_dir, "conversations")), "numbered-turns")
    conv = F.col("conv_id")
    rebuilt, convs = prefix_trie.with_borrowed_heads(turns, conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4, most=3)
    return prefix_trie.prefix_trie(rebuilt, convs)


def op13_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return collision_search.nearest(rows, rows.filter(F.col("vec_id") % 100 == 0), k=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ours = (
        op1_mix_sources, op2_license_rules, op3_ngram_jaccard, op4_substring_dedup, op5_warc_roundtrip, op6_line_crf, op7_shard_rows, op8_format_chats, op9_benchmark_index, op10_media_columns,
        op11_whiten_embeddings, op12_prefix_trie, op13_collision_search,
    )
    return {f.__name__: f for f in ours}


OP5_SQL = """
WITH p AS (SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, coalesce(url, '')) AS place FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 100 OR first_id IS NULL OR place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND place > 1 THEN first_id END AS refers_to
FROM f
"""

OP8_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '%', '%25'), '<turn', '%3Cturn'), '</turn', '%3C/turn') AS esc FROM r
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(length('<turn ' || role || '>' || chr(10) || esc || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x{80}-\x{10FFFF}]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x{80}-\x{10FFFF}]+'), lambda x: x <> '') AS w FROM benchmark
), bs AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM bs),
ns AS (SELECT DISTINCT n FROM bw),
ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n),
m AS (SELECT doc_id, i, ds.n, item_id FROM ds JOIN bw ON bw.n = ds.n AND bw.phrase = array_to_string(w[i:i + ds.n - 1], ' ')),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id)
"""


OP12_SQL = r"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS donor, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM own)
), joined AS (
  SELECT c.conv_id, pos, 0 AS part, role, text FROM convs c JOIN own o ON o.conv_id = c.donor AND pos <= h
  UNION ALL SELECT c.conv_id, pos, 1, role, text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND pos > h
), said AS (
  SELECT conv_id, row_number() OVER w AS d, role, text, count(*) OVER (PARTITION BY conv_id) AS n_turns, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w AS upto
  FROM joined WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
), path AS (
  SELECT conv_id, d, sha256(upto) AS key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, n_turns FROM said
  UNION ALL SELECT conv_id, 0, '', 0, (SELECT count(*) FROM joined j WHERE j.conv_id = convs.conv_id) FROM convs
), node AS (
  SELECT key, d, min(conv_id) AS conv_id, count(*) AS n, max(words) AS words, string_agg(CASE WHEN n_turns = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ends FROM path GROUP BY key, d
), linked AS (
  SELECT node.*, p.key AS parent FROM node LEFT JOIN path p ON p.conv_id = node.conv_id AND p.d = node.d - 1
), born AS (SELECT parent AS key, count(*) AS n_children FROM linked WHERE parent IS NOT NULL GROUP BY parent),
full_node AS (SELECT linked.*, coalesce(n_children, 0) AS n_children FROM linked LEFT JOIN born USING (key)),
sums AS (
  SELECT p.key, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum((f.n - 1) * f.words)::BIGINT AS saved_tokens
  FROM full_node f JOIN path p ON p.conv_id = f.conv_id AND p.d <= f.d GROUP BY p.key
)
SELECT f.conv_id, f.d AS depth, up.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, n_leaves, saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM full_node f JOIN sums USING (key) LEFT JOIN node up ON up.key = f.parent
"""


def _license_sql() -> str:
    """The same table and rules by joins: places by a sentence's first words, then the whole sentence; containment by a running maximum."""
    scan = license_scan
    sentences = ", ".join(f"('{name}', '{s}', NULL)" for name, s in scan.SENTENCES.items())
    names = ", ".join(f"('{scan.reference_id(license)}', '{license}', '{name}')" for license, all_names in scan.NAMES.items() for name in all_names)
    leads = ", ".join(f"('{lead}')" for lead in scan.LEADS)
    ids = ", ".join(f"('{license}')" for license in sorted({*scan.RULES, *scan.NAMES}))
    denials = ", ".join(f"'{w}'" for w in scan.NEGATIONS)

    def matched(name: str) -> str:
        return "(" + " OR ".join(f"regexp_matches(said, '{scan.pattern(way)}')" for way in scan.RULES.get(name, [])) + ")"

    rules = " UNION ALL ".join(
        f"SELECT r, '{name}' AS license FROM seq WHERE {matched(name)}" + (f" AND NOT {matched(scan.PART_OF[name])}" if name in scan.PART_OF else "") for name in sorted(scan.RULES))
    return rf"""
WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{scan.UPPER}|', '{scan.LOWER} ') AS t FROM documents),
sentences(id, s, license) AS (VALUES {sentences}), names(id, license, name) AS (VALUES {names}), leads(lead) AS (VALUES {leads}), ids(license) AS (VALUES {ids}),
known AS MATERIALIZED (
  SELECT *, array_to_string(string_split(s, ' ')[1:{scan.ANCHOR}], ' ') AS anchor, len(string_split(s, ' ')) AS n
  FROM (SELECT * FROM sentences UNION ALL SELECT id, lead || ' ' || name, license FROM names, leads)
), parts AS (
  SELECT r, list_filter(list_transform(string_split_regex(t, '{scan.ENDS}'), lambda p: trim(regexp_replace(p, '[^a-z0-9]+', ' ', 'g'))), lambda p: p <> '') AS ps FROM texts
), part AS (SELECT r, unnest(ps) AS p, generate_subscripts(ps, 1) AS u FROM parts),
split AS (SELECT r, u, string_split(p, ' ') AS ws FROM part),
word AS (SELECT r, u, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM split),
placed AS MATERIALIZED (
  SELECT r, u, w, row_number() OVER o AS i, concat_ws(' ', w, lead(w) OVER o, lead(w, 2) OVER o) AS anchor FROM word WINDOW o AS (PARTITION BY r ORDER BY u, k)
), starts AS (SELECT p.r, p.i, p.u, k.id, k.s, k.n, k.license FROM placed p JOIN known k USING (anchor)),
whole AS (SELECT r, list(w ORDER BY i) AS ws, list(u ORDER BY i) AS us FROM placed WHERE r IN (SELECT r FROM starts) GROUP BY r),
hit AS (
  SELECT r, i, i + n - 1 AS e, u AS first, us[i + n - 1] AS last, id, license, ws, us
  FROM starts JOIN whole USING (r) WHERE array_to_string(ws[i:i + n - 1], ' ') = s QUALIFY row_number() OVER (PARTITION BY r, i ORDER BY n DESC) = 1
), outer_hit AS (
  SELECT *, len(list_filter(range(greatest(1, i - {scan.NEAR}), i), lambda j: us[j] = first AND ws[j] IN ({denials}))) > 0 AS denied
  FROM hit QUALIFY coalesce(max(e) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < e, true)
), found AS (
  SELECT r, i, id, license, coalesce(first - lag(last) OVER (PARTITION BY r ORDER BY i), 0) AS apart FROM outer_hit WHERE license IS NULL OR NOT denied
), seq AS (
  SELECT r, string_agg(id, ',' ORDER BY i) AS sentence_ids, string_agg(repeat(';', greatest(0, least({scan.GAP + 2}, apart))) || '<' || id || '>', '' ORDER BY i) AS said FROM found GROUP BY r
), lines AS (SELECT r, unnest(regexp_extract_all(t, '{scan.SPDX_LINE}', 1)) AS e FROM texts WHERE contains(t, 'spdx-license-identifier')),
tags AS (SELECT r, regexp_replace(tag, '{scan.SPDX_TAIL}', '') AS tag FROM (SELECT r, unnest(string_split_regex(e, '{scan.SPDX_ENDS}')) AS tag FROM lines)),
hits AS (
  {rules} UNION ALL SELECT r, license FROM found WHERE license IS NOT NULL UNION ALL SELECT r, license FROM tags JOIN ids ON lower(license) = tag
), named AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM hits GROUP BY r)
SELECT doc_id, coalesce(sentence_ids, '') AS sentence_ids, coalesce(licenses, CASE WHEN contains(said, '<{scan.RESERVED}>') THEN '{scan.OWN}' ELSE '' END) AS licenses
FROM texts LEFT JOIN seq USING (r) LEFT JOIN named USING (r) WHERE said IS NOT NULL OR licenses IS NOT NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_rules": _license_sql(), "op9_benchmark_index": OP9_SQL, "op5_warc_roundtrip": OP5_SQL, "op8_format_chats": OP8_SQL, "op12_prefix_trie": OP12_SQL}
