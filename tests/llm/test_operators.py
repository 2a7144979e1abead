"""The text operators on small tables: nulls, empties, repeats, long texts, ties, clashing columns, and brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from flowloom.llm import chat, decontaminate, jaccard_join, license_scan, media, mixing, numbering, quality, queries, sharding, substring_dedup, warc
from flowloom.plans.scratch import new_path, written

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def words(n, start=0):
    return " ".join(f"w{start + i}x{(start + i) * 7919 % 1000}" for i in range(n))


EDGE = [(1, None, "a"), (2, "", None), (3, "one", "a"), (3, "one", "a"), (4, words(30_000), "b"), (None, words(40), "b"), (6, words(40), None), (7, words(40, 100), "a"), (8, "Été 字\U0001f600 café", "b")]


# mixing


def counted(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def expected_targets(sizes):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, done = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in done]
        left = total - sum(done.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] >= 2 * sizes[s]]
        if not over:
            return done | share
        done |= {s: 2.0 * sizes[s] for s in over}
        if len(done) == len(names):
            return done


def test_mix_targets_and_bounds(spark):
    rows = make(spark, [(i, words(20 + i % 70, i), f"s{i % 7}" if i % 11 else None) for i in range(600)])
    got = mixing.Mix(rows, block_words=8, shard_slots=64).taken().toPandas()
    sizes = defaultdict(int)
    for r in rows.collect():
        sizes[r["source"]] += counted(r["text"])
    want = expected_targets(sizes)
    for source, part in got.groupby("source", dropna=False):
        source = None if pd.isna(source) else source
        assert part["source_size"].iloc[0] == sizes[source]
        assert part["target"].iloc[0] == pytest.approx(want[source])
        assert part["taken"].sum() == pytest.approx(want[source], abs=16)
    assert (got["taken"] <= 2 * got["size"]).all()
    again = mixing.Mix(rows.repartition(7), block_words=8, shard_slots=64).taken().toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, again[key].values.tolist()))


def test_mix_edges(spark):
    got = mixing.Mix(make(spark, EDGE), block_words=16).taken()
    assert got.count() == len(EDGE)
    assert {r["size"] for r in got.filter("doc_id IN (1, 2)").collect()} == {0}
    assert mixing.Mix(make(spark, [])).taken().count() == 0
    assert mixing.Mix(make(spark, [(1, None, None)])).taken().collect()[0]["taken"] == 0


def test_block_permutation_is_a_bijection(spark):
    for n in (1, 2, 3, 10, 257):
        out = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5), F.lit(1)).alias("p"))
        assert sorted(r["p"] for r in out.collect()) == list(range(n))


def test_mixed_documents_hold_the_taken_words(spark):
    rows = make(spark, [(i, words(50 + i % 40, 100 * i), f"s{i % 4}") for i in range(80)] + [(None, words(30), "s1"), (5000, words(30), "s1"), (5000, words(30), "s1")])
    out = mixing.mixed_documents(rows, block_words=8).collect()
    taken = mixing.Mix(rows, block_words=8).taken().agg(F.sum("taken")).first()[0]
    assert sum(counted(r["text"]) for r in out) == taken
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    text = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert all(set(r["text"].split()) <= set(text[r["doc_id"]].split()) for r in out)


# licenses


def test_license_rules(spark):
    texts = ["Foo.\nReleased under the MIT License.", "ALL RIGHTS RESERVED!", None, "", "nothing here", "You may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://x",
             "You may obtain a copy of the License at\nYou may not use this file except in compliance with the License.", "Licensed under the Apache License, Version 2.0\nLicensed under the Apache License, Version 2.0"]
    far = "You may not use this file except in compliance with the License.\na\nb\nc\nd\nYou may obtain a copy of the License at"
    rows = make(spark, [(i, t, "s") for i, t in enumerate([*texts, far])]).withColumn("licenses", F.lit("clash"))
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan(rows).collect()}
    assert got == {0: ["MIT"], 1: ["Proprietary"], 2: [], 3: [], 4: [], 5: ["Apache-2.0"], 6: [], 7: ["Apache-2.0"], 8: []}
    assert license_scan.scan(rows.limit(0)).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAMES = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at"""


def test_licenses_of_wrapped_texts_and_clauses(spark):
    def comment(text, by):
        return "\n".join(by + line for line in text.split("\n"))

    want = {"MIT": MIT, "BSD-2-Clause": BSD, "BSD-3-Clause": BSD + NAMES, "GPL-3.0": GPL, "GPL-2.0": GPL.replace("version 3", "version 2"), "Apache-2.0": APACHE,
            "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla\nPublic License, v. 2.0."}
    rows = [(name, form) for name, text in want.items() for form in (text, comment(text, "# "), "/*\n" + comment(text, " * ") + "\n */", comment(text, "// ").replace("\n", "\r\n"), "x | y @mit_ref@\n" + text)]
    rows += [("MIT", "This project is released under the MIT License."), ("", "unreleased under the MIT License"), ("", "@mit_ref@ | all rights"), ("", MIT.replace("The above", "a\nb\nc\nThe above"))]
    docs = spark.createDataFrame([(i, w, t) for i, (w, t) in enumerate(rows)], "doc_id long, want string, text string")
    assert [(r["doc_id"], r["want"]) for r in license_scan.scan(docs).collect() if ",".join(r["licenses"]) != r["want"]] == []


def test_licenses_named_denied_and_between(spark):
    reserved = "Copyright (c) 2001 A Person. All rights reserved.\n\n"
    grant, notice = MIT.split("\n\n")
    cases = [
        ("BSD-2-Clause", reserved + BSD), ("MIT", f"{grant}\n\nAll rights reserved.\n\n{notice}"), ("", f"{grant}\na\nAll rights reserved.\nb\n{notice}".replace("reserved", "kept")),
        ("", "This is not released under the MIT License."), ("", "It isn't licensed under the Apache License, Version 2.0"), ("MIT", "Not free.\nReleased under the MIT License"),
        ("", "no longer available under the MIT license"), ("MIT", "# SPDX-License-Identifier: MIT"), ("Apache-2.0,MIT", "/* SPDX-License-Identifier: (MIT OR Apache-2.0) */"),
        ("GPL-2.0", "// spdx-license-identifier: GPL-2.0-or-later WITH Classpath-exception-2.0"), ("", "SPDX-License-Identifier: None-Known"), ("LGPL-2.1", "SPDX-License-Identifier:\tLGPL-2.1+\r\n"),
        ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-SA-4.0", "Available under the Creative Commons Attribution-ShareAlike 4.0 International License"), ("CC-BY-4.0", "licensed under CC BY 4.0"),
        ("Apache-2.0,MIT", "Licensed under the Apache License, Version 2.0\nor released under the MIT license"), ("Proprietary", "All rights reserved"), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
        ("AGPL-3.0", "distributed under the terms: licensed under AGPLv3"), ("", "license"), ("Zlib", "It's released under the zlib\n# license"), ("MIT", "word " * 300_000 + "released under the MIT license" + " word" * 300_000),
        ("MIT", "released under the MIT license\n" * 2_000), ("MIT", "released under the MIT license "),
    ]
    rows = [(i, want, text) for i, (want, text) in enumerate(cases)] + [(0, *cases[0]), (None, *cases[1])]
    docs = spark.createDataFrame(rows, "doc_id long, want string, text string")
    assert [(r["doc_id"], r["want"], r["licenses"]) for r in license_scan.scan(docs).collect() if ",".join(r["licenses"]) != r["want"]] == []
    two = license_scan.scan(docs.filter("doc_id = 17")).first()["sentences"]
    assert [x["id"] for x in two] == ["gpl3_ref"]  # the reference within it doesn't count
    plan = license_scan.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "EvalPython" not in plan and "InPandas" not in plan


def test_license_sql_knows_the_same(spark, tmp_path):
    import duckdb

    grant, notice = MIT.split("\n\n")
    texts = [MIT, BSD, BSD + NAMES, "All rights reserved.\n" + BSD, GPL, APACHE, f"{grant}\nx\ny\nz\n{notice}", f"{grant}\nAll rights reserved.\n{notice}", "It's not released under the MIT license", None, "", "|",
             "SPDX-License-Identifier: MIT AND (BSD-3-Clause OR GPL-3.0+)", "This work is licensed under the GNU General Public License, version 3. All rights reserved.", "all rights reserved", "licensed under the gplv2; released under cc by-nc-sa 4.0"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, MIT])], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = base.execute("SELECT doc_id, sentence_ids, licenses FROM (" + queries.oracle_sql()["op2_license_rules"] + ")").fetchall()
    got = [(r["doc_id"], r["sentence_ids"], r["licenses"]) for r in queries.op2_license_rules(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(got) > 10


# Jaccard join


def brute_components(rows, k, percent):
    sets = []
    for i, t in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets.append((i, set() if not w else ({tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)})))
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= percent * len(sets[a][1] | sets[b][1]):
                up[root(a)] = root(b)
    groups = defaultdict(list)
    for x in range(len(sets)):
        groups[root(x)].append(sets[x][0])
    out = []
    for x, (i, s) in enumerate(sets):
        known = [d for d in groups[root(x)] if d is not None]
        out.append((i, len(s), i if not s else min(known, default=None)))
    return sorted(out, key=repr)


def variants(seed, n, length, edits):
    rng = np.random.default_rng(seed)
    base = [f"t{rng.integers(10**6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.integers(0, length, rng.integers(0, edits)):
            w[at] = f"e{rng.integers(10**6)}"
        out.append(" ".join(w))
    return out


def test_jaccard_against_brute_force(spark):
    shared = words(30, 9000)
    texts = variants(1, 60, 150, 7) + variants(2, 25, 60, 4) + [words(100, 1000 * i) + " " + shared for i in range(40)] + [shared, shared + " x", "a b", "A b", "a b c", "", None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (None, "lonely words here now yes"), (2, texts[9]), (2, texts[2])]
    df = make(spark, [(i, t, "s") for i, t in rows])
    for k, percent in ((4, 85), (5, 80)):
        got = sorted([tuple(r) for r in jaccard_join.components(df, k, percent).collect()], key=repr)
        assert got == brute_components(rows, k, percent)


def test_jaccard_edges(spark):
    assert jaccard_join.components(make(spark, [])).count() == 0
    assert sorted(map(tuple, jaccard_join.components(make(spark, [(2, "", "s"), (1, None, "s")])).collect())) == [(1, 0, 1), (2, 0, 2)]
    kept = jaccard_join.one_per_component(make(spark, EDGE)).collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == [1, 2, 3, 4, 6, 7, 8]


def test_jaccard_sample_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted([tuple(r) for r in queries.op3_ngram_jaccard(spark, sf_dir).collect()], key=repr)
    assert got == brute_components(rows, 4, 85)


# substring dedup


def test_repeated_passages(spark):
    passage = " ".join(variants(5, 1, 55, 1))
    rows = [(i, words(80, 5000 * i), "s") for i in range(20)]
    rows += [(100 + i, words(40 + i, 5000 * (50 + i)) + " " + passage + "\n" + words(30, 5000 * (80 + i)), "s") for i in range(6)] + [(200, None, "s"), (201, "", "s")]
    got = substring_dedup.repeated_passages(make(spark, rows)).collect()
    assert {r["doc_id"] for r in got} == {100 + i for i in range(6)}
    assert [r["doc_id"] for r in got if r["first"]] == [100]
    data = {i: t.encode() for i, t, _ in rows if t}
    assert all(data[r["doc_id"]][r["begin"] : r["end"]] in passage.encode() + b"\n" for r in got)
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(make(spark, rows)).collect()}
    assert cut[100] == data[100].decode() and len(cut[101]) < len(data[101]) - 150 and cut[3] == data[3].decode() and cut[200] is None
    assert substring_dedup.repeated_passages(make(spark, [])).count() == 0


def test_each_shared_chunk_stays_once(spark):
    a, c = words(60), words(60, 7000)
    rows = [(1, a, "s"), (5, a + "\n" + c, "s"), (7, a + "\n" + c, "s"), (9, words(70, 20_000), "s")]
    got = {(r["doc_id"], r["first"]): (r["begin"], r["end"]) for r in substring_dedup.repeated_passages(make(spark, rows)).collect()}
    assert set(got) == {(1, True), (5, True), (5, False), (7, False)}
    assert got[5, False][1] == got[5, True][0] and got[7, False] == (0, len(rows[2][1]))
    left = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(make(spark, rows)).collect()}
    for begin, end in zip(*(lambda e: (np.r_[0, e[:-1]], e))(substring_dedup.chunk_ends(rows[1][1].encode()))):
        assert sum(rows[1][1][begin:end] in left[i] for i in (1, 5, 7)) == 1, (begin, end)
    assert left[1] == a and left[7] == "" and left[9] == rows[3][1]


def test_short_chunks_of_smaller_ids_stay_in_the_kept_copy(spark):
    line = words(12, 900)
    passage = words(40, 100) + " " + line + " " + words(40, 300)
    rows = [(1, line + " " + words(50, 5000), "s"), (5, passage, "s"), (7, passage, "s")]
    assert len({r["doc_id"] for r in substring_dedup.repeated_passages(make(spark, rows), 16).collect()}) == 3  # the line is shared with 1 too
    left = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(make(spark, rows)).collect()}
    assert left == {1: rows[0][1], 5: passage, 7: ""}


def test_chunks_resist_insertions():
    text = words(400).encode()
    more = text[:700] + b" inserted here " + text[700:]
    a, b = ({d[x:y] for x, y in zip(np.r_[0, e[:-1]], e)} for d, e in ((d, substring_dedup.chunk_ends(d)) for d in (text, more)))
    assert len(a & b) >= len(a) - 5
    assert b"".join(text[x:y] for x, y in zip(np.r_[0, substring_dedup.chunk_ends(text)[:-1]], substring_dedup.chunk_ends(text))) == text


# WARC


def test_warc_round_trip(spark):
    long = "<p>" + "x" * 300 + "</p>"
    rows = [(1, "http://a", long), (2, "http://b\r\nX: y", long), (3, None, "short"), (4, "u", "short"), (5, "u", None), (None, "u", long), (7, "%0D é", "é" * 60), (1, "http://a", long)]
    folder = new_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, archive_bytes=200).collect()
    got = warc.read_archives(spark, folder).collect()
    assert len(got) == len(rows)
    kinds = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in got), key=str)
    assert kinds == sorted([(1, "response", None), (1, "revisit", 1), (2, "revisit", 1), (3, "response", None), (4, "response", None), (5, "response", None), (None, "revisit", 1), (7, "response", None)], key=str)
    for r in got:
        html = next(h for p, _, h in rows if p == r["page_id"]) or ""
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html.encode()), hashlib.sha256(html.encode()).hexdigest())
        assert r["record_type"] == "revisit" or bytes(r["payload"]) == html.encode()
    assert {r["target"] for r in got} >= {"http://b\r\nX: y", "%0D é", ""}


def test_warc_repeated_first_holder(spark):
    page = "<p>" + "y" * 200 + "</p>"
    rows = [(5, "u", page), (5, "u", page), (5, "t", page), (7, "u", page), (9, "u", page), (None, "u", page), (11, "u", "z" * 150), (11, "u", "z" * 150)]
    folder = new_path(spark, "warc-repeats")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, archive_bytes=300).collect()
    got = warc.read_archives(spark, folder).collect()
    kinds = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in got), key=str)
    assert kinds == sorted([(5, "response", None), (5, "revisit", 5), (5, "revisit", 5), (7, "revisit", 5), (9, "revisit", 5), (None, "revisit", 5), (11, "response", None), (11, "revisit", 11)], key=str)
    assert [r["target"] for r in got if r["page_id"] == 5 and r["record_type"] == "response"] == ["t"]  # the least url


def test_numbering_of_a_hot_hash(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).alias("key")).withColumn("_hash", F.xxhash64("key"))
    made = numbering.numbered(rows, "_hash", ["_hash", "key"])
    got = made.toPandas()
    assert sorted(got["row_no"]) == list(range(40_000)) and set(got["row_total"]) == {40_000}
    again = numbering.numbered(rows.repartition(5), "_hash", ["_hash", "key"]).toPandas()
    assert dict(zip(got["row_no"], got["key"])) == dict(zip(again["row_no"], again["key"]))  # equal rows are interchangeable, others keep their places
    # the 20,000 equal rows are numbered in many windows
    assert made.filter("key = -1").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert numbering.numbered(rows.filter("key = 5"), "_hash", ["_hash", "key"]).collect()[0]["row_no"] == 0
    assert numbering.numbered(rows.filter("key = 4"), "_hash", ["_hash", "key"]).count() == 0


def test_join_verifies_one_row_of_a_class(spark):
    one, two = words(60), words(60)[:-3] + "zzz"
    rows = make(spark, [(1, one, "a")] * 40 + [(2, two, "a")] * 30 + [(3, one, "b")] * 20)
    join = jaccard_join.JaccardJoin(rows, 5, 80)
    pairs = join.classes().select("digest").collect()
    assert len(pairs) == 2
    wanted = spark.createDataFrame([(pairs[0][0], pairs[1][0])], "a string, b string")
    assert join.repeats and [tuple(r)[2:] for r in join.verified(wanted).collect()] == [(55, 56, 56)]
    assert join.texts(wanted, "a").count() == join.texts(wanted, "b").count() == 1  # not one of each repeated row
    out = join.components().collect()
    assert len(out) == 90 and {r["component_id"] for r in out} == {1}


def test_join_looks_texts_up_where_they_lie(spark):
    join = jaccard_join.JaccardJoin(make(spark, [(i, words(40, 100 * (i % 30)), "a") for i in range(90)]), 5, 80)
    wanted = written(join.classes().select(F.col("digest").alias("a")), "wanted")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = join.texts(wanted, "a")
        side = found._jdf.queryExecution().executedPlan().toString().split("Sort [_h#")[-1]
        assert "_text" in side and "Exchange" not in side and "SelectedBucketsCount" in side  # the wanted digests go to the texts, however many they are
        assert sorted(r["text"] for r in found.collect()) == sorted(words(40, 100 * i) for i in range(30))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_warc_reader_rejects(spark):
    import zstandard

    good = warc.record_bytes(1, "u", b"hello", hashlib.sha256(b"hello").hexdigest(), None)
    assert warc.parsed_record(good)[0] == 1
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WRAC/1.1"), good.replace(b"hello", b"hallo"), good.replace(b"Content-Length: 5", b"Content-Length: 6"), good.replace(b"WARC-Date", b"WARC-Dote")):
        with pytest.raises(ValueError):
            warc.parsed_record(bad)
    frame = zstandard.ZstdCompressor().compress(good)
    assert [r[0] for r in warc.read_archive(warc.dictionary_frame(b"") + frame + frame)] == [1, 1]
    with pytest.raises(ValueError):
        list(warc.read_archive(frame[:-3]))


def test_warc_empty(spark):
    folder = new_path(spark, "warc-empty")
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_archives(empty, folder).count() == 0


# quality


def test_quality_learns_and_scores_edges(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = {r["doc_id"]: r for r in queries.op6_line_crf(spark, sf_dir).collect()}
    assert len(got) == docs.count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1
    known = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in labels.collect() if r["doc_id"] in got]
    assert np.mean([a == b for a, b in known]) > 0.95
    model = quality.train(docs, labels)
    rows = make(spark, EDGE).withColumn("score", F.lit("clash"))
    scores = quality.with_scores(rows, model).select("score").toPandas()["score"]
    assert scores.between(0, 1).all() and len(scores) == len(EDGE)
    assert quality.with_scores(rows, quality.Model()).filter("score <> 1.0").count() == 0
    assert quality.train(docs.limit(0), labels).weights is None


def test_marginals_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    s, t = rng.normal(size=6), rng.normal(size=(2, 2))
    total, good = 0.0, np.zeros(6)
    for y in product((0, 1), repeat=6):
        p = np.exp(sum(s[i] * y[i] for i in range(6)) + sum(t[a, b] for a, b in zip(y, y[1:])))
        total += p
        good += p * np.array(y)
    assert quality.marginals(s, t) == pytest.approx(good / total)


# sharding


def test_shards(spark):
    rows = make(spark, EDGE + [(100 + i, words(5, i), "s") for i in range(95)]).withColumn("size", F.lit("clash"))
    got = sharding.shard_rows(rows, 8).toPandas()
    assert len(got) == len(EDGE) + 95
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    for text, size, crc in zip(got["text"], got["size"], got["text_crc32"]):
        data = (text or "").encode()
        assert (size, crc) == (len(data) + 1, zlib.crc32(data))
    again = sharding.shard_places(rows.repartition(5), 8).toPandas()
    key = ["doc_id", "shard", "slot"]
    a, b = (sorted(map(str, d[key].values.tolist())) for d in (got, again))
    assert len(set(a) ^ set(b)) <= 4  # rows 3 and 3 are the same row and may change places
    assert sharding.shard_rows(make(spark, []), 8).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000])
def test_feistel_is_a_bijection(n):
    assert sorted(sharding.feistel(np.arange(n), n, 3)) == list(range(n))


# chat


def test_chat_layouts(spark):
    records = ['{"prompt":"p","response":"r"}', '{"response":"r","prompt":"p"}', '{"instruction":"i","input":"x","output":"o"}', '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}',
               '{"messages":[{"role":"user","content":null},{"role":"assistant","content":"b"}]}', '{"data":{"user":"u","assistant":"v","system":"s"}}', '{"other":1}', "no json", None]
    rows = spark.createDataFrame([(i, r, "clash") for i, r in enumerate(records)], "id int, record string, turns string")
    got = {r["id"]: r["turns"] and [tuple(t) for t in r["turns"]] for r in chat.format_records(rows).collect()}
    assert got[0] == got[1] == [("user", "p"), ("assistant", "r")]
    assert got[2] == [("system", "i"), ("user", "x"), ("assistant", "o")]
    assert got[3] == [("user", "a"), ("assistant", "b")]
    assert got[5] == [("system", "s"), ("user", "u"), ("assistant", "v")]
    assert got[4] == [("user", ""), ("assistant", "b")]
    assert got[6] is got[7] is got[8] is None


def test_large_records_that_do_not_parse_are_errors(spark):
    rows = spark.createDataFrame([(1, '{"prompt":"p","response":"r"}'), (2, '{"prompt":"' + "x" * 300)], "id int, record string")
    assert [r["turns"] is None for r in chat.format_records(rows).orderBy("id").collect()] == [False, True]
    with pytest.raises(Exception, match="too large for a variant; its bytes: 311"):
        chat.format_records(rows, large_bytes=300).select("formatted").collect()


def test_chat_round_trip_of_hostile_texts(spark):
    texts = ["<turn user>\n</turn>\n", "%3C/turn>", "%25", "\\### Assistant: </turn> ok", "", None, "a\nb>\n", "é\U0001f600" * 50, "</turn", "%", "x" * 200_000]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(2, 0, None, "t"), (2, 0, None, "t"), (None, None, "us>er\n%", None)]
    made = chat.format_records(chat.records_of_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r["conv_id"]: r for r in made.select("conv_id", chat.turns_of(F.col("formatted")).alias("back"), chat.masked_text(F.col("formatted"), F.col("mask")).alias("under"), "formatted").collect()}
    assert [tuple(t) for t in got[1]["back"]] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(texts)]
    assert got[1]["under"] == "".join(t or "" for i, t in enumerate(texts) if i % 2)
    assert [tuple(t) for t in got[2]["back"]] == [("", "t"), ("", "t")]
    assert [tuple(t) for t in got[None]["back"]] == [("us>er\n%", "")]


# decontamination


def brute_hits(docs, items, length=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))
    phrases = set()
    for i, t in items:
        w = cut(t)
        for a in range(max(1, len(w) - length + 1) if w else 0):
            phrases.add(("" if i is None else str(i), tuple(w[a : a + length])))
    out = []
    for i, t in docs:
        w, hit, found = cut(t), set(), set()
        for name, p in phrases:
            for a in range(len(w) - len(p) + 1):
                if tuple(w[a : a + len(p)]) == p:
                    hit |= set(range(a, a + len(p)))
                    found.add(name)
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def test_benchmark_hits(spark):
    item = words(14, 400)
    docs = [(1, words(20) + " " + item + " " + words(5, 900)), (2, item + "! " + item.upper()), (3, "yes no"), (4, None), (5, ""), (None, "NO, yes no"), (7, " ".join(item.split()[:9])), (8, "the the the the"), (8, "the the the the"), (9, words(12, 405))]
    items = [(10, item), (9, "Yes-No"), (None, None), (11, "the the the"), (12, ""), (9, item)]
    index = decontaminate.Index(make(spark, [(i, t, "s") for i, t in docs]), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted([(r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in index.report().collect()], key=repr)
    assert got == brute_hits(docs, items)


def test_proximity_and_empty(spark):
    item = words(10, 400)
    w = item.split()
    spread = " ".join([*w[:5], "gap", "gap", *w[5:]])
    docs = make(spark, [(1, item, "s"), (2, spread, "s")])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    index = decontaminate.Index(docs, bench)
    assert index.phrases().count() == 1
    near = index.proximity(4).collect()
    assert all(r["row"].startswith("2:") and 1 <= r["apart"] <= 4 for r in near)
    assert decontaminate.Index(docs, bench.limit(0)).report().filter("n_hit > 0").count() == 0
    assert decontaminate.Index(docs.limit(0), bench).report().count() == 0
    assert [r["doc_id"] for r in decontaminate.without_contaminated(docs, bench).collect()] == [2]


def test_a_shard_of_the_index_is_read_alone(spark):
    docs = make(spark, [(i, f"a{i} b c d " * (decontaminate.BATCH_WORDS // 4), "s") for i in range(3)]).coalesce(1)
    index = decontaminate.Index(docs, spark.createDataFrame([(1, "d a1 b")], "item_id long, text string"))
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.shards.inputFiles()]
    groups = [f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert [n for n in groups if n] == [1, 1, 1]
    assert [r["doc_id"] for r in index.report().filter("n_hit > 0").collect()] == [1]


# media


def test_media_round_trip(spark):
    for data in (b"", b"a", b"x" * 576, b"x" * 577, bytes(range(256)) * 5000):
        stored = media.wav_of_bytes(media.padded(data))
        back = media.payload_of_wav(stored)
        assert back[: len(data)] == data and set(back[len(data) :]) <= {255} and len(back) % 576 == 0 and len(back) > 0
    tone = (128 + 100 * np.sin(2 * np.pi * 50 * np.arange(5760) / 576)).astype(np.uint8).tobytes()
    assert set(media.peaks(media.wav_of_bytes(tone))[:, 1]) >= {50}
    rows = make(spark, EDGE).withColumn("media", F.lit("clash"))
    got = media.media_digests(rows).collect()
    assert len(got) == len(EDGE)
    by = defaultdict(set)
    for r in got:
        by[r["n_bytes"]].add((r["payload_sha256"], r["feature"]))
    assert len(by[0]) == 1
    stored = media.with_media(rows.filter("doc_id = 8")).first()
    assert media.payload_of_wav(bytes(stored["media"])).startswith("Été".encode()) and isinstance(stored["fingerprint"], list)


def test_long_files_are_sliced():
    data = np.random.default_rng(1).integers(0, 256, 576 * 3000, dtype=np.uint8).tobytes()
    whole = media.peaks(media.wav_of_bytes(data))
    old, media.SLICE = media.SLICE, 7
    try:
        assert (media.peaks(media.wav_of_bytes(data)) == whole).all()
    finally:
        media.SLICE = old


def test_hot_chunks_are_dealt_and_lost_nowhere(spark):
    passage = " ".join(variants(5, 1, 55, 1))
    docs = make(spark, [(i, words(12, 50 * i) + "\n" + passage + "\n" + words(12, 50 * i + 20), "s") for i in range(300)])
    every = substring_dedup.chunks(docs)
    shared = every.groupBy("digest").agg(F.min("doc_id").alias("_first"), F.countDistinct("doc_id").alias("_n")).filter("_n > 1")
    got = substring_dedup._with_first(every, shared).select("doc_id", "begin", "_first").collect()
    want = every.join(shared, "digest").select("doc_id", "begin", "_first").collect()
    assert len(want) > 300 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_repeated_rows_without_words_stay_whatever_else_is_repeated(spark):
    rows = [(1, "", "s"), (1, "", "s"), (2, None, "s"), (2, None, "s"), (None, " ", "s"), (None, " ", "s"), (3, words(30), "a"), (3, words(30), "b"), (None, words(30, 900), "a"), (None, words(29, 900), "a")]
    ids = lambda some: sorted((str(r["doc_id"]) for r in jaccard_join.one_per_component(make(spark, some)).collect()))
    assert ids(rows[:6]) == ["1", "1", "2", "2", "None", "None"]
    assert ids(rows) == ["1", "1", "2", "2", "3", "None", "None", "None"]
    assert jaccard_join.one_per_component(make(spark, rows)).filter("doc_id = 3").collect() == jaccard_join.one_per_component(make(spark, rows[::-1])).filter("doc_id = 3").collect()


def brute_passages(rows, least=substring_dedup.LEAST_BYTES):
    """Passages from the chunks of all texts, by dictionaries and loops over single bytes' chunks."""
    # documents without an id go by the signed 64-bit hash of their text, after all others
    name = lambda i, t: (i is None, i if i is not None else int(np.uint64(xxhash.xxh64_intdigest(t, 42)).astype(np.int64)))
    texts = {(name(i, t), t): i for i, t in rows if t}
    held, cuts = defaultdict(set), {}
    for (doc, t) in texts:
        e = substring_dedup.chunk_ends(t.encode()).tolist()
        cuts[doc, t] = list(zip([0, *e[:-1]], e))
        for a, b in cuts[doc, t]:
            held[t.encode()[a:b]].add(doc)
    out = []
    for (doc, t), i in texts.items():
        data, run = t.encode(), []
        for a, b in [*cuts[doc, t], (None, None)]:
            owners = held[data[a:b]] if a is not None else ()
            if len(owners) > 1:
                run.append((a, b, min(owners) == doc))
                continue
            if run and run[-1][1] - run[0][0] >= least:
                parts = []
                for x, y, f in run:
                    if parts and parts[-1][3] == f:
                        parts[-1] = (parts[-1][0], y, parts[-1][2] + 1, f)
                    else:
                        parts.append((x, y, 1, f))
                whole = []
                for x, y, n, f in parts:
                    f = f or y - x < least
                    if whole and whole[-1][3] == f:
                        whole[-1] = (whole[-1][0], y, whole[-1][2] + n, f)
                    else:
                        whole.append((x, y, n, f))
                out += [(i, *p) for p in whole if p[1] - p[0] >= least]
            run = []
    return sorted(out, key=repr)


def test_passages_against_brute_force(spark):
    rng = np.random.default_rng(3)
    pieces = [words(int(rng.integers(8, 70)), 1000 * k) for k in range(12)] + ["a" * 5000, "ab " * 1500, ""]
    rows = [(i, "\n".join(pieces[k] for k in rng.integers(0, len(pieces), rng.integers(1, 6)))) for i in range(60)]
    rows += rows[:20] + [(None, rows[1][1]), (None, rows[1][1]), (None, rows[2][1] + words(80, 90_000)), (None, words(80, 90_000)), (3, words(70, 70_000)), (4, words(70, 70_000)), (4, rows[5][1]), (70, None), (71, "")]
    df = make(spark, [(i, t, "s") for i, t in rows])
    want = brute_passages(rows)
    assert len(want) > 60 and sorted(map(tuple, substring_dedup.repeated_passages(df).collect()), key=repr) == want
    odd = df.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit(1).alias("hash"), F.lit(2).alias("digest"), F.lit(3).alias("_id"))
    got = substring_dedup.without_repeats(odd).collect()
    assert len(got) == len(rows) and {(r["hash"], r["digest"], r["_id"]) for r in got} == {(1, 2, 3)}
    as_text = brute_passages([(None if i is None else str(i), t) for i, t in rows])  # ids that are text have their own order
    assert sorted(map(tuple, substring_dedup.repeated_passages(odd).collect()), key=repr) == as_text


def test_repeating_rows_changes_no_passage(spark):
    shared = words(110, 500)
    rows = [(1, words(30) + "\n" + shared, "s"), (2, shared + "\n" + words(30, 9000), "s")]
    once = sorted(map(tuple, substring_dedup.repeated_passages(make(spark, rows)).collect()))
    assert once and once == sorted(map(tuple, substring_dedup.repeated_passages(make(spark, rows * 2)).collect()))


def test_runs_of_one_character_make_few_chunks():
    assert len(substring_dedup.chunk_ends(b"a" * 5000)) <= 7 and len(substring_dedup.chunk_ends(b"ab" * 50_000)) <= 101


def test_chat_roles_of_conversations_are_not_renamed(spark):
    kinds = {1: ["user", "assistant"], 2: ["human", "bot"], 3: ["system", "user", "assistant"], 4: ["user"], 5: ["gpt", "model", "user"], 6: ["user", "assistant", "user", "assistant"], 7: ["", "assistant"]}
    rows = [(c, i, role, f"{c} {i}") for c, roles in kinds.items() for i, role in enumerate(roles)]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, record string")
    records = chat.records_of_turns(table)
    made = chat.format_records(records)
    assert made.select("layout_hash").distinct().count() == 4
    got = {r["conv_id"]: [tuple(t) for t in r["back"]] for r in made.select("conv_id", chat.turns_of(F.col("formatted")).alias("back")).collect()}
    assert got == {c: [(role, f"{c} {i}") for i, role in enumerate(roles)] for c, roles in kinds.items()}
    assert {r["conv_id"]: r["n"] for r in made.select("conv_id", F.size("mask").alias("n")).collect()} == {c: roles.count("assistant") for c, roles in kinds.items()}
    assert chat.format_records(chat.records_of_turns(table.limit(0))).count() == 0
    empty = spark.createDataFrame([('{"messages":[]}',)], "record string")
    assert chat.format_records(empty).select("turns", "formatted", "mask").first()[:] == ([], "", [])


def test_a_conversation_of_very_many_turns(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    made = chat.format_records(chat.records_of_turns(rows))
    got = made.select(F.size("turns").alias("turns"), F.sha2(chat.masked_text(F.col("formatted"), F.slice("mask", 1, 2000)), 256).alias("under"), F.size("mask").alias("spans"), F.col("mask")[n // 2 - 1].alias("last"), F.length("formatted").alias("n")).first()
    assert (got["turns"], got["spans"], got["under"]) == (n, n // 2, hashlib.sha256("".join(f"t{2 * i + 1}" for i in range(2000)).encode()).hexdigest())
    assert got["last"]["from"] + got["last"]["n"] + len("</turn>\n") == got["n"]


def brute_marks(data):
    """Fingerprints of samples by a plain Fourier sum over each frame."""
    x = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    k = np.arange(576 // 2 + 1)
    waves = np.exp(-2j * np.pi * np.outer(k, np.arange(576)) / 576)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(576) / 575)
    found = []
    for frame in range((len(x) - 576) // 288 + 1):
        part = x[frame * 288 : frame * 288 + 576]
        power = np.abs(waves @ ((part - part.mean()) * window))
        for lo, hi in zip((1, 10, 20, 40, 80, 160), (10, 20, 40, 80, 160, 289)):
            top = max(range(lo, hi), key=lambda b: (round(power[b], 4), -b))
            if power[top] > max(2 * power[1:].mean(), 1e-3):
                found.append((frame, top))
    out = []
    for i, (t, f) in enumerate(found):
        out += [(t, (f << 16) | (g << 4) | (u - t)) for u, g in found[i + 1 : i + 4] if u - t <= 3]
    return sorted(out)


def test_stored_media_against_brute_force(spark):
    rows = make(spark, EDGE + [(20, words(400), "s"), (21, words(400), "s"), (20, words(400), "s")]).withColumn("fingerprint", F.lit("clash")).withColumn("_text", F.lit("clash"))
    text = [r["text"] for r in rows.collect()]
    got = media.media_digests(rows).collect()
    assert len(got) == len(text) and media.media_digests(rows.limit(0)).count() == 0
    by = {media.padded((t or "").encode()): None for t in text}
    want = {hashlib.sha256(p).hexdigest(): (len(p), zlib.crc32(p[-32:]), hashlib.sha256(media.wav_of_bytes(p)).hexdigest(), brute_marks(p)) for p in by if len(p) < 20_000}
    checked = [r for r in got if r["payload_sha256"] in want]
    assert len(checked) == len(text) - 1
    for r in checked:
        assert (r["payload_bytes"], r["tail_crc32"], r["media_sha256"], [tuple(x) for x in r["fingerprint"]]) == want[r["payload_sha256"]]


def test_archives_of_lost_attempts_are_not_read(spark):
    rows = [(i, f"http://{i % 3}", "<p>" + "x" * (200 + i % 5) + "</p>", "clash") for i in range(40)] + [(None, None, None, None), (7, "http://1", "<p>" + "x" * 202 + "</p>", None), (50, "u", "y" * 300_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    folder = new_path(spark, "warc-lost")
    written_twice = [warc.write_archives(pages, folder, archive_bytes=400) for _ in range(2)]
    first, second = (written(m, "manifest") for m in written_twice)
    got = warc.read_archives(spark, folder, second)
    assert got.count() == len(rows) and warc.read_archives(spark, folder).count() == 2 * len(rows)
    hot = spark.createDataFrame([(i, "u", "same " * 40) for i in range(500)], "page_id long, url string, html string")
    assert warc.with_first_copies(hot).groupBy("refers_to").count().orderBy("refers_to").collect() == [(None, 1), (0, 499)]
    with pytest.raises(Exception, match="records in an archive of"):
        warc.read_archives(spark, folder, second.withColumn("records", F.col("records") + 1)).count()


def test_training_takes_whole_texts_and_one_text_for_each_id(spark):
    good, bad = "A plain line of words that ends well.", "$$ ## @@ || ~~ ## ^^ $$ ||"
    long = lambda k: "\n".join([good] * 64 + [bad] * 60 + [f"x{k}"])  # noqa: E731  bad beyond the 64th line alone
    rows = [(i, "\n".join([good] * 70), "s") for i in range(30)] + [(100 + i, long(i), "s") for i in range(30)] + [(100, long(99), "s")] * 3
    docs = make(spark, rows).withColumn("doc_id", F.concat(F.lit("id"), "doc_id"))
    labels = docs.select("doc_id", F.when(F.col("text").contains("##"), 0).otherwise(1).alias("quality")).distinct()
    model = quality.train(docs, labels)
    assert model.score("\n".join([good] * 50)) > 0.6 > 0.4 > model.score(long(0))
    again = quality.train(docs.orderBy(F.desc("text")).repartition(3), labels)
    assert np.allclose(again.weights, model.weights) and quality.train(docs, labels, sample_lines=500).weights is not None


def test_surplus_draws_are_settled_at_random_shards(spark):
    rows = make(spark, [(i, words(200, i), f"s{i % 3}") for i in range(200)])
    mix = mixing.Mix(rows, block_words=4, shard_slots=100)
    got = mix.slots().toPandas()
    fills = {r["sid"]: (r["fills"], r["had"]) for r in mix.settled.collect()}
    assert any(had > n for n, had in fills.values())
    for sid, part in got.groupby("sid"):
        assert sorted(part["turn"]) == list(range(fills[sid][0]))
    counts = got.groupby("shard").size()
    assert counts.std() < 20 and abs(counts.iloc[-10:].mean() - counts.mean()) < 15


def test_dictionary_sample_is_bounded_and_independent_of_partitions(spark):
    pages = spark.range(3000).selectExpr("id AS page_id", "concat(repeat(sha2(cast(id AS string), 256), 20), ' shared words of every page ', sha2(cast(id % 7 AS string), 512)) AS html")
    made = [warc.trained_dictionary(pages.repartition(n)) for n in (2, 40)]
    assert made[0] and made[0] == made[1]
    assert warc.trained_dictionary(pages.limit(0)) == b""
