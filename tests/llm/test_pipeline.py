"""The pipeline's stages on the smallest tables, each held against brute force on what the stage before kept."""

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from flowloom.llm import quality
from flowloom.plans.scratch import written


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    w = [re.sub("[A-Z]+", lambda m: m[0].lower(), x) for x in w]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def first_of_each_component(texts):
    """The ids that stay: the smallest of each group linked by a similarity of 0.8 or more, and all without words."""
    sets, top = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return {i for i in texts if root(i) == i}


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    functions = dict(pipeline.STAGES)
    step = lambda name, df: written(functions[name](spark, df, sf_dir), "test")

    good = step("quality classifier", docs)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert good.columns == docs.columns
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in docs.collect() if model.score(r["text"]) >= quality.ACCEPT}

    single = step("n-gram jaccard join", good)
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    assert single.columns == docs.columns
    assert {r["doc_id"] for r in single.collect()} == first_of_each_component(texts)

    clean = step("benchmark decontamination", single)
    phrases = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = words(r["text"])
        phrases |= {" ".join(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    hit = lambda t: any(f" {p} " in f" {' '.join(words(t))} " for p in phrases)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in single.collect() if not hit(r["text"])}

    mixed = step("mixing sources", clean)
    assert mixed.columns == docs.columns
    own = {r["doc_id"]: words(r["text"]) for r in clean.collect()}
    for r in mixed.collect():
        assert r["doc_id"] in own and not Counter(words(r["text"])) - Counter(own[r["doc_id"]])

    out = functions["sharding"](spark, mixed, sf_dir).collect()
    assert len(out) == mixed.count() and set(docs.columns) <= set(out[0].asDict())
    shards = Counter(r["shard"] for r in out)
    assert max(shards.values()) - min(shards.values()) <= 1
    assert all(sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n)) for s, n in shards.items())


def test_held_out_accuracy(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels)
    rows = docs.join(labels, "doc_id").filter(quality.held_out(docs["doc_id"]) & labels["quality"].isNotNull()).collect()
    assert rows and sum((model.score(r["text"]) >= quality.ACCEPT) == bool(r["quality"]) for r in rows) >= 0.9 * len(rows)


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = ["_id", "_h", "_row", "_key", "_doc", "_copy", "_size", "_spans", "_words", "_score", "_hash", "_text", "_bucket", "row", "hash", "epoch", "sid", "start", "row_no", "component_id", "n_shingles"]
    odd = docs.select("*", *[F.concat(F.lit(f"{name}-"), "doc_id").alias(name) for name in extra])
    for number, (name, stage) in enumerate(pipeline.STAGES):
        got = stage(spark, odd, sf_dir)
        assert set(odd.columns) <= set(got.columns) and len(set(got.columns)) == len(got.columns)
        rows = got.select("doc_id", *extra).collect()
        assert rows and all(r[name] == f"{name}-{r['doc_id']}" for r in rows for name in extra)


def test_stages_on_empty_tables_nulls_and_repeats(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    line = "This is a plain sentence of a normal document, and it goes on for a while until it ends."
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, line, "en", "b", len(line)), (3, line + " More.", "en", None, 10), (3, line + " More.", "en", None, 10), (4, "b " * 20_000, "en", "a", 40_000)]
    docs = spark.createDataFrame(rows, schema)
    for number, (name, stage) in enumerate(pipeline.STAGES):
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
        got = stage(spark, docs, sf_dir)
        kept = [r["doc_id"] for r in got.collect()]
        assert set(kept) <= {1, 2, 3, 4, None} and set(docs.columns) <= set(got.columns), name
        if name == "n-gram jaccard join":
            assert sorted(map(str, kept)) == ["1", "2", "3", "4"]
        if name == "benchmark decontamination":
            assert len(kept) == len(rows)
        if name == "mixing sources":
            assert not set(kept) & {1, 2}
        if name == "sharding":
            assert len(kept) == len(rows)
