"""Whitening, prefix trie and collision search: edge cases and brute force."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import collision_search, prefix_trie, queries, whitening

VECTORS = "vec_id long, embedding array<float>, label int"
TURNS = "conv_id long, turn long, role string, text string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [None if c is None else float(c) for c in v], 0) for i, v in rows], VECTORS)


def gaussian(n, d, seed=0, scale=None):
    x = np.random.default_rng(seed).standard_normal((n, d)) * (1.0 if scale is None else scale)
    return [(i, row) for i, row in enumerate(x.astype(np.float32).astype(float))]


# whitening


def on_grid(rows):
    return np.array([[math.floor(64 * c) + 1_000_000 for c in row] for row in rows], dtype=object)


def test_jacobi_against_lapack():
    for shape, seed in (((7, 7), 1), ((12, 5), 2), ((3, 6), 3), ((1, 1), 4)):
        r = np.random.default_rng(seed).standard_normal(shape) * 10.0 ** np.arange(shape[1])
        norms, v = whitening.one_sided_jacobi(r)
        want = np.zeros(shape[1])
        want[: min(shape)] = np.linalg.svd(r, compute_uv=False)
        assert np.allclose(norms, want, rtol=1e-10, atol=1e-10 * want[0])
        assert np.allclose(v.T @ v, np.eye(shape[1]), atol=1e-13)
    tiny, _ = whitening.one_sided_jacobi(np.diag([1.0, 1e-12]) @ np.array([[1.0, 1e-3], [0.0, 1.0]]))
    assert tiny[1] == pytest.approx(1e-12 / math.hypot(1, 1e-3), rel=1e-6)  # small deviations keep their accuracy


def test_whitening_against_brute_force(spark):
    scale = np.array([3.0, 0.5, 8.0, 1.0, 2.0])
    rows = gaussian(700, 5, 3, scale) + [(900, None), (901, [1.0, None, 0, 0, 0]), (902, [1.0, math.nan, 0, 0, 0]), (903, [math.inf, 0, 0, 0, 0]), (904, []), (905, [1.0, 2.0])]
    rows += [(None, rows[5][1]), (7, rows[7][1])]
    df = vectors(spark, rows).repartition(7).withColumns({"whitened": F.lit("x"), "_row": F.lit(1), "a.b": F.lit(2)})
    model = whitening.fit(df, "embedding", components=3)
    got = whitening.long_form(model, df).toPandas()
    kept = [(i, r) for i, r in rows if r is not None and len(r) == 5 and all(c is not None and math.isfinite(c) for c in r)]
    x = on_grid([r for _, r in kept])
    n = len(x)
    assert len(got) == 3 * n and set(got["n"]) == {n} and set(got["component"]) == {1, 2, 3}
    deviation = sorted(int(((n * row - x.sum(0)) ** 2).sum()) for row in x)
    assert sorted(got[got["component"] == 1]["deviation"].tolist()) == deviation
    centred = (n * x - x.sum(0)).astype(float) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    for c in range(3):
        mine = got[got["component"] == c + 1].dropna(subset=["vec_id"]).sort_values(["vec_id", "whitened"])
        want = {i: w for (i, _), w in zip(kept, centred @ v[:, c] / math.sqrt(e[c]))}
        theirs = np.array([want[i] for i in mine["vec_id"]])
        sign = np.sign(theirs[0] * mine["whitened"].iloc[0])
        assert np.allclose(mine["whitened"], sign * theirs, atol=1e-9)
        assert mine["explained"].iloc[0] == pytest.approx(e[c] / e.sum(), rel=1e-9)
    assert got["identity_error"].max() < 1e-9
    assert model.transformed(df).columns == ["vec_id", "embedding", "label", "_row", "a.b", "deviation", "whitened"]


def test_whitening_without_variance_and_empty(spark):
    flat = vectors(spark, [(i, [1.0, i % 5, 2.0]) for i in range(40)])
    got = whitening.long_form(whitening.fit(flat), flat).toPandas()
    assert len(got) == 120 and got[got["component"] == 1]["whitened"].notna().all() and got[got["component"] > 1]["whitened"].isna().all()
    assert set(got[got["component"] > 1]["explained"]) == {0.0} and got["identity_error"].max() < 1e-9
    one = vectors(spark, [(1, [1.0, 2.0])])
    assert whitening.long_form(whitening.fit(one), one).toPandas()["whitened"].isna().all()
    none = vectors(spark, [(1, None)])
    assert whitening.long_form(whitening.fit(none), none).count() == 0


def test_deviation_beyond_a_long_is_null():
    assert whitening.squares(np.array([[3, 4]])) == [25]
    assert whitening.squares(np.array([[2**32, 0], [2**30, 1]])) == [None, 2**60 + 1]


# prefix trie


def brute_trie(convs):
    """convs: id -> list of (role, text)."""
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    out = []
    count = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text))
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        children = [k for k in below if len(k) == len(key) + 1]
        leaves = sum(not any(len(o) == len(k) + 1 and o[: len(k)] == k for o in below) for k in below)
        saved = sum((len(nodes[k]) - 1) * count(k[-1][1]) for k in below if k)
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(key))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def rows_of(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=lambda r: (r[1], r[0]))


def spread(convs):
    return [(c, d * 3, role, text) for c, turns in convs.items() for d, (role, text) in enumerate(turns)]


def trie_of(spark, rows):
    turns = prefix_trie.numbered_turns(spark.createDataFrame(rows, TURNS).withColumns({"pos": F.lit("x"), "words": F.lit(0)}))
    return rows_of(prefix_trie.prefix_trie(turns, spark.createDataFrame(rows, TURNS).select("conv_id").distinct()))


def test_trie_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 8)  # groups of copies take the streamed way too
    a, b, c, empty = ("user", "one two"), ("assistant", "three"), ("user", " four\tfive\nsix "), ("", "")
    convs = {-3: [a], 1: [a, b], 2: [a, b], 3: [a, b, c], 4: [a, b, c, c, c], 5: [b], 6: [empty, a], 9: [empty], 12: [("user", "onetwo")], 13: [("usero", "ne two")], 2**40: [a, b, c, a]}
    convs |= {100 + i: [a, c, b] for i in range(50)} | {200 + i: [a, c, (b[0], str(i))] for i in range(20)}
    convs |= {300 + i: [("user", f"long {j}") for j in range(30)] for i in range(9)}
    assert trie_of(spark, spread(convs)) == brute_trie(convs)


def test_trie_of_one_conversation_copies_and_nothing(spark):
    a, b = ("user", "x y"), ("assistant", "z")
    for convs in ({4: [a, b]}, {4: [a, b], 5: [a, b]}, {4: [a], 5: [a, b]}):
        assert trie_of(spark, spread(convs)) == brute_trie(convs)
    assert trie_of(spark, [(None, 0, "user", "x")]) == []


def test_turns_without_number_role_or_text_and_ties(spark):
    rows = [(1, 2, "user", "later"), (1, None, None, "first"), (1, 0, "b", None), (1, 0, "a", "tie"), (1, 0, "a", "tie"), (2, None, "", "first")]
    said = [("", "first"), ("a", "tie"), ("a", "tie"), ("b", ""), ("user", "later")]
    assert trie_of(spark, rows) == brute_trie({1: said, 2: said[:1]})


def rebuilt(convs):
    out = {}
    for c in convs:
        h, donor = zlib.crc32(str(c).encode()) % 4, c - int(math.fmod(c, 20))
        out[c] = convs.get(donor, [])[:h] + convs[c][h:]
    return out


def test_prefix_trie_query(spark, tmp_path):
    rng = np.random.default_rng(5)
    convs = {int(c): [("user", f"w {rng.integers(2)}") for _ in range(rng.integers(1, 6))] for c in [*range(-25, 45), 60, 61, 75, 99, 119]}
    for c in (0, 40):
        convs.pop(c)  # absent donors
    spark.createDataFrame(spread(convs), TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    made = rebuilt(convs)
    assert any(not turns for turns in made.values())
    assert rows_of(queries.op12_prefix_trie(spark, str(tmp_path))) == brute_trie(made)


# collision search


def brute_nearest(rows, query, k):
    own, q = query
    far = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, q))), math.inf if i is None else i) for i, v in rows if i != own)
    return far[:k]


def answers(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["score"], math.inf if r["vec_id"] is None else r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("kind", ["noise", "clusters"])
def test_search_recall(spark, monkeypatch, kind):
    monkeypatch.setattr(collision_search, "SAMPLE_ROWS", 300)
    monkeypatch.setattr(collision_search, "CHUNK_ROWS", 700)
    monkeypatch.setattr(collision_search, "BLOCK_BYTES", 4000)
    rows = gaussian(4000, 32, 8)
    if kind == "clusters":
        centres = np.random.default_rng(1).standard_normal((20, 32)) * 4
        rows = [(i, (v * 0.3 + centres[i % 20]).astype(np.float32).astype(float)) for i, v in rows]
    df = vectors(spark, rows).repartition(5)
    got = answers(collision_search.nearest(df, df.filter("vec_id % 100 = 0")))
    assert len(got) == 40 and all(len(v) == 10 for v in got.values())
    hit = 0
    for q, found in got.items():
        want = brute_nearest(rows, rows[q], 10)
        hit += len({i for _, i in found} & {i for _, i in want})
        exact = {i: s for s, i in brute_nearest(rows, rows[q], len(rows))}
        assert all(s == pytest.approx(exact[i], rel=1e-12) for s, i in found) and found == sorted(found)
    assert hit / 400 >= 0.95


def test_search_edges(spark):
    rows = [(0, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0]), (5, [0.0, 0.0]), (6, None), (7, [math.nan, 1.0]), (8, [1.0, None]), (9, [1.0]), (10, []), (100, [2.0, 2.0]), (11, [-math.inf, 0.0])]
    df = vectors(spark, rows).withColumns({"id": F.lit("x"), "v": F.lit(1), "score": F.lit(2)})
    got = answers(collision_search.nearest(df, df.filter("vec_id % 100 = 0")))
    kept = [(0, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0]), (100, [2.0, 2.0])]
    assert got == {q: brute_nearest(kept, (q, v), 10) for q, v in ((0, [1.0, 0.0]), (100, [2.0, 2.0]))}
    nothing = vectors(spark, [(100, None)])
    assert collision_search.nearest(nothing, nothing).count() == 0


def test_search_among_many_copies(spark, monkeypatch):
    monkeypatch.setattr(collision_search, "CHUNK_ROWS", 256)
    rows = [(i, [0.5, 0.5, 0.5, 0.1]) for i in range(1, 2000)] + [(5000 + i, v) for i, v in gaussian(500, 4, 2)]
    df = vectors(spark, rows).repartition(6)
    queries_ = [(100, [0.5, 0.5, 0.5, 0.1]), (5000, rows[1999][1])]
    got = answers(collision_search.nearest(df, vectors(spark, queries_)))
    assert [i for _, i in got[100]] == [i for i in range(1, 11)]
    assert len(got[5000]) == 10
