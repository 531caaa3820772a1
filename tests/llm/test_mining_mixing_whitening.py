"""Hard negatives, source mixing and whitening on small tables: SQL, brute force and edge rows."""

import math
import re
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def query(spark, name):
    from concord.llm.queries import QUERIES

    return [r.asDict() for r in QUERIES[name](spark, SF).collect()]


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_source_mixing"])
def test_query_equals_its_sql(spark, name):
    from concord.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    want = sorted(repr(sorted(zip(names, r))) for r in want.fetchall())
    assert sorted(repr(sorted(r.items())) for r in query(spark, name)) == want


# --- op11 -----------------------------------------------------------------------------

@pytest.mark.parametrize("top", [1, 100, 30_000, 1 << 22, 1 << 27])
def test_packed_products_are_exact(top):
    from concord.llm.hard_negatives import kronecker_scores

    rng = np.random.default_rng(top)
    for m, n, d in ((1, 1, 1), (3, 7, 5), (4, 50, 64), (2, 3, 0)):
        a, r = rng.integers(-top, top + 1, (m, d)), rng.integers(-top // 3, 2 * top, (n, d))
        assert (kronecker_scores(a, r) == a @ r.T).all()


def test_packed_products_beyond_64_bits_stay_at_the_ends():
    from concord.llm.hard_negatives import LONG, kronecker_scores

    a = np.array([[1 << 40, 5], [LONG.min, 0]])
    r = np.array([[1 << 40, 1], [-(1 << 40), 1], [3, 4]])
    want = [[min(max(sum(int(x) * int(y) for x, y in zip(p, q)), LONG.min), LONG.max) for q in r] for p in a]
    assert kronecker_scores(a, r).tolist() == want


def brute_negatives(rows, is_anchor, positives=5, negatives=10, least=Fraction(3, 10), most=Fraction(9, 10)):
    """rows: distinct usable (id, label, integer vector)."""
    out = []
    for a, (i, la, x) in enumerate(rows):
        if not is_anchor(i):
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), j, lb) for b, (j, lb, y) in enumerate(rows) if b != a and len(y) == len(x)]
        same = sorted((s, j) for s, j, lb in scored if lb == la)[:positives]
        for s, j in same:
            fit = sorted((t, k) for t, k, lb in scored if lb != la and least * -s <= -t <= most * -s)[:negatives]
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(fit, 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, `row` string, q int")


EDGE = [(0, [0.5, 0.25], 1), (0, [0.5, 0.25], 1), (1, [0.5, 0.3], 1), (2, [0.5, 0.3], 1), (3, None, 1), (4, [0.5, None], 1), (5, [NAN, 0.1], 2),
        (6, [INF, 0.1], 2), (7, [0.25, 0.1], 2), (8, [0.25, 0.1], 3), (None, [0.2, 0.1], 2), (9, [0.2, 0.1], None), (10, [], 2), (11, [0.3], 2),
        (12, [0.3, 0.02], 2), (13, [-0.4, 0.1], 2), (14, [0.0, 0.0], 2), (15, [0.3], 1), (16, [0.4], 1), (0, [0.4, 0.25], 2), (17, [0.35], 4), (20, [], 2), (100, [], 3)]


def whole(rows, scale=256):
    kept = {(i, lab, tuple(math.floor(scale * c) for c in v)) for i, v, lab in rows
            if i is not None and lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    return sorted(kept)


def mined(df, *args, **kw):
    from concord.llm.hard_negatives import mine_hard_negatives

    return sorted(tuple(r) for r in mine_hard_negatives(df, *args, **kw).collect())


def test_hard_negative_edges(spark):
    df = vectors(spark, EDGE)
    got = mined(df, "vec_id % 4 = 0")
    assert got == brute_negatives(whole(EDGE), lambda i: i % 4 == 0) and len(got) > 4
    assert mined(df.where("1 = 0"), "vec_id % 4 = 0") == []
    assert mined(df.where("vec_id = 3"), "true") == []


def test_hard_negatives_over_a_grid_of_small_groups(spark, monkeypatch):
    from concord.llm import hard_negatives

    monkeypatch.setattr(hard_negatives, "ROW_BYTES", 2000)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", 1000)
    monkeypatch.setattr(hard_negatives, "STRIP", 3)
    rng = np.random.default_rng(5)  # few values, so scores tie
    rows = [(i, [float(c) for c in rng.integers(-1, 3, 4) / 4], int(rng.integers(0, 3))) for i in range(150)]
    got = mined(vectors(spark, rows), "vec_id % 3 = 0")
    assert got == brute_negatives(whole(rows), lambda i: i % 3 == 0) and len(got) > 500
    text = vectors(spark, rows).withColumn("label", F.concat(F.lit("l"), "label"))  # labels of any type
    assert mined(text, "vec_id % 3 = 0") == got


# --- op12 -----------------------------------------------------------------------------

DOCS = [(1, "a b c", "s"), (2, None, "s"), (3, "", "t"), (4, "w " * 5000, "t"), (5, "x", None), (None, "y z", None), (None, "y z", None),
        (6, "one\x0btwo\x0cthree\r\nfour  five", "u"), (7, "é 日本 😀", "Z"), (7, "é 日本 😀", "Z"), (8, "alone", "é"), (9, " \t\n", "v"), (10, "p q", "s")]


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, `key` string")


def brute_targets(sizes, weights, times=3):
    """Shares by weight, cut off and reshared until none is above (fractions)."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, total, free = {}, Fraction(sum(sizes.values())), set(names)
    while free:
        level = (total - sum(target.values())) / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] >= times * sizes[s]}
        if not over:
            target.update({s: level * w[s] for s in free})
            break
        target.update({s: Fraction(times * sizes[s]) for s in over})
        free -= over
    return target


def check_mix(rows, got, weights):
    assert len(got) == len(rows)
    sizes, taken, want_target = defaultdict(int), defaultdict(int), defaultdict(set)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
        want_target[r.source].add(r.target)
        assert r.epochs * r.size <= r.taken <= (r.epochs + 1) * r.size
    for s, want in brute_targets(sizes, weights).items():
        assert len(want_target[s]) == 1 and abs(min(want_target[s]) - want) <= 1e-9 * (1 + want)
        assert abs(taken[s] - want) <= 0.5 + 1e-6
    partial = defaultdict(int)
    for r in got:
        partial[r.source] += r.taken % max(r.size, 1) != 0
    assert max(partial.values(), default=0) <= 1  # only the document in which the budget ends


def test_mixing_edges(spark):
    from concord.llm.mixing import mix

    df = documents(spark, DOCS)
    got = mix(df, [1, 2, 3]).collect()
    check_mix(DOCS, got, [1, 2, 3])
    assert mix(df.where("1 = 0"), [1, 2, 3]).count() == 0
    empty = [(1, None, "s"), (2, "", None)]
    assert {r.taken for r in mix(documents(spark, empty), [1, 2]).collect()} == {0}


def test_mixing_agrees_over_layouts_and_levels(spark, monkeypatch):
    from concord.llm import mixing

    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 300)), "w " * int(rng.integers(0, 40)), ["a", "b", None, "c"][min(3, int(rng.integers(0, 9)))]) for _ in range(600)]
    rows += [(1000, "copy of a row", "c")] * 400  # one repeated row with two fifths of all rows
    df = documents(spark, rows)
    quality = spark.createDataFrame([(i, 1.0 + i % 4) for i in range(0, 300, 2)], "doc_id long, quality double")
    one = mixing.mix(df, [3, 1, 2], quality=quality).collect()
    check_mix(rows, one, [3, 1, 2])
    monkeypatch.setattr(mixing, "RANGE_ROWS", 40)
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 7)
    two = mixing.mix(df.repartition(5, "text"), [3, 1, 2], quality=quality).collect()
    check_mix(rows, two, [3, 1, 2])
    assert sorted(map(repr, one)) == sorted(map(repr, two))


@pytest.mark.parametrize("unit", [1, 10 ** 6, 5 * 10 ** 7, 10 ** 9, 10 ** 15, 10 ** 17])
def test_mixing_targets_of_any_size(spark, unit):
    """Products of sizes and weights leave ints at a few GB of documents, and longs later."""
    from concord.llm.mixing import targets

    sizes = {"a": 9 * unit, "b": unit // 3, "c": 7 * unit, "d": unit, "e": 0}
    weights = [1, 2, 3]
    rows = [(s, n, weights[i % 3]) for i, (s, n) in enumerate(sizes.items())]
    got = {r.source: r.target for r in targets(spark.createDataFrame(rows, "source string, source_size long, weight int"), 3).collect()}
    for s, want in brute_targets(sizes, weights).items():
        assert abs(got[s] - want) <= 1e-12 * want


def test_better_documents_come_earlier(spark):
    from concord.llm.mixing import mix

    rows = [(i, f"text {i}", "big") for i in range(4000)] + [(10_000 + i, f"text {i}", "cut") for i in range(1000)]
    quality = documents(spark, rows).select("doc_id", F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0).alias("quality"))
    got = [r for r in mix(documents(spark, rows), [1, 1], quality=quality).collect() if r.source == "big"]
    good, bad = (sum(r.taken for r in got if r.doc_id % 2 == k) for k in (0, 1))
    assert sum(r.taken for r in got) == 5000 and got[0].target == 5000  # half of all 10,000 words: 5/8 of the source
    # inclusion without replacement at weights 4 and 1: shares 1 - x**4 and 1 - x with mean 5/8
    x = np.roots([1, 0, 0, 1, 2 * 0.625 - 2])
    x = float(next(r.real for r in x if abs(r.imag) < 1e-9 and 0 < r.real < 1))
    assert abs(good / 4000 - (1 - x ** 4)) < 0.03 and abs(bad / 4000 - (1 - x)) < 0.03


# --- op13 -----------------------------------------------------------------------------

def symmetric(rng, values):
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64, 150])
def test_divide_and_conquer_equals_eigh(d):
    from concord.llm.whitening import leading_components

    rng = np.random.default_rng(d)
    x = rng.standard_normal((3 * d + 2, d))
    v = x.T @ x
    values, vectors = leading_components(v, 8)
    want, basis = np.linalg.eigh(v)
    assert np.allclose(values, want[::-1][:8], rtol=1e-12)
    assert np.allclose(np.abs((vectors * basis[:, ::-1][:, :8]).sum(axis=0)), 1, atol=1e-10)
    assert np.abs(v @ vectors - vectors * values).max() < 1e-13 * want[-1] * d


def test_divide_and_conquer_of_repeated_and_zero_eigenvalues():
    from concord.llm.whitening import leading_components

    rng = np.random.default_rng(1)
    for spectrum in ([7.0] * 5 + [2.0] * 9, [1.0] * 6, [0.0] * 4, [3, 3, 1, 0, 0, 0, 0, 0, 0], list(10.0 ** -np.arange(14)), [5, 4, -1, -3]):
        v = symmetric(rng, spectrum)
        values, vectors = leading_components(v, 8)
        assert np.allclose(values, sorted(spectrum, reverse=True)[:8], atol=1e-13)
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-13)
        assert np.abs(v @ vectors - vectors * values).max() < 1e-13


def brute_whitening(rows, components=8):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    off = x * n - s
    deviation = [int((line * line).sum()) for line in off]
    centred = (off / n).astype(float)
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return n, deviation, centred @ vectors / np.sqrt(values), values / np.trace(v)


def check_whitening(rows, got, components=8):
    n, deviation, white, explained = brute_whitening(rows, components)
    by = defaultdict(dict)
    for r in got:
        by[r["vec_id"]][r["component"]] = r
    assert len(by) == len(rows) and len(got) == len(rows) * len(explained)
    for at, (i, _) in enumerate(rows):
        assert {(r["n"], r["deviation"]) for r in by[i].values()} == {(n, deviation[at])}
    for k in range(len(explained)):
        mine = np.array([by[i][k + 1]["whitened"] for i, _ in rows])
        sign = np.sign(mine @ white[:, k])
        assert np.allclose(mine * sign, white[:, k], atol=1e-8)
        assert np.allclose([by[i][k + 1]["explained"] for i, _ in rows], explained[k], rtol=1e-10)
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and 0 <= errors.pop() < 1e-9


def test_whitening_query_equals_eigh(spark):
    rows = [(i, [float(c) for c in v]) for i, v in duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' WHERE embedding IS NOT NULL").fetchall()]
    check_whitening(rows, query(spark, "op13_embedding_whitening"))


def test_whitening_edges(spark):
    from concord.llm.whitening import whitened_components

    rng = np.random.default_rng(2)
    fine = [(i, [float(c) for c in rng.standard_normal(3)]) for i in range(12)]
    fine += [(50 + i, [float(1e7 * c) for c in rng.standard_normal(3)]) for i in range(5)]  # squares beyond 64 bits
    odd = [(100, None), (101, [0.1, None, 0.2]), (102, [NAN, 0.1, 0.1]), (103, [INF, 0.0, 0.0]), (104, []), (105, [0.5, 0.5])]
    df = spark.createDataFrame([(*r, 1, "x") for r in fine + odd], "vec_id long, embedding array<double>, component int, whitened string")
    got = [r.asDict() for r in whitened_components(df).collect()]
    assert all(r["deviation"] is not None for r in got)
    check_whitening(fine, [r | {"deviation": int(r["deviation"])} for r in got], components=3)
    named = df.where("vec_id < 12").withColumn("vec_id", F.when(F.col("vec_id") > 0, F.col("vec_id")))  # a null id stays
    assert whitened_components(named).where("vec_id is null").count() == 3
    twice = whitened_components(df.where("vec_id < 12").union(df.where("vec_id = 3")))
    assert twice.where("vec_id = 3").count() == 6 and twice.first()["n"] == 13
    flat = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.75])], "vec_id long, embedding array<double>")
    assert [r.component for r in whitened_components(flat).collect()] == [1, 1]  # one dimension without variance
    for none in (df.where("1 = 0"), flat.where("vec_id = 1"), df.where("vec_id = 104")):
        assert whitened_components(none).collect() == []
