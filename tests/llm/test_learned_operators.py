"""Line field, whitening and hard negatives against brute force, gradients, and their defined results for odd input."""

import itertools
import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import linefield, negatives, queries, whitening

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


# line field -----------------------------------------------------------------------------

def small_field(rng, width=3):
    field = linefield.Field(width)
    field.weights, field.steps = rng.normal(size=width), rng.normal(size=(2, 2))
    return field


def enumerated(field, features):
    """Marginals, normaliser and expected steps of one chain over all labellings."""
    score = (features - field.mean) / field.spread @ field.weights
    weight, good, steps, total = 0.0, np.zeros(len(score)), np.zeros((2, 2)), 0.0
    for labels in itertools.product((0, 1), repeat=len(score)):
        weight = math.exp(sum(s for s, y in zip(score, labels) if y) + sum(field.steps[a, b] for a, b in zip(labels, labels[1:])))
        total += weight
        good += weight * np.array(labels)
        for a, b in zip(labels, labels[1:]):
            steps[a, b] += weight
    return good / total, math.log(total), steps / total


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    field, sizes = small_field(rng), np.array([4, 1, 7, 2])
    features = rng.normal(size=(sizes.sum(), 3))
    found = field.marginals(features, sizes)
    for at, size in zip(np.cumsum(sizes) - sizes, sizes):
        assert np.allclose(found[at:at + size], enumerated(field, features[at:at + size])[0], atol=1e-12)


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    field, sizes = small_field(rng), np.array([3, 5, 1])
    features, good = rng.normal(size=(9, 3)), np.array([0, 1, 1, 0, 0, 1, 0, 1, 1])
    loss, by_weight, by_step = field.likelihood(features, sizes, good, 0.01)
    exact = 0.0
    for at, size in zip(np.cumsum(sizes) - sizes, sizes):
        own, y = features[at:at + size], good[at:at + size]
        exact += enumerated(field, own)[1] - (own @ field.weights * y).sum() - sum(field.steps[a, b] for a, b in zip(y, y[1:]))
    assert loss == pytest.approx(exact / 3 + 0.005 * ((field.weights ** 2).sum() + (field.steps ** 2).sum()))
    for held_, made in ((field.weights, by_weight), (field.steps, by_step)):
        for place in np.ndindex(held_.shape):
            kept = held_[place]
            sides = []
            for step in (1e-6, -1e-6):
                held_[place] = kept + step
                sides.append(field.likelihood(features, sizes, good, 0.01)[0])
            held_[place] = kept
            assert made[place] == pytest.approx((sides[0] - sides[1]) / 2e-6, abs=1e-6)


def test_long_chains_keep_their_numbers():
    field = linefield.Field(1)
    field.weights, field.steps = np.array([40.0]), np.array([[9.0, -9.0], [-9.0, 9.0]])
    found = field.marginals(np.tile([[1.0], [-1.0]], (20_000, 1)), np.array([39_999, 1]))
    assert np.isfinite(found).all() and (found >= 0).all() and (found <= 1).all()


def test_class_counts_over_pieces(monkeypatch):
    texts = ["Ab#\n\n1 é", "", "x" * 50 + "\n" + "!" * 9, "\n"]
    whole = linefield.line_features(texts)
    monkeypatch.setattr(linefield, "PIECE", 3)
    cut = linefield.line_features(texts)
    assert all((a == b).all() for a, b in zip(whole, cut))
    assert whole[1].tolist() == [3, 1, 2, 2] and whole[2].tolist() == [3, 1, 4, 1, 50, 9, 1, 1]
    by_name = dict(zip(linefield.NAMES, whole[0].T))
    assert by_name["capitals"][0] == 0.5 and by_name["symbols"][0] == pytest.approx(1 / 3)
    assert by_name["symbols before"][1] == pytest.approx(1 / 3) and by_name["symbols after"][2] == 0
    assert by_name["first"].tolist() == [1, 0, 0, 1, 1, 0, 1, 0] and by_name["last"].tolist() == [0, 0, 1, 1, 0, 1, 0, 1]


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = queries.op11_quality_classifier(spark, sf)
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = {r["doc_id"]: r for r in found.collect()}
    assert len(rows) == docs.count()
    assert all(r["held_out"] == held(k) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for k, r in rows.items())
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if held(r["doc_id"])}
    assert np.mean([rows[k]["predicted"] == v for k, v in truth.items()]) >= 0.97
    # Labels of documents that are held out change nothing.
    turned = labels.withColumn("quality", F.when(linefield.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = linefield.train(docs.repartition(5), turned)
    other = linefield.train(docs, labels)
    assert (again.weights == other.weights).all() and (again.steps == other.steps).all()


def test_a_bad_passage_marks_its_lines(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    field = linefield.train(docs, labels)
    clean = docs.join(labels.filter("quality = 1"), "doc_id").filter("n_chars BETWEEN 800 AND 1200").orderBy("doc_id").first()["text"]
    lines = clean.replace(". ", ".\n").split("\n")
    mixed = lines[:8] + ["wh### on&&& the%%% ti$$$ ha*** " * 3] * 8
    good = field.marginals(*linefield.line_features(["\n".join(mixed)])[:2])
    assert good[:6].mean() > 0.5 > good[-6:].mean()


def test_line_field_on_odd_input(spark):
    words = "a few words in a line. " * 4
    docs = [(k, t) for k, t in enumerate([words, "## && ## && %%", words * 3, "$$$ ### !!!"] * 6)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (None, words), (0, words), (0, words), (103, "x" * 100_000), (104, "\n".join(["## &&"] * 9000))]
    rows = spark.createDataFrame(docs, "doc_id BIGINT, text STRING").select(
        "*", F.lit(0).alias("label"), F.lit(0).alias("draw"), F.lit("s").alias("score"), F.lit(1).alias("held"), F.lit(2).alias("quality"))
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(24)] + [(100, 0, 0), (101, None, 0), (None, 1, 1), (0, 1, 1), (2, 0, 0), (999, 1, 0)],
                                   "doc_id BIGINT, quality INT, toxic INT")
    field = linefield.train(rows, labels, linefield.Training(lines=8))
    found = linefield.score_quality(rows, field).collect()
    assert len(found) == len(docs)
    by = {r["doc_id"]: r for r in found}
    assert by[100]["score"] == by[101]["score"] and by[100]["n_lines"] == 1 and by[102]["n_lines"] == 3
    assert by[104]["predicted"] == 0 and by[104]["n_lines"] == 9000 and by[None]["predicted"] == 1 and by[None]["held_out"] is False
    assert len({r["score"] for r in found if r["doc_id"] in (0, None) }) == 1
    # Without a label, or without a document of one, there is no field.
    assert linefield.train(rows, labels.limit(0)) is None and linefield.train(rows.limit(0), labels) is None
    assert {r["score"] for r in linefield.score_quality(rows, None).collect()} == {0.5}
    assert linefield.score_quality(rows.limit(0), field).collect() == []


# whitening ------------------------------------------------------------------------------

def brute_whitening(rows):
    kept = [(k, [math.floor(64 * c) + 1_000_000 for c in v]) for k, v, *_ in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=np.float64)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = fit - fit.mean(axis=0)
    cov = centred.T @ centred / n
    return kept, n, sums, fit.mean(axis=0), cov


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_whitening_equals_eigh(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()
    kept, n, sums, mean, cov = brute_whitening([tuple(r) for r in rows])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    found = queries.op12_whitening(spark, path).toPandas()
    assert list(found.columns[:7]) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(found) == 16 * len(kept) and set(found.n) == {n}
    assert found.identity_error.nunique() == 1 and found.identity_error.iloc[0] < 1e-9
    table = found.pivot(index="vec_id", columns="component", values="whitened").sort_index()
    x = np.array([v for _, v in sorted(kept)], np.float64)
    exact = (x - mean) @ vectors / np.sqrt(values)
    signs = np.sign((table.to_numpy() * exact).sum(axis=0))
    assert np.abs(table.to_numpy() - exact * signs).max() < 1e-6
    first = found[found.component == 1].set_index("vec_id")
    assert all(int(first.deviation[k]) == sum((n * c - s) ** 2 for c, s in zip(v, sums)) for k, v in kept[:200])
    assert np.allclose(found.groupby("component").explained.first(), values / np.trace(cov), rtol=1e-9)


@pytest.mark.parametrize("kind", ["random", "equal", "split", "diagonal", "low rank", "graded", "one"])
def test_components_of_hard_matrices(kind):
    rng = np.random.default_rng(3)
    d = 40
    turn = np.ones((1, 1)) if kind == "one" else np.linalg.qr(rng.normal(size=(d, d)))[0]
    values = {"random": rng.random(d), "equal": np.r_[np.full(20, 2.0), rng.random(20)], "split": np.r_[np.full(10, 5.0), np.full(30, 1.0)],
              "diagonal": np.arange(d), "low rank": np.r_[np.zeros(d - 3), 3, 2, 1], "graded": 10.0 ** -np.arange(d), "one": np.full(1, 4.0)}[kind]
    a = np.diag(values.astype(float)) if kind == "diagonal" else (turn * values) @ turn.T
    a = (a + a.T) / 2
    found, vectors = whitening.components(a, 16)
    exact = np.sort(np.linalg.eigvalsh(a))[::-1][:16]
    size = np.abs(a).max() * d
    assert np.abs(found - exact).max() < 1e-13 * size
    assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-10
    assert np.abs(a @ vectors - vectors * found).max() < 1e-11 * size


def test_sturm_counts():
    rng = np.random.default_rng(4)
    diagonal, off = rng.normal(size=30), rng.normal(size=29)
    off[7] = 0
    exact = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    at = rng.normal(size=50) * 2
    assert (whitening.below(diagonal, off, at) == (exact[:, None] < at).sum(axis=0)).all()


def test_whitening_on_odd_input(spark):
    rng = np.random.default_rng(5)
    good = [(k, [float(c) for c in np.float32(rng.normal(size=6))], k % 3) for k in range(40)]
    bad = [(50, None, 1), (51, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (52, [NAN] + [0.0] * 5, 1), (53, [-INF] + [0.0] * 5, None), (54, [], 1),
           (55, [1.0, 2.0], 1), (56, [3e38] + [0.0] * 5, 1)]
    copies = [(None, good[0][1], None), (3, good[3][1], 7), (3, good[4][1], 7)] + [(60, good[1][1], 0)] * 300
    rows = good + bad + copies
    table = spark.createDataFrame(rows, VECTORS).select("*", F.lit(1).alias("x"), F.lit(2).alias("_body"), F.lit(3).alias("n"), F.lit(4).alias("length"))
    found = whitening.whitened(table.repartition(4)).collect()
    kept, n, sums, mean, cov = brute_whitening([r for r in rows if r[0] is None or not 50 <= r[0] <= 56])
    assert n == 40 and len(found) == 6 * len(kept) and {r["n"] for r in found} == {40}
    assert sorted(r["deviation"] for r in found if r["component"] == 2) == sorted(sum((n * c - s) ** 2 for c, s in zip(v, sums)) for _, v in kept)
    assert found[0]["identity_error"] < 1e-9
    # Three different vectors span two components; one, or none, spans nothing.
    few = whitening.whitened(spark.createDataFrame(good[:3] * 5, VECTORS)).collect()
    assert {r["component"] for r in few} == {1, 2} and few[0]["identity_error"] < 1e-6 and {r["n"] for r in few} == {3}
    assert whitening.whitened(spark.createDataFrame(good[:1] * 5, VECTORS)).collect() == []
    assert whitening.whitened(spark.createDataFrame(bad[:5], VECTORS)).collect() == []
    assert whitening.whitened(spark.createDataFrame([], VECTORS)).collect() == []


def test_deviations_beyond_a_long():
    x = np.array([[1 << 20, 0], [0, 3]])
    assert whitening._deviations(x, 1 << 40, [5, 7]) == [None, (5 ** 2) + (3 * (1 << 40) - 7) ** 2 if (3 * (1 << 40)) ** 2 < 1 << 63 else None]
    assert whitening._deviations(x, 2, [1, 1]) == [(2 ** 21 - 1) ** 2 + 1, 1 + 25]


# hard negatives -------------------------------------------------------------------------

def brute_negatives(rows):
    whole = [(k, (label + 1) % 10 if k is not None and k % 7 == 0 else label, [math.floor(256 * c) for c in v]) for k, v, label in rows
             if label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for at, (anchor, label, x) in enumerate(whole):
        if anchor is None or anchor % 100:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(x, y)), k is None, k or 0, k, own) for i, (k, own, y) in enumerate(whole) if i != at), key=lambda s: s[:3])
        for ps, _, _, p, _ in [s for s in scored if s[4] == label][:5]:
            fit = [s for s in scored if s[4] != label and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:5]
            out += [(anchor, p, r, s[3], -ps, -s[0]) for r, s in enumerate(fit, 1)]
    return out


def sortable(rows):
    return sorted(tuple((v is None, v or 0) for v in r) for r in rows)


def test_hard_negatives_equal_brute_force_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    found = queries.op13_hard_negatives(spark, SF)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = [tuple(r) for r in found.collect()]
    assert got and sortable(got) == sortable(brute_negatives(rows))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{SF}/embeddings.parquet'")
    assert sortable(got) == sortable(con.sql(queries.ORACLES["op13_hard_negatives"]).fetchall())


def tied_vectors(rng, n=700):
    """Few different vectors, so that most scores are tied; one vector holds a third of the rows."""
    kinds = [[float(c) / 16 for c in rng.integers(-6, 20, 5)] for _ in range(12)]
    ids = rng.permutation(n)
    return [(int(i), kinds[0] if k % 3 == 0 else kinds[int(rng.integers(12))], int(rng.integers(3))) for k, i in enumerate(ids)]


@pytest.mark.parametrize("cells", [(1024, 16_384, 1024), (2, 60, 20)])
def test_hard_negatives_of_ties_in_any_cells(spark, monkeypatch, cells):
    for name, value in zip(("BLOCK", "CHUNK", "_LEAST_CHUNK"), cells):
        monkeypatch.setattr(negatives, name, value)
    rows = tied_vectors(np.random.default_rng(6))
    table = spark.createDataFrame(rows, VECTORS).repartition(5)
    assert sortable(tuple(r) for r in negatives.hard_negatives(table).collect()) == sortable(brute_negatives(rows))


def test_hard_negatives_on_odd_input(spark):
    rows = tied_vectors(np.random.default_rng(7), 220)
    rows += [(1000, None, 1), (1001, [NAN] * 5, 1), (1100, [INF] * 5, 1), (1002, [0.5, None, 0.5, 0.5, 0.5], 1), (1003, [0.5] * 5, None),
             (None, [0.9] * 5, 0), (None, [0.9] * 5, 1), (1200, [0.0] * 5, 2), (1004, [-0.4] * 5, 1), (1300, [0.7] * 5, 1)]
    table = spark.createDataFrame(rows, VECTORS).select("*", F.lit(1).alias("row"), F.lit(2).alias("x"), F.lit(3).alias("block"), F.lit(4).alias("key"))
    assert sortable(tuple(r) for r in negatives.hard_negatives(table).collect()) == sortable(brute_negatives(rows))
    # Rows of an odd length, or with components too large for the products, take no part.
    more = table.unionByName(spark.createDataFrame([(2000, [1.0], 1), (2100, [1e30] * 5, 2)], VECTORS), allowMissingColumns=True)
    assert negatives.hard_negatives(more).count() == len(brute_negatives(rows))
    # Rows of one id are rows of their own.
    twice = [(100, [1.0, 0.5], 1), (100, [0.5, 1.0], 1), (5, [0.9, 0.6], 2), (6, [0.8, 0.8], 3)]
    assert sortable(tuple(r) for r in negatives.hard_negatives(spark.createDataFrame(twice, VECTORS)).collect()) == sortable(brute_negatives(twice))
    assert negatives.hard_negatives(table.filter("vec_id = 1")).collect() == []
    assert negatives.hard_negatives(table.limit(0)).collect() == []


def test_first_columns_of_scores_that_fill_a_long():
    rng = np.random.default_rng(8)
    for wide in (3, 1 << 61):
        score = rng.integers(-wide, wide, (7, 30))
        score[:, 10:20] = score[:, :10]
        allowed = rng.random(score.shape) < 0.5
        allowed[0] = False
        rows, columns = negatives.first_columns(score, allowed, 4)
        for r in range(7):
            exact = sorted((c for c in range(30) if allowed[r, c]), key=lambda c: (-score[r, c], c))[:4]
            assert sorted(columns[rows == r].tolist()) == sorted(exact)
