import hashlib
import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyline.llm import vector_codes, whitening
from tallyline.llm.vectors import finite

NAN, INF = float("nan"), float("inf")


def codes_brute(rows, parts=16, entries=64, rounds=2, factor=256):
    """rows: (vec_id, vector), all finite and of one length. Code and error of each, and the codebooks."""
    x = [[math.floor(factor * v) for v in vector] for _, vector in rows]
    w = len(x[0]) // parts
    part = lambda v, p: v[p * w : (p + 1) * w]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[part(x[i], p) for i in first] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(part(v, p), e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)] for v in x]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                if mine := [part(v, p) for v, f in zip(x, found, strict=True) if f[p][1] == k]:
                    books[p][k] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    out = [("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for f in assign()]
    flat = ",".join(str(v) for b in books for e in b for v in e)
    return out, hashlib.sha256(flat.encode()).hexdigest()


def vectors(n, dims, seed=1, scale=1.0):
    return [[float(v) for v in r] for r in np.random.default_rng(seed).normal(0, scale, (n, dims)).astype(np.float32)]


@pytest.fixture(scope="module")
def edge_vectors(spark):
    """Repeated ids and vectors, null and non-finite ones, null ids and labels, columns that clash with internal names."""
    v = vectors(150, 32)
    rows = [(i % 140, v[i], None if i % 7 == 0 else i % 3) for i in range(150)]
    rows += [(200, v[3], 1), (200, v[3], 1), (None, v[4], None), (None, v[5], 2), (201, [0.0] * 32, 0)]
    rows += [(-1, None, 1), (-2, [NAN] + v[0][1:], 1), (-3, [INF] + v[0][1:], 1), (-4, [None] + v[0][1:], 1)]
    clash = ("place", "n", "total", "code", "error", "_label", "x", "k", "deviation", "whitened", "component")
    schema = "vec_id long, embedding array<float>, label int, " + ", ".join(f"{c} int" for c in clash)
    return spark.createDataFrame([(*r, *([7] * len(clash))) for r in rows], schema)


def kept(df):
    return [(r["vec_id"], list(r["embedding"]), r["label"]) for r in df.collect() if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])]


def write(df, folder):
    df.write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_codes_equal_brute_force_on_edges(spark, edge_vectors, tmp_path):
    rows = kept(edge_vectors)
    want, sha = codes_brute([(i, v) for i, v, _ in rows])
    by_label = {}
    for (_, _, label), (_, error) in zip(rows, want, strict=True):
        by_label[label] = by_label.get(label, 0) + error
    got = vector_codes.op11_vector_codes(spark, write(edge_vectors, tmp_path)).collect()
    expected = [(str(i), code, error, by_label[label]) for (i, _, label), (code, error) in zip(rows, want, strict=True)]
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in got) == sorted(expected)
    assert {r["codebooks_sha256"] for r in got} == {sha}


def test_codes_equal_their_sql(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    cur = db.execute(vector_codes.ORACLE_SQL["op11_vector_codes"])
    df = vector_codes.op11_vector_codes(spark, sf)
    assert df.columns == [d[0] for d in cur.description]
    assert sorted(map(tuple, df.collect())) == sorted(cur.fetchall())


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 12), st.integers(0, 30), st.integers(0, 3), st.integers(0, 10**6))
def test_partial_distance_search_equals_full_search(width, entries, rows, spread, seed):
    random = np.random.default_rng(seed)
    x, book = random.integers(-spread, spread + 1, (rows, width)), random.integers(-spread, spread + 1, (entries, width))  # many ties
    full = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    index, distance = vector_codes.nearest(x, book)
    assert index.tolist() == full.argmin(axis=1).tolist() and distance.tolist() == full.min(axis=1).tolist()


def test_distances_of_the_largest_components_fit(spark):
    huge = [[3e38 * (-1) ** i] * 64 for i in range(4)]
    rows = spark.createDataFrame([(i, v, None) for i, v in enumerate(huge)], "vec_id long, embedding array<double>, label int")
    books = vector_codes.fitted(rows, entries=1)
    assert books.shape == (16, 1, 4)
    assert all(0 <= r["error"] <= 1 << 62 for r in vector_codes.with_label_error(vector_codes.encoded(rows, books)).collect())


def test_short_vectors_are_filled_up_and_nothing_stays_nothing(spark, edge_vectors, tmp_path):
    rows = spark.createDataFrame([(1, [0.5] * 20, 1), (2, [0.25], 1), (3, [], 2)], "vec_id long, embedding array<double>, label int")
    books = vector_codes.fitted(rows)
    assert books.shape == (16, 3, 2)
    codes = {r["vec_id"]: r for r in vector_codes.encoded(rows, books).collect()}
    assert codes[3]["error"] == 0 and vector_codes.decoded(codes[3]["code"], books) == [0] * 32
    assert vector_codes.decoded(codes[1]["code"], books)[:20] == [128] * 20
    for name, module in (("op11_vector_codes", vector_codes), ("op12_whitening", whitening)):
        empty = module.QUERIES[name](spark, write(edge_vectors.limit(0), tmp_path / name))
        assert empty.count() == 0 and "vec_id" in empty.columns


def whitening_brute(rows, factor=64):
    x = np.array([[math.floor(factor * c) + 1_000_000 for c in v] for _, v in rows])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s) / n
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    return n, ((n * x - s) ** 2).sum(axis=1), e[::-1], q[:, ::-1], ((n * x - s) / n), np.trace(v)


def close(got, rows, components=16):
    n, deviation, e, q, centred, trace = whitening_brute(rows)
    e, q = e[:components], q[:, :components]
    want = centred @ q / np.sqrt(e)
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
        assert r["n"] == n and abs(r["explained"] - e[r["component"] - 1] / trace) < 1e-12 and r["identity_error"] < 1e-9
    signs = None
    for k, (i, _) in enumerate(rows):
        y = np.array([by[(i, deviation[k])][c + 1][0] for c in range(components)])
        signs = np.sign(y * want[k]) if signs is None else signs
        assert np.abs(y * signs - want[k]).max() < 1e-7


def test_whitening_equals_full_decomposition_on_edges(spark, edge_vectors, tmp_path):
    rows = [(i, v) for i, v, _ in kept(edge_vectors)]
    got = whitening.op12_whitening(spark, write(edge_vectors, tmp_path)).collect()
    assert len(got) == 16 * len(rows)
    close(got, rows)


def test_whitening_of_the_table(spark, sf):
    rows = [(r["vec_id"], list(r["embedding"])) for r in finite(spark.read.parquet(f"{sf}/embeddings.parquet"), "embedding").collect()]
    close(whitening.op12_whitening(spark, sf).collect(), rows)


def test_a_spectrum_that_falls_needs_no_full_basis():
    values = np.r_[np.linspace(2, 1, 20), np.full(180, 1e-6)]
    q, _ = np.linalg.qr(np.random.default_rng(0).standard_normal((200, 200)))
    a = q * values @ q.T
    seen = []
    got, vectors_, passes = whitening.lanczos(lambda b: seen.append(b.shape[1]) or a @ b, 200, 16, block=8)
    assert np.abs(got - values[:16]).max() < 1e-12 and passes < 20 and sum(seen) < 200
    assert np.abs(np.abs(np.diag(q[:, :16].T @ vectors_)) - 1).max() < 1e-10


@pytest.mark.parametrize("values", [[3, 3, 3, 1, 0, 0, 0, 0], [5] * 8, [0] * 8, [1] + [0] * 7])
def test_breakdown_goes_on_elsewhere(values):
    q, _ = np.linalg.qr(np.random.default_rng(0).standard_normal((8, 8)))
    a = q * np.array(values, dtype=float) @ q.T
    for block in (1, 6, 8):
        got, vectors_, _ = whitening.lanczos(lambda b: a @ b, 8, 5, block=block)
        assert np.abs(got - sorted(values, reverse=True)[:5]).max() < 1e-12
        assert np.abs(vectors_.T @ vectors_ - np.eye(5)).max() < 1e-10


def test_components_without_variance_have_no_rows(spark, tmp_path):
    v = vectors(4, 32)
    rows = spark.createDataFrame([(i, v[i % 4]) for i in range(9)], "vec_id long, embedding array<float>")
    got = whitening.op12_whitening(spark, write(rows, tmp_path / "a")).collect()
    assert sorted({r["component"] for r in got}) == [1, 2, 3] and len(got) == 27  # four points span three directions
    assert {r["n"] for r in got} == {4} and abs(sum({r["component"]: r["explained"] for r in got}.values()) - 1) < 1e-12
    same = spark.createDataFrame([(i, [0.5] * 20) for i in range(3)], "vec_id long, embedding array<float>")
    assert whitening.op12_whitening(spark, write(same, tmp_path / "b")).count() == 0


def test_deviations_are_exact_beyond_64_bits():
    x, sums = np.array([[2**31 - 1, -(2**31)], [0, 1]]), np.array([2**31 - 1, -(2**31) + 1])
    want = [sum((7 * int(v) - int(s)) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]
    assert whitening.deviations(x, 7, sums) == want and want[0] > 1 << 63


def test_equal_vectors_count_once_and_keys_are_exact(spark):
    v = vectors(3, 16)
    rows = spark.createDataFrame([(i, v[0] if i else v[1]) for i in range(50)], "vec_id long, embedding array<float>")
    fit, w = whitening.fitted(rows)
    assert fit.count() == w.n == 2 and fit.select(F.length("x")).distinct().first()[0] == 64
