import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyline.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets_brute(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """sizes: source -> words. Caps are applied one round after the other."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped, left = {}, share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        total = sum(weight[s] for s in free)
        now = {s: left * weight[s] / total for s in free}
        over = [s for s in free if now[s] > cap * sizes[s]]
        if not over:
            return {s: float(v) for s, v in (capped | now).items()}
        for s in over:
            capped[s] = cap * sizes[s]
            left -= capped[s]


def docs_of(spark, rows):
    clash = ("size", "rows", "copies", "number", "block", "part", "draw", "target", "_source")
    return spark.createDataFrame([(*r, *([7] * len(clash))) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in clash))


def mix_holds(rows, got):
    """rows: (doc_id, text, source). All that can be said of a random mix."""
    sizes, largest, taken = {}, {}, {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
        largest[source] = max(largest.get(source, 0), size(text))
    want = targets_brute(sizes)
    assert sorted((str(d), s or "~", size(t)) for d, t, s in rows) == sorted((str(r["doc_id"]), r["source"] or "~", r["size"]) for r in got)
    for r in got:
        s = r["source"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6
        assert 0 <= r["copies"] <= 2 and (r["size"] or not r["copies"])
        if sizes[s]:  # copies are the whole numbers around the wanted one
            assert r["size"] == 0 or np.floor(want[s] / sizes[s] - 1e-9) <= r["copies"] <= np.ceil(want[s] / sizes[s] + 1e-9)
        taken[s] = taken.get(s, 0) + r["copies"] * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-3, s


def test_edges(spark, edge_docs):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in edge_docs.collect()]
    mix_holds(rows, mixing.mixed(edge_docs).collect())


def test_the_table_and_reruns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    got = mixing.mixed(docs).collect()
    mix_holds(rows, got)
    again = mixing.mixed(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sorted(map(str, got)) != sorted(map(str, mixing.mixed(docs, seed=43).collect()))
    q = mixing.op13_mixing(spark, sf)
    assert q.columns == ["doc_id", "size", "source_size", "target", "taken"] and q.count() == len(rows)


def test_empty_and_wordless_tables(spark, edge_docs):
    assert mixing.mixed(edge_docs.limit(0)).count() == 0
    rows = [(1, None, "a"), (2, " \n", "a"), (3, "", None)]
    got = mixing.mixed(docs_of(spark, rows)).collect()
    assert {(r["doc_id"], r["copies"], r["target"]) for r in got} == {(1, 0, 0.0), (2, 0, 0.0), (3, 0, 0.0)}


@pytest.mark.parametrize("block, fan_in, unfold", [(8, 2, 3), (64, 4, 4096)])
def test_many_blocks_hot_sources_and_repeated_rows(spark, monkeypatch, block, fan_in, unfold):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", block)
    monkeypatch.setattr(mixing, "FAN_IN", fan_in)
    monkeypatch.setattr(mixing, "UNFOLD", unfold)
    random = np.random.default_rng(3)
    rows = [(i, "w " * int(random.integers(1, 40)), "hot" if i % 3 else f"s{i % 11}") for i in range(900)]
    rows += [(5000, "same words here", "hot")] * 101 + [(5001, "x", None)] * 7 + [(5002, "w " * 900, "hot")]
    mix_holds(rows, mixing.mixed(docs_of(spark, rows)).collect())


def test_batches_may_cut_blocks(spark, monkeypatch):
    rows = [(i, "w " * (i % 17 + 1), f"s{i % 2}") for i in range(400)]
    want = sorted(map(str, mixing.mixed(docs_of(spark, rows)).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(map(str, mixing.mixed(docs_of(spark, rows)).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(1, 50), st.floats(0.01, 0.99)), max_size=40), st.integers(0, 10**6))
def test_pairing_keeps_words_and_leaves_one(found, seed):
    found.sort(key=lambda x: x[0])
    group, sizes, part = (np.array([f[k] for f in found], dtype=t) for k, t in ((0, np.int64), (1, float), (2, float)))
    out = mixing.paired(group, sizes, part, np.arange(len(found)) * 7919, seed)
    assert ((out >= 0) & (out <= 1)).all()
    for g in set(group.tolist()):
        own = group == g
        assert abs((sizes * out)[own].sum() - (sizes * part)[own].sum()) < 1e-5
        assert ((out > 0) & (out < 1))[own].sum() <= 1


def test_expectations_stay():
    part = np.array([0.2, 0.7, 0.5, 0.9])
    sizes = np.array([1.0, 9.0, 4.0, 2.0])
    runs = [mixing.paired(np.zeros(4, dtype=np.int64), sizes, part, np.arange(4) + 4 * k, 1) for k in range(4000)]
    assert np.abs(np.mean(runs, axis=0) - part).max() < 0.03


def test_targets_with_caps_in_several_rounds(spark):
    sizes = {f"s{k:02}": int(10 * 1.7**k) for k in range(12)} | {None: 0}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.with_targets(rows).collect()}
    want = targets_brute(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)
    assert abs(sum(got.values()) - 1.5 * sum(sizes.values())) < 1e-3
