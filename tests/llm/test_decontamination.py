import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyline.llm import decontamination as D


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(doc, items, window=10):
    w, hit, found = words(doc), set(), set()
    for name, text in items:
        v = words(text)
        for win in [v[i : i + window] for i in range(max(1, len(v) - window + 1))] if v else []:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add(name)
    return len(w), len(hit), sorted(x for x in found if x is not None)


def test_search_matches_brute_force_on_edges(spark, edge_docs):
    items = [("1", "alpha beta GAMMA"), ("2", "delta"), ("2", "x"), ("3", ""), ("4", None), (None, "with signs"), ("5", "lorem ipsum dolor sit amet " * 3), ("6", "text with")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = D.find_contamination(edge_docs, bench).collect()
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    want = sorted((str(d), *brute(t if t is None or len(t) < 1000 else t[:2000], items)) for d, t in rows if t is None or len(t) < 1000)
    short = sorted((str(r["doc_id"]), r["n_words"], sum(b - a for a, b in zip(r["starts"], r["ends"])), r["items"]) for r in got if r["n_words"] < 1000)
    assert short == want
    for r in got:
        if r["n_words"] > 1000:
            assert r["starts"] == [0] and r["ends"] == [r["n_words"]] and r["items"] == ["5"]


def test_blocks_of_the_benchmark_give_the_same(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    key = lambda rows: sorted(map(str, rows))
    want = key(D.find_contamination(docs, bench).collect())
    for size in (2000, 100):  # the smaller one also cuts items
        assert len(list(D._parts(bench, D.WINDOW, size))) > 3
        assert key(D.find_contamination(docs, bench, bytes_a_table=size).collect()) == want


def test_empty_tables(spark, no_docs, edge_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.find_contamination(no_docs, none).count() == 0
    assert all(r["items"] == [] and r["starts"] == [] for r in D.find_contamination(edge_docs, none).collect())
    assert D.drop_contaminated(edge_docs, none).count() == edge_docs.count()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=12), max_size=4))
def test_search_property(doc, items):
    tables = D.tables_of([(str(i), " ".join(x).encode()) for i, x in enumerate(items)], window=4)
    spans, names = set(), set()
    for t in tables:
        for start, found in D.search(t, [w.encode() for w in doc]):
            spans.update(range(start, start + t.m))
            names.update(found)
    assert (len(doc), len(spans), sorted(names)) == brute(" ".join(doc), [(str(i), " ".join(x)) for i, x in enumerate(items)], window=4)
