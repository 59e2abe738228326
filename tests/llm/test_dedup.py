import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyline.llm import exact_dedup, simhash


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def exact_brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), d is None, d or 0, d))
    return {k: (min(v)[3], len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("digest", [True, False])
def test_exact_groups_match_brute_force_on_edges(edge_docs, digest):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    want = exact_brute(rows)
    got = exact_dedup.exact_groups(edge_docs, with_digest=digest).collect()
    expected = sorted((str(d), str(want[norm(t)][0]), want[norm(t)][1]) for d, t in rows)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in got) == expected
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    if digest:
        assert {bytes(r["digest"]).hex() for r in got} == {hashlib.sha256(norm(t).encode()).hexdigest() for _, t in rows}


def test_exact_groups_of_nothing(no_docs):
    assert exact_dedup.exact_groups(no_docs).count() == 0
    assert exact_dedup.drop_exact_duplicates(no_docs).columns == no_docs.columns


def test_drop_keeps_one_of_each_text_and_all_columns(edge_docs):
    out = exact_dedup.drop_exact_duplicates(edge_docs.where("doc_id IS NOT NULL"))
    assert out.columns == edge_docs.columns
    assert sorted({r["doc_id"] for r in out.collect()}) == [1, 2, 5, 6, 8, 9]


def fp_brute(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_brute(fps, radius=3):
    """fingerprint -> fingerprints reachable."""
    fps, left, out = list(fps), set(fps), {}
    while left:
        group, todo = set(), [next(iter(left))]
        while todo:
            x = todo.pop()
            if x in group:
                continue
            group.add(x)
            todo += [y for y in fps if (x ^ y).bit_count() <= radius and y not in group]
        left -= group
        out |= {x: group for x in group}
    return out


def check_groups(rows, got):
    fps = [(d, fp_brute(t)) for d, t in rows]
    reach = components_brute({f for _, f in fps})
    smallest = {f: min((d for d, g in fps if g in reach[f] and d is not None), default=None) for _, f in fps}
    want = sorted((str(d), f, str(smallest[f])) for d, f in fps)
    assert sorted((str(r["doc_id"]), r["fp"] % 2**64, str(r["component_id"])) for r in got) == want


def test_simhash_matches_brute_force(spark, sf, plain):
    check_groups(plain, simhash.near_duplicate_groups(spark.read.parquet(f"{sf}/documents.parquet")).collect())


def test_simhash_edges(edge_docs):
    check_groups([(r["doc_id"], r["text"]) for r in edge_docs.collect()], simhash.near_duplicate_groups(edge_docs).collect())


def test_simhash_of_nothing(no_docs):
    assert simhash.near_duplicate_groups(no_docs).count() == 0


def test_links_find_every_pair_in_a_dense_cluster(spark):
    """Fingerprints around two centres, with many pairs in reach."""
    draw = np.random.default_rng(3)
    fps = set()
    for centre in (*draw.integers(0, 2**63, 2).tolist(), 2**64 - 1, 3 << 62):
        for _ in range(100):
            x = centre
            for b in draw.integers(0, 64, draw.integers(0, 4)).tolist():
                x ^= 1 << b
            fps.add(x - (x >> 63 << 64))
    found = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a in fps for b in fps if a < b and ((a ^ b) % 2**64).bit_count() <= 3}


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = simhash.components(edges).collect()
    assert {r["node"] for r in found} == set(range(201)) and {r["root"] for r in found} == {0}


def test_cells_agree_for_all_pairs_in_reach():
    draw = np.random.default_rng(5)
    x = draw.integers(0, 2**63, 500).astype(np.uint64)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << draw.integers(0, 64, 500).astype(np.uint64)
    assert (simhash.cells(x) == simhash.cells(y)).any(axis=1).all()


def test_drop_decides_by_row(spark):
    docs = [(1, "same text here now"), (1, "same text here now"), (None, "no id at all"), (None, "no id at all"), (3, "same text here now"), (3, "quite another unique story told"), (None, "lone words of nobody")]
    want = sorted({(None if d is None else d, t) for d, t in docs if (d, t) != (3, docs[0][1])}, key=str)
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    for drop in (exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates):
        assert sorted((tuple(r) for r in drop(rows).collect()), key=str) == want
