import corpus_pipeline
from pyspark.sql import functions as F

from tallyline.llm import quality, sentencepieces
from tests.llm.test_decontamination import brute as hits
from tests.llm.test_dedup import components_brute, exact_brute, fp_brute, norm


def test_pipeline_matches_a_plain_version(spark, sf, plain):
    docs, labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    model = quality.fit(docs, labels, F.lit(True))
    pair = quality.compressors(model["dictionaries"])
    score = lambda t: float(quality.sigmoid(model["a"] * quality.difference((t or "").encode(), pair, model["usual"]) + model["b"]))
    rows = [(d, t) for d, t in plain if score(t) >= corpus_pipeline.LEAST_QUALITY]
    keep = exact_brute(rows)
    rows = [(d, t) for d, t in rows if keep[norm(t)][0] == d]
    fps = {d: fp_brute(t) for d, t in rows}
    reach = components_brute(set(fps.values()))
    rows = [(d, t) for d, t in rows if d == min(e for e, g in fps.items() if g in reach[fps[d]])]
    items = [(str(r["item_id"]), r["text"]) for r in bench.collect()]
    rows = [(d, t) for d, t in rows if hits(t, items)[1] == 0]
    encoder = sentencepieces.Encoder(sentencepieces.load())
    want = {d: encoder.encode(t).tolist() for d, t in rows}
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and 0 < len(got) < len(plain)


def test_stages_handle_edges(spark, sf, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf)
            assert out.count() <= docs.count()
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
