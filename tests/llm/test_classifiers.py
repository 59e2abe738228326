import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import language_id, licenses, quality, toxicity
from tallyline.llm.catalog import QUERIES

SF = "/root/testdata/sf0.1"  # smaller folders have a handful of held-out positives


def auc(scores, y):
    rank = np.argsort(np.argsort(scores, kind="stable")) + 1
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize("name, label, least", [("op6_toxicity", "toxic", 0.95), ("op10_quality", "quality", 0.93)])
def test_held_out_labels(spark, name, label, least):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    rows = QUERIES[name](spark, SF).join(labels, "doc_id").where("held_out").collect()
    scores, y = np.array([r["score"] for r in rows]), np.array([r["y"] for r in rows])
    assert auc(scores, y) >= least
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op8_language_id"](spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) >= 0.95


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_scores_of_edges_and_without_labels(spark, edge_docs, no_docs, module, label):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (8, 0), (9, 1), (4, None), (None, 1), (5, 1)], f"doc_id long, {label} int")
    for known in (labels, labels.limit(0)):
        model = module.fit(edge_docs, known, F.lit(True))
        scores = [r[0] for r in edge_docs.select(module.score(model, F.col("text"), spark)).collect()]
        assert len(scores) == edge_docs.count() and all(0 <= s <= 1 for s in scores)
        assert no_docs.select(module.score(model, F.col("text"), spark)).count() == 0
    assert set(scores) == {0.5}


def test_quality_difference_reads_the_whole_text():
    good, bad = [f"calm words number {i} in a row" .encode() for i in range(400)], [f"BUY!!! NOW {i}$$$".encode() for i in range(400)]
    pair = quality.compressors((quality.train(bad), quality.train(good)))
    head = b"calm words in a row " * 200
    assert quality.difference(head, pair) > quality.difference(head + b"".join(bad), pair)


def test_counterfactual_penalty_shrinks_the_effect_of_group_names(spark):
    """Toxic sentences name one group and neutral ones rarely do: the plain fit blames the name."""
    rows, labels = [], []
    for i in range(120):
        toxic = i % 2
        group = "women" if (toxic and i % 6) or (not toxic and i % 10 == 0) else "people"
        rows.append((i, f"the {group} over there are {'awful idiots' if toxic else 'reading books'} today"))
        labels.append((i, toxic))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    gap = {}
    for penalty in (0.0, 40.0):
        m = toxicity.fit(docs, known, F.lit(True), penalty=penalty)
        w = lambda word: m["weights"][m["vocabulary"][word]]
        gap[penalty] = abs(w("women") - w("men"))
        probe = spark.createDataFrame([("those women are reading",), ("those men are reading",)], "text string")
        scores = [r[0] for r in probe.select(toxicity.score(m, F.col("text"), spark)).collect()]
        assert max(scores) < 0.5
    assert gap[40.0] < 0.5 * gap[0.0]


def test_swaps_stay_within_a_kind():
    out = toxicity.counterfactuals("Women read. The gay man sings.")
    assert len(out) == 2 and all("Women" not in t for t in out) and toxicity.counterfactuals("Nothing here.") == []


def test_language_edges(spark, edge_docs, no_docs):
    model = language_id.fit(edge_docs, F.lit(True))
    got = {r["text"]: r["p"] for r in edge_docs.select("text", language_id.predictions(model, F.col("text"), spark).alias("p")).collect()}
    assert got[None]["lang_pred"] == got[""]["lang_pred"] == got[" \n\t "]["lang_pred"] == "und"
    assert got["Alpha beta gamma delta."]["lang_pred"] == "en"
    assert language_id.fit(no_docs, F.lit(True)) is None
    assert {r[0]["lang_pred"] for r in edge_docs.select(language_id.predictions(None, F.col("text"), spark)).collect()} == {"und"}
    digits = spark.createDataFrame([("123 ²³ !!",)], "text string")
    assert digits.select(language_id.predictions(model, F.col("text"), spark)).first()[0]["lang_pred"] == "und"


def test_unseen_words_back_off_to_shorter_grams(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("der schnelle fuchs schlich", "de"), ("the quick fox crept thing", "en")] * 20)], "doc_id long, text string, lang string")
    s = language_id.Scorer(language_id.fit(docs, F.lit(True)))
    assert s.predict("schlichen schnell")[0] == "de" and s.predict("things quickly")[0] == "en"


def test_license_lines_and_edges(spark, edge_docs, no_docs):
    lines = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 2.", "I have a driving license and a copyright question about the software.", "the cat sat on the mat"]
    background = [(i, "\n".join(["the cat sat on the mat today", "somebody writes about weather", "numbers like 12 and 13 occur"])) for i in range(30)]
    docs = spark.createDataFrame([*background, (99, "\n".join(lines)), (100, None)], "doc_id long, text string")
    model = licenses.fit(docs)
    got = docs.where("doc_id = 99").select(licenses.find_licenses(model, F.col("text"), spark)).first()[0]
    text = "\n".join(lines)
    assert [(s["family"], text[s["start"] : s["stop"]]) for s in got] == list(zip(["apache", "mit", "cc-by-nc", "gpl"], lines))
    assert edge_docs.select(F.explode(licenses.find_licenses(model, F.col("text"), spark))).count() == 0
    assert no_docs.select(licenses.find_licenses(licenses.fit(no_docs), F.col("text"), spark)).count() == 0


def test_every_language_is_learned(spark):
    draw = np.random.default_rng(1)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    vocabulary = {f"l{k:03}": ["".join(draw.choice(letters, 6)) for _ in range(12)] for k in range(230)}
    rows = [(i * 1000 + k, " ".join(draw.choice(words, 10)), lang) for i, (lang, words) in enumerate(vocabulary.items()) for k in range(3 if i else 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, F.lit(True), 400)
    assert model["langs"] == sorted(vocabulary)
    scorer = language_id.Scorer(model)
    assert all(scorer.predict(text)[0] == lang for _, text, lang in rows)
    assert max(np.bincount(language_id.fit(docs, F.lit(True), model_entries=460)["words"].lang)) <= 2


def language_brute(rows, text, langs):
    """(language, score) by summing the log frequencies of words, or of their n-grams, one by one."""
    words, grams = {k: Counter() for k in langs}, {k: Counter() for k in langs}
    for t, lang in rows:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            words[lang][w] += 1
            for size in range(1, 5):
                p = f"^{w}$"
                grams[lang].update(p[i : i + size] for i in range(max(1, len(p) - size + 1)))

    def logs(counts, key):
        largest = max(sum(c.values()) for c in counts.values())
        return np.array([math.log(counts[k][key] / sum(counts[k].values())) if counts[k][key] else math.log(0.5 / largest) for k in langs])

    def of(word):
        if any(words[k][word] for k in langs):
            return logs(words, word)
        p = f"^{word}$"
        ends = [next((p[a:b] for a in range(max(0, b - 4), b) if any(grams[k][p[a:b]] for k in langs)), "") for b in range(1, len(p) + 1)]
        return sum(logs(grams, g) for g in ends) / len(p)

    found = re.findall(r"[^\W\d_]+", text.lower())
    total = sum(of(w) for w in found)
    p = np.exp((total - total.max()) / math.sqrt(len(found)))
    return langs[int(np.argmax(total))], p.max() / p.sum()


def test_language_scores_match_brute_force(spark):
    rows = [("der schnelle fuchs und der hund", "de"), ("the quick fox and the dog", "en"), ("le renard et le chien", "fr"), ("der fox the hund", "de")]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    scorer = language_id.Scorer(language_id.fit(docs, F.lit(True)))
    for text in ("the fox", "der hund hunde", "chiens renardeau", "quickly quicker foxes", "xyz", "le the der fox foxy et undone"):
        lang, score = scorer.predict(text)
        want = language_brute(rows, text, scorer.langs)
        assert lang == want[0] and score == pytest.approx(want[1], abs=1e-4)


@pytest.fixture(scope="module")
def licence_scanner(spark):
    lines = ["the cat sat on the mat today", "somebody writes about weather", "numbers like 12 and 13 occur", "the terms of the contract were not known to the public"]
    docs = spark.createDataFrame([(i, "\n".join(lines[i % 2 :])) for i in range(40)], "doc_id long, text string")
    return licenses.Scanner(licenses.fit(docs))


def test_licence_families_and_identifiers(licence_scanner):
    agpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    bsd3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    cases = {
        agpl: "agpl",
        agpl.replace("Affero ", ""): "gpl",
        agpl.replace("Affero", "Lesser").replace("program", "library"): "lgpl",
        bsd3: "bsd",
        "SPDX-License-Identifier: MIT": "mit",
        "// SPDX-License-Identifier: GPL-3.0-or-later": "gpl",
        "# SPDX-License-Identifier: AGPL-3.0-only": "agpl",
        "SPDX-License-Identifier: CC-BY-SA-4.0": "cc-by-sa",
        "Licensed under the GNU Lesser General Public License v3": "lgpl",
        "Licensed under the Eclipse Public License, version 1.0": "epl",
    }
    for text, family in cases.items():
        assert [f["family"] for f in licence_scanner.scan(text)] == [family], text
    for text in ("I have a driving license and a copyright question.", "the software of the public is free", "terms of the general contract", "MIT is in Cambridge"):
        assert licence_scanner.scan(text) == []


def test_wrapped_notices_are_one_paragraph(licence_scanner):
    notice = licenses.TEMPLATES["mit"][2]
    words = notice.split()
    wrapped = "\n".join(" * " + " ".join(words[i : i + 7]) for i in range(0, len(words), 7))
    text = f"some code here\n{wrapped}\nint main() and so on\n\nAll rights reserved."
    found = licence_scanner.scan(text)
    assert [f["family"] for f in found] == ["mit", "reserved"] and text[found[0]["start"] : found[0]["stop"]] == wrapped


def test_unknown_is_calibrated_and_templates_confirm(licence_scanner):
    """Scores of a softmax by hand, and shares of shingles counted one by one."""
    m = licence_scanner.model
    for text in ("Released under the MIT License.", "somebody writes under the license of the poet", "permission to use"):
        words = licenses.words_of(text)
        known = {g for g in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))] if g in m["index"]}
        z = [m["scale"] * (sum(m["weights"][m["index"][g]][k] for g in known) / math.sqrt(len(known)) + m["bias"][k]) + (m["unknown"] if k == len(m["families"]) else 0) for k in range(len(m["families"]) + 1)]
        p = [math.exp(v) / sum(map(math.exp, z)) for v in z]
        best = max(range(len(m["families"])), key=lambda k: p[k])
        want = (m["families"][best], p[best]) if p[best] >= 0.5 else ("unknown", p[-1])
        got = licence_scanner.predict(words)
        assert got[0] == want[0] and got[1] == pytest.approx(want[1], abs=1e-6)
    rng = np.random.default_rng(0)
    noise = [" ".join(rng.choice(["the", "of", "software", "license", "free", "terms", "copy", "public", "cat", "house"], 12)) for _ in range(200)]
    assert np.mean([licence_scanner.predict(licenses.words_of(t))[0] == "unknown" for t in noise]) >= 0.9
    assert all(licence_scanner.scan(t) == [] for t in noise)


def test_quality_scores_by_brute_force(spark, sf, plain):
    import zstandard

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels, F.lit(True))
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", quality.score(model, F.col("text"), spark).alias("s")).collect()}
    size = lambda piece, raw: len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_checksum=False, write_dict_id=False).compress(piece))
    for doc_id, text in plain[:25] + sorted(plain, key=lambda d: len(d[1] or ""))[-2:]:
        raw = (text or "").encode()
        bad, good = (sum(size(raw[i : i + 1024], d) for i in range(0, len(raw), 1024)) for d in model["dictionaries"])
        x = (bad - good + 64 * model["usual"]) / (len(raw) + 64)
        assert abs(got[doc_id] - 1 / (1 + math.exp(-(model["a"] * x + model["b"])))) < 1e-9


def objective(w, bias, own, y, swapped, penalty):
    """What the toxicity classifier makes small: weighted log loss, squared weights, squared changes of swapped texts."""
    score = lambda x: sum(w[i] for i in x) + bias
    loss = 0.0
    for x, k in zip(own, y, strict=True):
        loss += 0.5 / max(1, sum(v == k for v in y)) * math.log1p(math.exp(-score(x) if k else score(x)))
    loss += 0.5 * toxicity.RIDGE * float(np.dot(w, w))
    return loss + penalty / len(swapped) * sum((score(x) - score(own[i])) ** 2 for i, x in swapped)


def test_toxicity_weights_are_where_the_objective_is_least():
    random = np.random.default_rng(1)
    own = [sorted(set(random.integers(0, 8, 4).tolist())) for _ in range(30)]
    y = np.array([int(0 in x or random.random() < 0.2) for x in own])
    swapped = [(i, sorted({(f + 1) % 8 if f < 2 else f for f in own[i]})) for i in range(12)]
    w, bias = toxicity.train(own, y, swapped, 8, penalty=0.5, rounds=20_000)
    least = objective(w, bias, own, y, swapped, 0.5)
    for k in range(9):
        step = np.eye(9)[k] * 1e-4
        up, down = (objective(w + s * step[:8], bias + s * step[8], own, y, swapped, 0.5) for s in (1, -1))
        assert abs(up - down) / 2e-4 < 1e-4 and min(up, down) >= least - 1e-12
    free, _ = toxicity.train(own, y, swapped, 8, penalty=0.0, rounds=20_000)
    change = lambda w: sum((w[list(x)].sum() - w[own[i]].sum()) ** 2 for i, x in swapped)
    assert change(w) < change(free)


def test_toxicity_scores_by_brute_force(spark, sf, plain):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, F.lit(True))
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", toxicity.score(model, F.col("text"), spark).alias("s")).collect()}
    for doc_id, text in plain[:60]:
        found = set()
        for word in toxicity._words((text or "").lower()):
            found |= {word, *(word[:n] + "*" for n in toxicity.BEGINNINGS if len(word) > n)}
        z = sum(model["weights"][model["vocabulary"][f]] for f in found if f in model["vocabulary"]) + model["bias"]
        assert abs(got[doc_id] - 1 / (1 + math.exp(-(model["a"] * z + model["b"])))) < 1e-9
