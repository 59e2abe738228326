"""Toxicity classifier with counterfactual regularisation.

A logistic regression over the presence of words and word beginnings. Where a labelled sentence names a group, the name
is swapped for others of its kind and the fit pays for the squared change of the text's score, so that a mere mention
of a group does not move it.

Defined cases: a null, empty or wordless text has the score of no features. Without labelled rows of both classes every
score is 0.5. Ties and repeated rows score alike. Only text is an input of a score; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.common import checkpointed, crc_of_id, labelled_sample, platt, sigmoid, table

#: At most so many labelled documents of each class are read to fit; features that the model keeps.
FIT_ROWS_A_CLASS, FEATURES = 4000, 4096
#: Weights of the counterfactual penalty and of the squared coefficients; rounds of the fit.
COUNTERFACTUAL, RIDGE, ROUNDS = 4.0, 2e-4, 400
#: Lengths of the word beginnings that are features beside the word.
BEGINNINGS = (4, 5)

# Names of groups, by kind; a name is swapped within its kind.
IDENTITY_TERMS = [
    ["women", "men", "woman", "man", "girls", "boys", "mujeres", "hombres", "femmes", "hommes", "frauen", "männer"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"],
    ["black", "white", "asian", "african", "european", "latino", "arab", "indigenous"],
    ["gay", "lesbian", "bisexual", "transgender", "straight", "queer"],
    ["immigrants", "refugees", "foreigners", "natives", "citizens", "migrants"],
    ["elderly", "disabled", "blind", "deaf", "young", "autistic"],
]

_words = regex.compile(r"\p{L}+").findall
_sentences = regex.compile(r"[^.!?\n]+").findall
_KIND = {w: (i, j) for i, kind in enumerate(IDENTITY_TERMS) for j, w in enumerate(kind)}


def features(words) -> set[str]:
    """The words, and the beginnings of the longer ones marked with *."""
    found = set(words)
    return found | {f"{w[:n]}*" for n in BEGINNINGS for w in found if len(w) > n}


def counterfactuals(text: str, swaps: int = 2) -> list[str]:
    """The text with the group names of its sentences swapped for the next ones of their kinds; none without names."""
    if not any(w in _KIND for w in _words(text.lower())):
        return []

    def swapped(sentence: str, by: int) -> str:
        def other(m):
            at = _KIND.get(m[0].lower())
            return m[0] if at is None else IDENTITY_TERMS[at[0]][(at[1] + by) % len(IDENTITY_TERMS[at[0]])]

        return regex.sub(r"\p{L}+", other, sentence)

    return [".".join(swapped(s, by) for s in _sentences(text)) for by in range(1, swaps + 1)]


def _feature_udf():
    def scan(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(features(_words((t or "").lower()))) for t in texts.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(scan, "array<string>")


def _index_udf(vocabulary):
    """struct(own, swapped): the known features of a text, and of each of its counterfactuals."""

    def scan(texts: pa.Array) -> pa.Array:
        index = vocabulary.value
        known = lambda t: sorted(index[f] for f in features(_words(t.lower())) if f in index)
        out = [{"own": known(t or ""), "swapped": [known(c) for c in counterfactuals(t or "")]} for t in texts.to_pylist()]
        return pa.array(out, pa.struct([("own", pa.list_(pa.int32())), ("swapped", pa.list_(pa.list_(pa.int32())))]))

    return F.arrow_udf(scan, "struct<own:array<int>,swapped:array<array<int>>>")


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, label: str = "toxic", rows_a_class: int = FIT_ROWS_A_CLASS, penalty: float = COUNTERFACTUAL) -> dict | None:
    """{vocabulary, weights, bias, a, b} from a bounded sample, or None if a class is missing.

    Features are counted by class in Spark; those with the largest chi-square are kept, and every group name.
    """
    sample = checkpointed(labelled_sample(docs, labels, label, may_learn, rows_a_class))
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(sizes) < 2 or min(sizes.values()) < 2:
        return None
    n0, n1 = sizes[0], sizes[1]
    counted = sample.select("label", F.explode(_feature_udf()("text")).alias("f")).groupBy("f").agg(F.sum("label").alias("k1"), F.sum(1 - F.col("label")).alias("k0"))
    spread = F.col("k1") / n1 - F.col("k0") / n0
    pooled = (F.col("k1") + F.col("k0")) / (n0 + n1)
    strength = spread * spread / (pooled * (1.0000001 - pooled))
    kept = counted.where("k1 + k0 >= 3").orderBy(strength.desc(), "f").limit(FEATURES).collect()
    vocabulary = {f: i for i, f in enumerate(sorted({*_KIND, *(r["f"] for r in kept)}))}
    index = _index_udf(docs.sparkSession.sparkContext.broadcast(vocabulary))
    rows = sample.select("doc_id", "label", index("text").alias("x")).orderBy("doc_id").collect()
    own = [r["x"]["own"] for r in rows]
    y = np.array([r["label"] for r in rows])
    swapped = [(i, c) for i, r in enumerate(rows) for c in r["x"]["swapped"]]
    weights, bias = train(own, y, swapped, len(vocabulary), penalty)
    # the curve comes from rows that the weights behind their scores have not seen
    seen = np.arange(len(y)) % 3 > 0
    place = np.cumsum(seen) - 1
    w, b_ = train([x for x, k in zip(own, seen) if k], y[seen], [(place[i], x) for i, x in swapped if seen[i]], len(vocabulary), penalty)
    a, b = platt(np.array([w[x].sum() for x, k in zip(own, seen) if not k]) + b_, y[~seen])
    return {"vocabulary": vocabulary, "weights": weights, "bias": bias, "a": float(a), "b": float(b)}


def train(own: list[list[int]], y: np.ndarray, swapped: list[tuple[int, list[int]]], n: int, penalty: float = COUNTERFACTUAL, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias of the regularised fit, by accelerated gradient steps; classes weigh the same."""
    flat = lambda xs: (np.repeat(np.arange(len(xs)), [len(x) for x in xs]), np.array([i for x in xs for i in x], np.int64))
    row, col = flat(own)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    base = np.array([i for i, _ in swapped], np.int64)
    c_row, c_col = flat([x for _, x in swapped])
    b_row, b_col = flat([own[i] for i in base])
    m = len(swapped)
    score = lambda w, r, c, k: np.bincount(r, w[c], k) if k else np.zeros(0)
    w, bias = np.zeros(n), 0.0
    w_at, bias_at, momentum = w, bias, 1.0
    longest = max(1, max(map(len, own), default=1))
    curvature = 0.25 * (longest + 1) * 0.5 + RIDGE + (2 * penalty * 16 if m else 0)
    for _ in range(rounds):
        miss = share * (sigmoid(score(w_at, row, col, len(y)) + bias_at) - y)
        g = np.bincount(col, miss[row], n) + RIDGE * w_at
        if m:
            change = (score(w_at, c_row, c_col, m) - score(w_at, b_row, b_col, m)) * (2 * penalty / m)
            g += np.bincount(c_col, change[c_row], n) - np.bincount(b_col, change[b_row], n)
        w_next, bias_next = w_at - g / curvature, bias_at - miss.sum() / curvature
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        w_at, bias_at = w_next + (momentum - 1) / after * (w_next - w), bias_next + (momentum - 1) / after * (bias_next - bias)
        w, bias, momentum = w_next, bias_next, after
    return w, float(bias)


def score(model: dict | None, text: Column, spark: SparkSession) -> Column:
    return _score_udf(spark.sparkContext.broadcast(model))(text)


def _score_udf(model):
    def scan(texts: pa.Array) -> pa.Array:
        m = model.value
        if m is None:
            return pa.array(np.full(len(texts), 0.5))
        weight = dict(zip(m["vocabulary"], m["weights"][list(m["vocabulary"].values())].tolist()))
        get = weight.get
        z = [sum(get(f, 0.0) for f in sorted(features(_words((t or "").lower())) & weight.keys())) for t in texts.to_pylist()]
        return pa.array(sigmoid(m["a"] * (np.array(z, np.float64) + m["bias"]) + m["b"]))

    return F.arrow_udf(scan, "double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), crc_of_id() % 5 != 0)
    scored = docs.select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), score(model, F.col("text"), spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE_SQL: dict[str, str] = {}
