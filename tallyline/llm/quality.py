"""Quality classifier by compression: zstandard dictionaries of good and of bad labelled text.

A text is cut into pieces, each piece is compressed with either dictionary, and the difference of the two total sizes
over the text's own size is mapped to a score by a logistic curve fitted on labelled rows that no dictionary has seen.
(Over the sum of the two sizes, texts that repeat themselves and compress to nothing under both would look good.) A few
bytes say little, so each text counts as if PRIOR_BYTES of a usual good text stood beside it. Lines that both classes
have, such as boilerplate, are in neither dictionary.

Defined cases: a null or empty text has no bytes, so its score is that of a usual good text. Without labelled rows of both classes every score is 0.5. Ties and repeated rows score alike.
Only text is an input of a score; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.common import crc_of_id, labelled_sample, platt, sigmoid, table

#: At most so many labelled documents of each class are read to fit; half train a dictionary, half the curve.
FIT_ROWS_A_CLASS = 2500
#: Bytes of a dictionary and of a piece, and the compression level.
DICTIONARY_BYTES, PIECE_BYTES, LEVEL = 112640, 1024, 3
#: Bytes of a usual good text that stand beside each text.
PRIOR_BYTES = 64


def pieces(text: bytes, size: int = PIECE_BYTES) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def train(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of the texts; raw content where there is too little to train one."""
    parts = [p for t in texts for p in pieces(t)]
    try:
        return zstandard.train_dictionary(size, parts, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-size:] or b"\n"


def compressors(dictionaries: tuple[bytes, bytes], level: int = LEVEL) -> list:
    out = []
    for raw in dictionaries:
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def difference(text: bytes | None, pair: list, usual: float = 0.0) -> float:
    """(bytes with the bad dictionary - bytes with the good one) / bytes, over the whole text and the prior bytes."""
    good = bad = 0
    text = text or b""
    for p in pieces(text):
        bad += len(pair[0].compress(p))
        good += len(pair[1].compress(p))
    return (bad - good + usual * PRIOR_BYTES) / (len(text) + PRIOR_BYTES)


def own_lines(texts: list[bytes], others: list[bytes]) -> list[bytes]:
    """The texts without lines that the others have too."""
    known = {line for t in others for line in t.split(b"\n")}
    return [b"\n".join(line for line in t.split(b"\n") if line not in known) for t in texts]


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, label: str = "quality", rows_a_class: int = FIT_ROWS_A_CLASS) -> dict | None:
    """{dictionaries, usual, a, b} from a bounded sample, or None if a class is missing."""
    rows = sorted((r["doc_id"], r["label"], (r["text"] or "").encode()) for r in labelled_sample(docs, labels, label, may_learn, rows_a_class).collect())
    by_class = [[t for _, k, t in rows if k == c] for c in (0, 1)]
    if min(map(len, by_class)) < 2:
        return None
    bad, good = (texts[::2] for texts in by_class)
    dictionaries = train(own_lines(bad, good)), train(own_lines(good, bad))
    pair = compressors(dictionaries)
    usual = float(np.median([difference(t, pair) for t in by_class[1][1::2]]))
    x = np.array([difference(t, pair, usual) for texts in by_class for t in texts[1::2]])
    y = np.repeat([0, 1], [len(texts[1::2]) for texts in by_class])
    a, b = platt(x, y)
    return {"dictionaries": dictionaries, "usual": usual, "a": float(a), "b": float(b)}


def score(model: dict | None, text: Column, spark: SparkSession) -> Column:
    """The calibrated score of a text column; the model is two dictionaries of a fixed size and two numbers."""
    return _score_udf(spark.sparkContext.broadcast(model))(text)


def _score_udf(model):
    def scan(texts: pa.Array) -> pa.Array:
        m = model.value
        if m is None:
            return pa.array(np.full(len(texts), 0.5))
        pair = compressors(m["dictionaries"])
        x = np.array([difference(t, pair, m["usual"]) for t in texts.cast(pa.binary()).to_pylist()], np.float64)
        return pa.array(sigmoid(m["a"] * x + m["b"]))

    return F.arrow_udf(scan, "double")


def drop_low_quality(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, least: float = 0.5) -> DataFrame:
    """docs whose score is at least `least`; all columns remain."""
    model = fit(docs, labels, F.lit(True) if may_learn is None else may_learn)
    return docs.where(score(model, F.col("text"), docs.sparkSession) >= least)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), crc_of_id() % 3 != 1)
    scored = docs.select("doc_id", (crc_of_id() % 3 == 1).alias("held_out"), score(model, F.col("text"), spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op10_quality": op10_quality}
ORACLE_SQL: dict[str, str] = {}
