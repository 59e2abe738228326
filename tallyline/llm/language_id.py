"""Language identification: words first, shorter and shorter character n-grams for words never seen.

A known word adds its log frequency in each language. An unseen word adds the mean of its character n-grams' log
frequencies: of length four, and where such a gram was never seen of its last three, two or one characters.

Defined cases: a null, empty or letterless text is `und` with score 0. Nothing learned gives `und` as well. Ties go to
the language that sorts first. Rows with a null lang are not learned from. Other columns are never inputs.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyline.llm.common import checkpointed, crc_of_id, join_counted, table

#: At most so many documents of each language are read to fit; every language that has any is learned.
FIT_ROWS_A_LANGUAGE = 4000
#: The most frequent words and n-grams that a language keeps, and all languages together, each an equal part of these.
ENTRIES_A_LANGUAGE, MODEL_ENTRIES, LONGEST = 40_000, 2_000_000, 4
#: Numbers that a task holds for unseen words, one for each language and word; and words added up at once.
REMEMBERED_NUMBERS, WORDS_AT_ONCE = 4_000_000, 50_000

WORD = r"\p{L}+"
_RESULT = "struct<lang_pred:string,score:double>"


def sample(docs: DataFrame, may_learn: Column, rows_a_language: int) -> DataFrame:
    """(doc_id, lang): at most rows_a_language documents of each language, those with the smallest hashes of their ids.

    Only rows whose hash falls in their language's share, and half as much again, leave their tasks.
    """
    parts = 1 << 30
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & may_learn).select("doc_id", "lang")
    sizes = checkpointed(known.groupBy("lang").agg(F.count("*").alias("total")))
    share = F.when(F.col("total") <= 2 * rows_a_language, parts).otherwise(F.floor(1.5 * parts * rows_a_language / F.col("total")) + 1)
    near = join_counted(known, sizes, ["lang"], "inner").where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < share)
    order = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    return near.withColumn("order", order).where(F.col("order") <= rows_a_language).select("doc_id", "lang").distinct()


def _top(counts: DataFrame, n: int) -> pa.Table:
    """lang, key, n of the n most frequent keys of each language; counts come from the bounded sample."""
    order = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "key"))
    return counts.withColumn("order", order).where(F.col("order") <= n).select("lang", "key", "n").toArrow().sort_by([("key", "ascending"), ("lang", "ascending")])


def fit(docs: DataFrame, may_learn: Column, rows_a_language: int = FIT_ROWS_A_LANGUAGE, model_entries: int = MODEL_ENTRIES) -> dict | None:
    """Log frequencies of words and n-grams by language, from a bounded sample of documents counted by Spark."""
    chosen = checkpointed(sample(docs, may_learn, rows_a_language))
    n_langs = chosen.select("lang").distinct().count()
    if not n_langs:
        return None
    entries = max(1, min(ENTRIES_A_LANGUAGE, model_entries // n_langs))
    texts = join_counted(docs.select("doc_id", "lang", "text"), chosen, ["doc_id", "lang"], "left_semi")
    words = texts.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), 0)).alias("key"))
    words = checkpointed(words.groupBy("lang", "key").agg(F.count("*").alias("n")))
    padded = F.concat(F.lit("^"), F.col("key"), F.lit("$"))

    def of_size(size: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - size + 1))
        return F.transform(at, lambda i: F.substring(padded, i, F.lit(size)))

    grams = words.select("lang", "n", F.explode(F.concat(*map(of_size, range(1, LONGEST + 1)))).alias("key"))
    grams = grams.groupBy("lang", "key").agg(F.sum("n").alias("n"))
    top_words, top_grams = _top(words, entries), _top(grams, entries)
    langs = sorted(set(top_words["lang"].to_pylist()))  # those with any word
    return {"langs": langs, "words": _table(top_words, langs), "grams": _table(top_grams, langs)} if langs else None


class Table(NamedTuple):
    """Gains of keys: those of the i-th key are gain[at[i]:at[i + 1]], in the languages lang[at[i]:at[i + 1]]."""

    keys: list
    at: np.ndarray
    lang: np.ndarray
    gain: np.ndarray

    def sums(self, rows: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
        """The gains of rows, each so many times, by language."""
        first, size = self.at[rows], self.at[rows + 1] - self.at[rows]
        place = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.lang[place], self.gain[place] * np.repeat(times, size), n)


def _table(rows: pa.Table, langs: list[str]) -> Table:
    """What a key's log frequency in a language exceeds that of an absent key by.

    An absent key has half a count of the largest language in every one, so that little text is no advantage.
    """
    keys = rows["key"].to_pylist()
    lang = np.searchsorted(np.array(langs, object), np.array(rows["lang"].to_pylist(), object)).astype(np.int32)
    count = rows["n"].to_numpy().astype(np.float64)
    total = np.maximum(np.bincount(lang, count, len(langs)), 1)
    first = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
    gain = np.log(count / total[lang]) - np.log(0.5 / total.max())
    return Table([keys[i] for i in first], np.array([*first, len(keys)], np.int64), lang, gain)


class Scorer:
    """Gains of words by language; remembers a bounded number of unseen ones."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        self.words, self.grams = model["words"], model["grams"]
        self.word_row = {k: i for i, k in enumerate(self.words.keys)}
        self.gram_row = {k: i for i, k in enumerate(self.grams.keys)}
        self.room = max(1000, REMEMBERED_NUMBERS // len(self.langs))
        self.unseen, self.kept = {}, np.zeros((self.room, len(self.langs)), np.float32)

    def backed_off(self, word: str) -> np.ndarray:
        """Mean gains of the n-grams of an unseen word, each the longest known ending of LONGEST characters."""
        padded, rows, get = f"^{word}$", [], self.gram_row.get
        for end in range(1, len(padded) + 1):
            for start in range(max(0, end - LONGEST), end):
                row = get(padded[start:end])
                if row is not None:
                    rows.append(row)
                    break
        if not rows:
            return np.zeros(len(self.langs))
        return self.grams.sums(np.array(rows), np.ones(len(rows)), len(self.langs)) / len(padded)

    def unseen_row(self, word: str) -> int:
        i = self.unseen.get(word)
        if i is None:
            i = self.unseen[word] = len(self.unseen)
            self.kept[i] = self.backed_off(word)
        return i

    def totals(self, items: list[tuple[str, int]]) -> np.ndarray:
        """The gains of words with their counts."""
        total, known, times = np.zeros(len(self.langs)), [], []
        new, new_times = [], []
        for word, n in items:
            i = self.word_row.get(word)
            if i is not None:
                known.append(i)
                times.append(n)
            else:
                new.append(word)
                new_times.append(n)
        if known:
            total += self.words.sums(np.array(known), np.array(times, np.float64), len(self.langs))
        for at in range(0, len(new), self.room):  # rows stay valid while they are added up
            part = new[at : at + self.room]
            if len(self.unseen) + len(part) > self.room:
                self.unseen.clear()
            total += np.array(new_times[at : at + self.room], np.float64) @ self.kept[[self.unseen_row(w) for w in part]]
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        words = Counter(_words(text.lower())) if text else None
        if not words:
            return "und", 0.0
        items, total = list(words.items()), np.zeros(len(self.langs))
        for at in range(0, len(items), WORDS_AT_ONCE):
            total += self.totals(items[at : at + WORDS_AT_ONCE])
        z = total / np.sqrt(sum(words.values()))
        p = np.exp(z - z.max())
        best = int(np.argmax(total))
        return self.langs[best], float(p[best] / p.sum())


_words = regex.compile(WORD).findall


def predictions(model: dict | None, text: Column, spark: SparkSession) -> Column:
    """struct(lang_pred, score) of a text column."""
    return _predict_udf(spark.sparkContext.broadcast(model))(text)


def _predict_udf(model):
    made = []

    def scan(texts: pa.Array) -> pa.Array:
        if model.value is not None and not made:
            made.append(Scorer(model.value))
        out = [made[0].predict(t) if made else ("und", 0.0) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], ["lang_pred", "score"])

    return F.arrow_udf(scan, _RESULT)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, crc_of_id() % 4 != 2)
    found = docs.select("doc_id", (crc_of_id() % 4 == 2).alias("held_out"), predictions(model, F.col("text"), spark).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


QUERIES = {"op8_language_id": op8_language_id}
ORACLE_SQL: dict[str, str] = {}
