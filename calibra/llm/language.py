"""Language identification by rank-order profiles.

A language's profile is its most frequent letter n-grams in order. A text's own order is compared with each profile:
every n-gram counts how far out of place it is, or the most possible if the profile lacks it, and the least sum wins.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibra.llm.common import small_batches, table, texts

#: Ranks in a profile, and n-grams of a text that are compared with it.
RANKS, TOP = 400, 300
#: n-grams counted at a time; distinct n-grams held for a language before they are sent on.
CHUNK, HELD = 1 << 20, 1 << 21
UNKNOWN = "und"


@functools.cache
def _word_characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter; is it a letter or a mark."""
    kinds = np.array([unicodedata.category(chr(i))[0] for i in range(0x110000)])
    letters = kinds == "L"
    return letters, letters | (kinds == "M")


def letters(text: str) -> np.ndarray:
    """Lower-case code points of words, each word between zeros; empty if the text has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter, in_word = _word_characters()
    if not is_letter[points].any():
        return np.empty(0, np.int64)
    kept = np.where(in_word[points], points, 0).astype(np.int64)
    kept = np.concatenate([[0], kept, [0]])
    return kept[np.concatenate([[True], (kept[1:] != 0) | (kept[:-1] != 0)])]


def gram_counts(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of one to three letters or word edges, as integers, and their counts."""
    grams, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for at in range(0, len(points), CHUNK):
        a = points[at : at + CHUNK + 2] + 1
        n = min(CHUNK, len(points) - at)
        pairs, triples = min(n, len(a) - 1), max(0, min(n, len(a) - 2))
        one = a[:n][a[:n] > 1] << 42
        two = a[:pairs] << 42 | a[1 : pairs + 1] << 21
        three = (a[:triples] << 42 | a[1 : triples + 1] << 21 | a[2 : triples + 2])[a[1 : triples + 1] > 1]
        more, of = np.unique(np.concatenate([one, two, three]), return_counts=True)
        grams, counts = merge(grams, counts, more, of)
    return grams, counts


def merge(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(a):
        return b, m
    keys, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n, m])).astype(np.int64)


def learn_profiles(rows: DataFrame, ranks: int = RANKS) -> DataFrame:
    """Profiles of rows(lang, text): lang, gram, rank from 0. Counts cover every row; ties go to the smaller gram.

    Null languages and texts teach nothing. Each task sums its n-grams before they are dealt by language and n-gram.
    """
    parts = rows.filter("lang is not null and text is not null").select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
    counts = parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # The filter on the row number itself lets Spark keep a language's first rows of each task before they are dealt.
    return counts.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= ranks).select("lang", "gram", (F.col("_n") - 1).alias("rank"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def sent(lang: str) -> pa.RecordBatch:
        grams, counts = held.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])

    for batch in small_batches(batches, "text", 1 << 20):
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
            by.setdefault(lang, []).append(letters(text))
        for lang, parts in by.items():
            points = np.concatenate(parts)
            if len(points):
                held[lang] = merge(*held.get(lang, (np.empty(0, np.int64), np.empty(0, np.int64))), *gram_counts(points[np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])]))
                if len(held[lang][0]) > HELD:
                    yield sent(lang)
    for lang in list(held):
        yield sent(lang)


class Profiles:
    """Profiles as one table of ranks: a row for each n-gram, a column for each language."""

    def __init__(self, rows: list[tuple[str, int, int]], ranks: int = RANKS):
        self.ranks = ranks
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.array(sorted({r[1] for r in rows}), np.int64)
        self.table = np.full((len(self.grams) + 1, max(1, len(self.langs))), -1, np.int64)
        at = {lang: k for k, lang in enumerate(self.langs)}
        for lang, gram, rank in rows:
            self.table[np.searchsorted(self.grams, gram), at[lang]] = rank

    def predict(self, text: str, top: int = TOP) -> tuple[str, float]:
        """The nearest language (the first by name of equals) and one less the share of the greatest distance."""
        points = letters(text)
        if not len(points) or not self.langs:
            return UNKNOWN, 0.0
        grams, counts = gram_counts(points)
        own = grams[np.lexsort((grams, -counts))[:top]]
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        ranks = self.table[np.where(self.grams[at] == own, at, len(self.grams))]
        apart = np.where(ranks >= 0, np.minimum(np.abs(ranks - np.arange(len(own))[:, None]), self.ranks), self.ranks).sum(axis=0)
        best = int(apart.argmin())
        return self.langs[best], float(1 - apart[best] / (self.ranks * len(own)))


def held_out(doc_id: Column, folds: int = 5, of: int = 0) -> Column:
    """Whether a document is in the fold that nothing is learned from; a null doc_id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == of


def profiles_of(docs: DataFrame, ranks: int = RANKS) -> Profiles:
    """RANKS rows for each language label reach the driver, whatever the number of documents."""
    rows = learn_profiles(docs.filter(~held_out(F.col("doc_id"))).select("lang", "text"), ranks).collect()
    return Profiles([(r["lang"], r["gram"], r["rank"]) for r in rows], ranks)


def identify(docs: DataFrame, profiles: Profiles, column: str = "lang_pred") -> DataFrame:
    """docs with two more columns at the end, the language of `text` and its score; `und` and 0 without letters.

    Only text decides. Every row stays, repeated ones too; any other columns are kept, and an empty table stays empty.
    A column of either name is replaced.
    """
    docs = docs.drop(column, "score")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{column}` string", "score double"])
    return docs.mapInArrow(_identifier(profiles, column), schema)


def _identifier(profiles: Profiles, column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found = [profiles.predict(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*batch.schema.names, column, "score"])

    return run


def op5_rank_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), profiles_of(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
