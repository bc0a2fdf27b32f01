"""Expressions on names, counts, hashes and rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 97.5 % point of the normal distribution, as the intervals use it.
Z = 1.96
STAMP = r"(?:IMG|VID|PXL)_(\d{8})_(\d{6})"


def captured_at(file: Column) -> Column:
    """The moment in a phone's file name; null if there is none or no such moment exists."""
    digits = F.concat(F.regexp_extract(file, STAMP, 1), F.regexp_extract(file, STAMP, 2))
    return F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss"))


def exclusion(file: Column, stamp: Column, n_boxes: Column, conflict: Column) -> Column:
    """Why an image is left out, the first reason of four; empty if it stays."""
    return (
        F.when(file.startswith("ZE_"), "third_party_video")
        .when(stamp.isNull(), "third_party_press")
        .when(n_boxes == 0, "no_boxes")
        .when(conflict, "double_labelled")
        .otherwise("")
    )


def box_counts(classes: Column) -> Column:
    """An array of classes as a map from class to count."""
    kinds = F.sort_array(F.array_distinct(classes))
    return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(classes, lambda c: c == k))))


def format_counts(counts: Column) -> Column:
    """{"a": 1, "b": 2} as a:1;b:2, by class."""
    return F.array_join(F.transform(F.sort_array(F.map_entries(counts)), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ";")


def parse_counts(text: Column) -> Column:
    pairs = F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: p != "")
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, ":", 1), F.substring_index(p, ":", -1).cast("int"))))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def hex_words(text: Column, words: int = 8) -> Column:
    """Eight hex digits a word: 32 bits each, which a long holds without a sign."""
    return F.array(*[F.conv(F.substring(text, 8 * i + 1, 8), 16, 10).cast("long") for i in range(words)])


def sign_words(vector: Column, words: int) -> Column:
    """The signs of a vector's components as bits, 32 a word."""

    def word(i: int) -> Column:
        part = F.slice(vector, 32 * i + 1, 32)
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, v: a * 2 + F.when(v > 0, 1).otherwise(0))

    return F.array(*[word(i) for i in range(words)])


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b != 0, a.cast("double") / F.when(b != 0, b).otherwise(1)).otherwise(0.0)


def wilson(k: Column, n: Column) -> Column:
    """Low and high end of a share's interval, within [0, 1]; both 0 without trials."""
    some = F.greatest(n, F.lit(1)).cast("double")
    p, z2 = k / some, Z * Z
    middle = (p + z2 / (2 * some)) / (1 + z2 / some)
    half = Z * F.sqrt(p * (1 - p) / some + z2 / (4 * some * some)) / (1 + z2 / some)
    low, high = F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)
    return F.struct(F.when(n > 0, low).otherwise(0.0).alias("low"), F.when(n > 0, high).otherwise(0.0).alias("high"))


def outcome_group(true: Column, pred: Column, partner: Column) -> Column:
    return F.when(pred == partner, "misread").when(pred == true, "correct").when(pred == "missed", "missed").otherwise("other")


def side(ring_b: Column) -> Column:
    """Yellow above 0, else blue."""
    return F.when(ring_b > 0, "yellow").otherwise("blue")
