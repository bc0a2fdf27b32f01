"""Written decision rules over one-row tables, and checks that refuse to decide.

Each rule is a CASE expression over named numbers, in the order in which it is written down.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the rules.
MIN_BOXES, MIN_IMAGES = 15, 6
MAP_MARGIN, CLASS_MARGIN, EPSILON = 0.02, 0.05, 1e-9
VOID_AT_MOST, ALPHA = 20, 0.05
MOST_MISMATCHES = 2


def confusion_verdict(test: DataFrame, val: DataFrame, suspects: list[str], controls: list[str]) -> DataFrame:
    """supported, rejected or mixed, from errors() of the test and validation parts.

    Supported if for every suspect its partner is its largest error, more of its boxes go to the partner than of any
    control, and than on validation. Rejected if every suspect is mostly missed, more than taken for its partner.
    """
    rest = test.filter(F.col("cls").isin(controls)).agg(F.max("share").alias("most"))
    own = val.select("cls", F.col("share").alias("val_share"))
    rows = test.filter(F.col("cls").isin(suspects)).join(own, "cls").withColumn("one", F.lit(1)).join(rest.withColumn("one", F.lit(1)), "one")
    a = F.col("confused") > F.greatest("other", "missed")
    missed_top = (F.col("missed") > F.greatest("confused", "other")) & (F.col("missed") > F.col("confused"))
    out = rows.agg(F.bool_and(a & (F.col("share") > F.col("most")) & (F.col("share") > F.col("val_share"))).alias("s"), F.bool_and(missed_top).alias("r"))
    return out.select(F.when(F.col("s"), "supported").when(F.col("r"), "rejected").otherwise("mixed").alias("verdict"))


def backdrop(boxes_m: Column, boxes_c: Column, images_m: Column, images_c: Column, auc: Column, low: Column, high: Column) -> Column:
    few = (boxes_m < MIN_BOXES) | (boxes_c < MIN_BOXES) | (images_m < MIN_IMAGES) | (images_c < MIN_IMAGES)
    return (
        F.when(few, "inconclusive")
        .when((auc >= 0.70) & (low > 0.55), "for")
        .when((auc <= 0.30) & (high < 0.45), "reversed")
        .when((low >= 0.30) & (high <= 0.70), "against")
        .otherwise("inconclusive")
    )


def recolour(n: Column, ring: Column, whole: Column, sham: Column) -> Column:
    return (
        F.when(sham > 2, "pipeline noise")
        .when(ring >= n / 2, "for (local)")
        .when(whole >= n / 2, "for (scene)")
        .when((ring <= n / 10) & (whole <= n / 10), "against")
        .otherwise("inconclusive")
    )


def gate(mismatches: Column, verdict: Column) -> Column:
    """No verdict where the baseline is not met again."""
    return F.when(mismatches > MOST_MISMATCHES, "no verdict").otherwise(verdict)


def guardrails(control: DataFrame, treatment: DataFrame, skipped: list[str]) -> DataFrame:
    """Whether a treatment keeps up: rows of (name, score) in both runs, where the names `map` and `val` have the wider rule."""
    rows = control.select("name", F.col("score").alias("before")).join(treatment.select("name", F.col("score").alias("after")), "name")
    overall = F.col("name").isin("map", "val")
    kept = F.when(overall, F.col("after") >= F.col("before") - MAP_MARGIN - EPSILON).otherwise(F.col("before") - F.col("after") <= CLASS_MARGIN + EPSILON)
    return rows.filter(~F.col("name").isin(skipped)).select("name", "before", "after", kept.alias("ok"))


def run_decision(m_c: Column, k_c: Column, m_a: Column, k_a: Column, p: Column, safe: Column, valid: Column) -> Column:
    halved, sure, read = m_a <= F.floor(m_c / 2), p < ALPHA, 2 * (k_a - k_c) >= m_c - m_a
    return (
        F.when(~valid, "invalid")
        .when(m_c <= VOID_AT_MOST, "void")
        .when(halved & sure & read & safe, "fixed")
        .when(halved & sure & read, "fixed at a cost")
        .when(halved & sure, "displaced")
        .otherwise("not fixed")
    )


def flatten(configs: DataFrame, *keys: str) -> DataFrame:
    """configs(keys or run, config as JSON) by dotted path: keys, path, value as JSON. Arrays are values, and so are empty objects.

    A configuration is opened once and walked in one pass, in Arrow batches; nested levels make no jobs of their own.
    """
    keys = keys or ("run",)

    def leaves(batches):
        for batch in batches:
            paths, values, ends = [], [], [0]
            for text in batch.column("config").to_pylist():
                _leaves("", json.loads(text), paths, values)
                ends.append(len(paths))
            rows = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(ends)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in keys), pa.array(paths, pa.string()), pa.array(values, pa.string())], [*keys, "path", "value"])

    kinds = {f.name: f.dataType for f in configs.schema}
    schema = T.StructType([T.StructField(k, kinds[k]) for k in keys] + [T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])
    return configs.select(*keys, "config").filter(F.col("config").isNotNull()).mapInArrow(leaves, schema)


#: One encoder for all values: json.dumps makes a new one at each call with separators of its own.
_as_json = json.JSONEncoder(separators=(",", ":")).encode


def _leaves(path: str, value, paths: list[str], values: list[str]) -> None:
    """Adds paths and values of what is not an object; text as it is, anything else as JSON."""
    kind = type(value)
    if kind is dict and value:
        for k, v in value.items():
            _leaves(f"{path}.{k}" if path else k, v, paths, values)
        return
    paths.append(path)
    if kind is str:
        values.append(value)
    elif kind is int or kind is float and value.is_integer():  # 1.0 is 1
        values.append(str(int(value)))
    else:
        values.append(_as_json(value))


def config_diff(one: DataFrame, other: DataFrame, allowed: list[str], by_name: list[str]) -> DataFrame:
    """Fields of two flattened configs that differ: path, one, other, allowed. Those of by_name compare by file name."""
    from calibra.functions.scalars import basename

    pick = lambda df, name: df.select("path", F.when(F.col("path").isin(by_name), basename(F.col("value"))).otherwise(F.col("value")).alias(name))
    both = pick(one, "one").join(pick(other, "other"), "path", "full_outer").filter(~F.col("one").eqNullSafe(F.col("other")))
    last = F.element_at(F.split("path", r"\."), -1)
    return both.withColumn("allowed", last.isin(allowed) | F.col("path").isin(allowed))


def required(df: DataFrame, complete: Column, message: str) -> DataFrame:
    """df, or an error when it is read if any row is not complete."""
    return df.filter(F.when(complete, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
