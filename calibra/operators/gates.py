"""What must hold before a run is judged: the same records, categories and targets, a baseline that is met again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups of boxes that have an arm: misread and correct ones.
MISREAD, CORRECT = "M", "C"
#: Sections of a configuration that are compared, the one in which two runs may differ with the fields in which they may,
#: and fields that name files, which are the same file in any folder.
SECTIONS = ["train_config", "model_config", "class_names", "num_classes"]
SECTION, FIELDS = "train_config", ["aug_config", "augmentation_backend", "seed", "dataset_dir", "output_dir"]
FILE_FIELDS = ["model_config.pretrain_weights"]


def baseline(recorded: DataFrame, local: DataFrame, *keys: str) -> DataFrame:
    """Every row of recorded(keys, grp, outcome) that has an arm, with the outcome met again, and whether it is the same."""
    again = local.select(*keys, F.col("outcome").alias("met"))
    return recorded.filter(F.col("grp").isin(MISREAD, CORRECT)).join(again, [*keys], "left").withColumn("ok", F.coalesce(F.col("outcome") == F.col("met"), F.lit(False)))


def arm_boxes(recorded: DataFrame, gate: DataFrame, *keys: str) -> DataFrame:
    """keys, arm: misread boxes are in ring, sham and whole; correct ones in reverse (ring not above 0) or keep, or none."""
    arm = lambda *names: F.array(*[F.lit(n) for n in names])
    correct = F.col("grp") == CORRECT
    arms = F.when(F.col("grp") == MISREAD, arm("ring", "sham", "whole")).when(correct & (F.col("ring_b") <= 0), arm("reverse")).when(correct & (F.col("ring_b") > 0), arm("keep"))
    return recorded.join(gate.filter("ok").select(*keys), [*keys], "left_semi").select(*keys, F.explode(arms).alias("arm"))


def success(arm: Column, outcome: Column, target: str, misread: str) -> Column:
    """Whether an arm's box came out as wanted: as the target, in `reverse` as what it is misread for."""
    return outcome == F.when(arm == "reverse", misread).otherwise(target)


def category_differences(categories: DataFrame) -> DataFrame:
    """Of categories(split, id, name): those that are not in every split, and in how many they are."""
    n = categories.agg(F.count_distinct("split").alias("of"))
    return categories.groupBy("id", "name").agg(F.count_distinct("split").alias("splits")).join(F.broadcast(n), F.col("splits") < F.col("of")).drop("of")


def shared_days(rows: DataFrame) -> DataFrame:
    """Days of rows(split, day) that the test part shares with another, which must be none."""
    return rows.filter("split = 'test'").select("day").intersect(rows.filter("split <> 'test'").select("day"))


def record_differences(one: DataFrame, other: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, field, one, other: where the records of two runs do not say the same, missing values included."""
    long = lambda df, name: df.select(*keys, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(keys, fields, "field", name)
    return long(one, "one").join(long(other, "other"), [*keys, "field"], "full_outer").filter(~F.col("one").eqNullSafe(F.col("other")))


def record_problems(records: DataFrame, *keys: str) -> DataFrame:
    """keys, problem of records(keys, expected, run, check_ok): a wrong run, and a check that its own notebook did not pass."""
    wrong = F.when(~F.col("run").eqNullSafe(F.col("expected")), "run")
    failed = F.when(~F.coalesce("check_ok", F.lit(False)), "config_check")
    return records.select(*keys, F.explode(F.array_compact(F.array(wrong, failed))).alias("problem"))


def target_refusals(gt: DataFrame, target: str, expected: int) -> DataFrame:
    """reason, n: images with several boxes of the target class, and the number of such boxes if it is not the fixed one."""
    each = gt.filter(F.col("cls") == target).groupBy("image").agg(F.count("*").alias("boxes"))
    found = each.agg(F.count_if(F.col("boxes") > 1).alias("several"), F.coalesce(F.sum("boxes"), F.lit(0)).alias("number"))
    reasons = [found.filter("several > 0").select(F.lit("several").alias("reason"), F.col("several").alias("n"))]
    reasons.append(found.filter(F.col("number") != expected).select(F.lit("number").alias("reason"), F.col("number").alias("n")))
    return reduce(DataFrame.unionByName, reasons)


def allowed_field(path: Column) -> Column:
    """Whether two runs may differ in a dotted path."""
    return (F.split_part(path, F.lit("."), F.lit(1)) == SECTION) & F.split_part(path, F.lit("."), F.lit(2)).isin(FIELDS)


def config_problems(one: DataFrame, other: DataFrame, keys: list[str], sections: list[str] | None = None, files: list[str] | None = None) -> DataFrame:
    """keys, path, one, other: fields of two flattened configurations(keys, path, value) that differ and may not.

    Only the compared sections count. A field that one side lacks differs; a field that names a file differs if the file's
    name does.
    """
    from calibra.functions.scalars import basename

    compared = F.split_part(F.col("path"), F.lit("."), F.lit(1)).isin(sections or SECTIONS) & ~allowed_field(F.col("path"))
    named = F.col("path").isin(FILE_FIELDS if files is None else files)
    pick = lambda df, name: df.filter(compared).select(*keys, "path", F.col("value").alias(name), F.when(named, basename(F.col("value"))).otherwise(F.col("value")).alias(f"_{name}"))
    both = pick(one, "one").join(pick(other, "other"), [*keys, "path"], "full_outer")
    # For a file that neither names, nothing is compared; elsewhere a missing field is null on one side alone.
    return both.filter(~F.col("_one").eqNullSafe(F.col("_other"))).drop("_one", "_other")


def treatment_problems(flat: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, wanted, value: fields of wanted(keys, path, value) that a flattened configuration has otherwise or not at all."""
    need = wanted.select(*keys, "path", F.col("value").alias("wanted"))
    return need.join(flat.select(*keys, "path", "value"), [*keys, "path"], "left").filter(~F.col("wanted").eqNullSafe(F.col("value"))).select(*keys, "path", "wanted", "value")


def uncovered(outcomes: DataFrame, measured: DataFrame, *keys: str) -> DataFrame:
    """keys of outcomes without a measured value: there must be none."""
    return outcomes.select(*keys).join(measured.filter(F.col("value").isNotNull()).select(*keys), [*keys], "left_anti")


def not_reproduced(recorded: DataFrame, scored: DataFrame, kinds: list[str], *keys: str) -> DataFrame:
    """keys, outcome, recorded, scored: kinds of outcome whose numbers are not those on record; others count as `other`."""
    kind = F.when(F.col("outcome").isin(kinds), F.col("outcome")).otherwise("other")
    count = lambda df, name: df.groupBy(*keys, kind.alias("outcome")).agg(F.count("*").alias(name))
    both = count(recorded, "recorded").join(count(scored, "scored"), [*keys, "outcome"], "full_outer").na.fill(0, ["recorded", "scored"])
    return both.filter("recorded <> scored")


class Refused(ValueError):
    """An input does not allow a verdict; what comes after it was not opened."""


def refuse(rows: DataFrame, message: str, shown: int = 3) -> None:
    """Refuses if there are rows, and shows the first of them."""
    found = [tuple(r) for r in rows.limit(shown).collect()]
    if found:
        raise Refused(f"{message}: {', '.join(' '.join(map(str, r)) for r in found)}")
