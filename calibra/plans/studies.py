"""The studies that the commands run: each reads its inputs, decides by the written rules, and gives a nested result.

Boxes, predictions and pictures stay tables; what a result holds are counts, a row for each class, group or arm.
"""

from __future__ import annotations

import hashlib
import platform
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.functions import scalars as S
from calibra.operators import gates as G
from calibra.operators import matching as M
from calibra.operators import pixels as P
from calibra.operators import rules as R
from calibra.operators import statistics as X
from calibra.operators.ranges import use_checkpoints
from calibra.sources import datasets as D


@dataclass(frozen=True)
class Protocol:
    """What the studies fix beforehand: the class whose boxes are judged, what it is misread as, and their numbers."""

    target: str = "1.5kg"
    misread: str = "0.5kg"
    boxes: int = 100
    suspects: tuple[str, ...] = ("0.5kg", "1.5kg")
    controls: tuple[str, ...] = ("1kg", "2kg", "2.5kg")
    partners: dict[str, str] = field(default_factory=lambda: {a: b for x, y in (("0.5kg", "5kg"), ("1kg", "10kg"), ("1.5kg", "15kg"), ("2kg", "20kg"), ("2.5kg", "25kg")) for a, b in ((x, y), (y, x))})
    threshold: float = 0.80
    reps: int = 10_000
    seed: int = 20260925

    @property
    def kinds(self) -> list[str]:
        return [self.target, self.misread, M.MISSED]


def class_names(categories: list[dict]) -> list[str]:
    """The classes among categories: those under another category, or all where none is."""
    under = [c["name"] for c in categories if c.get("supercategory") not in (None, "", "none")]
    return under or [c["name"] for c in categories]


def frame_of(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "cls string, ord int")


def prepared_part(spark: SparkSession, prepared: str, split: str) -> tuple[DataFrame, DataFrame]:
    """Images and boxes of a part of a prepared set."""
    images, boxes = D.read_coco(spark, prepared, [D.PARTS[split]])
    return images.select("image", "file_name", "width", "height"), boxes.drop("split")


def outcomes_of(targets: DataFrame, matched: DataFrame, threshold: float) -> DataFrame:
    """image, gt_idx and outcome of target boxes: the class that a prediction at the threshold gives the box, or missed."""
    read = matched.filter((F.col("conf") >= threshold) & F.col("gt_idx").isNotNull()).select("image", "gt_idx", F.col("cls").alias("read"))
    return targets.join(read, ["image", "gt_idx"], "left").withColumn("outcome", F.coalesce("read", F.lit(M.MISSED))).drop("read")


def as_map(df: DataFrame, key: str, *values: str) -> dict:
    rows = df.collect()
    return {r[key]: (r[values[0]] if len(values) == 1 else {v: r[v] for v in values}) for r in rows}


def nested_confusion(table: DataFrame) -> dict:
    return {r["truth"]: dict(sorted(r["pred"].items())) for r in sorted(M.confusion(table).collect())}


# --- one run's predictions against the boxes


def scored_part(images: DataFrame, gt: DataFrame, pred: DataFrame, matched: DataFrame, threshold: float, classes: DataFrame, protocol: Protocol) -> tuple[dict, DataFrame]:
    """A part's scores at a threshold, and its errors by class."""
    spark = classes.sparkSession
    table = M.outcomes(images, gt, matched, threshold).checkpoint()
    partners = spark.createDataFrame([(c, protocol.partners.get(c)) for c in protocol.partners], "cls string, partner string").join(classes, "cls", "left_semi")
    alone = classes.join(partners, "cls", "left_anti").select("cls", F.lit(None).cast("string").alias("partner"))
    errors = M.errors(table, partners.unionByName(alone)).checkpoint()
    ap = as_map(M.average_precision(gt, pred), "cls", "ap")
    names = [r["cls"] for r in classes.orderBy("ord").collect()]
    confused = nested_confusion(table.filter((F.col("truth") != F.col("pred")) & (F.col("truth") != M.BACKGROUND)))
    per = as_map(M.per_class(table, classes), "cls", "precision", "recall", "n_gt", "n_pred")
    wrong = {r["cls"]: r for r in errors.collect()}
    result = {
        "ap50_recomputed": {c: ap[c] for c in names if c in ap},
        "micro_f1": M.micro_f1(table).first()["f1"],
        "per_class": {c: per[c] for c in names},
        "errors": {
            c: {
                "partner_class": wrong[c]["partner"], "n_gt": wrong[c]["n"], "correct": wrong[c]["correct"], "partner": wrong[c]["confused"], "missed": wrong[c]["missed"],
                "other": wrong[c]["other"], "partner_share": wrong[c]["share"], "partner_ci95": [wrong[c]["low"], wrong[c]["high"]], "confused_as": confused.get(c, {}),
            }
            for c in names
        },
        "background_predictions": table.filter(F.col("truth") == M.BACKGROUND).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0],
    }
    result["map50_recomputed"] = sum(ap.values()) / len(ap) if ap else None
    return result, errors


def evaluation(spark: SparkSession, prepared: str, results: str, protocol: Protocol) -> dict:
    """Precision, recall, AP and errors on validation and test at the threshold that validation chooses, and the verdict."""
    use_checkpoints(spark)
    classes = frame_of(spark, class_names(D.categories_of(spark, prepared, ["valid", "test"])))
    parts = {s: prepared_part(spark, prepared, s) for s in ("val", "test")}
    preds = {s: D.read_predictions(spark, f"{results}/predictions_{s}.csv") for s in parts}
    matched = {s: M.match(parts[s][1], preds[s]).checkpoint() for s in parts}
    best = M.best_threshold(M.sweep(*parts["val"], matched["val"])).first()
    report = {"iou_threshold": M.MIN_IOU, "confidence_threshold": best["threshold"], "val_micro_f1_at_threshold": best["f1"]}
    errors = {}
    for s in parts:
        report[s], errors[s] = scored_part(*parts[s], preds[s], matched[s], best["threshold"], classes, protocol)
    known = set(report["test"]["errors"])
    if {*protocol.suspects, *protocol.controls} <= known:
        report["verdict"] = R.confusion_verdict(errors["test"], errors["val"], list(protocol.suspects), list(protocol.controls)).first()["verdict"]
        report["verdict_reasons"] = [f"{c}: partner {e['partner']}, other {e['other']}, missed {e['missed']}, partner's share {e['partner_share']:.4f}, on validation {report['val']['errors'][c]['partner_share']:.4f}" for c in protocol.suspects for e in [report["test"]["errors"][c]]]
    else:
        report["verdict"], report["verdict_reasons"] = None, ["the set lacks classes of the rule"]
    return report


# --- the ring around the target boxes


def pictures_of_part(spark: SparkSession, prepared: str, split: str, images: DataFrame, gt: DataFrame) -> DataFrame:
    """Pictures of the images that have boxes, with these in order. A picture of another size than its label says is an error."""
    boxes = gt.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("gt_idx", "cls", "x", "y", "w", "h"))).alias("b"))
    named = images.select("image", "file_name", F.col("width").alias("_w"), F.col("height").alias("_h")).join(boxes, "image")
    decoded = D.read_pictures(spark, f"{prepared}/{D.PARTS[split]}").drop("folder").withColumnRenamed("image", "file_name")
    fits = (F.col("width") == F.col("_w")) & (F.col("height") == F.col("_h"))
    message = F.concat(F.col("file_name"), F.lit(" is not as large as its label says"))
    checked = named.join(decoded, "file_name", "left").filter(F.when(F.coalesce(fits, F.lit(False)), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
    plain = F.transform("b", lambda e: F.struct(e["cls"].alias("cls"), e["x"].alias("x"), e["y"].alias("y"), e["w"].alias("w"), e["h"].alias("h")))
    return checked.select("image", "width", "height", "data", plain.alias("boxes"))


def measured_boxes(spark: SparkSession, prepared: str, results: str, protocol: Protocol) -> DataFrame:
    """image, outcome, ring_pixels, ring_a, ring_b, plate_chroma and group of every target box of the test part."""
    images, gt = prepared_part(spark, prepared, "test")
    targets = gt.filter(F.col("cls") == protocol.target).select("image", "gt_idx")
    matched = M.match(gt, D.read_predictions(spark, f"{results}/predictions_test.csv"))
    pictures = pictures_of_part(spark, prepared, "test", images, gt.join(targets.select("image").distinct(), "image", "left_semi"))
    wanted = protocol.target
    colours = P.measure(pictures, lambda cls: cls == wanted).withColumn("gt_idx", F.col("box").cast("long")).drop("box")
    group = S.outcome_group(F.lit(protocol.target), F.col("outcome"), F.lit(protocol.misread))
    return outcomes_of(targets, matched, protocol.threshold).join(colours, ["image", "gt_idx"]).withColumn("group", group).select("image", "outcome", "ring_pixels", "ring_a", "ring_b", "plate_chroma", "group")


def backdrop(rows: DataFrame, protocol: Protocol) -> dict:
    """Whether misread boxes have a yellower ring, from measured boxes(image, outcome, ring_b, plate_chroma, group)."""
    use_checkpoints(rows.sparkSession)
    spark = rows.sparkSession
    use = rows.select("image", F.col("group").alias("grp"), F.col("ring_b").alias("value"), F.col("plate_chroma").alias("chroma")).checkpoint()
    known = use.filter("value is not null")
    groups = sorted({"misread", "correct", *(r["grp"] for r in use.select("grp").distinct().collect())})
    every = spark.createDataFrame([(g,) for g in groups], "grp string")
    sizes = as_map(every.join(X.group_sizes(use.drop("chroma"), "image"), "grp", "left").na.fill(0), "grp", "boxes", "images", "unmeasurable")
    spread = lambda df: {g: {} for g in groups} | as_map(X.describe(df), "grp", "n", "median", "q1", "q3")
    ring, plate = spread(known.select("grp", "value")), spread(known.select("grp", F.col("chroma").alias("value")).filter("value is not null"))
    auc = X.auc(known, "misread", "correct").first()["auc"]
    ci = X.bootstrap_auc(known, "misread", "correct", "image", protocol.reps, protocol.seed).first()
    within = X.within_groups(known, "misread", "correct", "image").first()
    nan = float("nan")
    low, high = (nan if ci[c] is None else ci[c] for c in ("low", "high"))
    lit = lambda *v: [F.lit(x) for x in v]
    m, c = sizes["misread"], sizes["correct"]
    verdict = spark.range(1).select(R.backdrop(*lit(m["boxes"], c["boxes"], m["images"], c["images"], auc, low, high)).alias("v")).first()["v"]
    return {
        "target": protocol.target, "misread_as": protocol.misread, "confidence_threshold": protocol.threshold, "n_target_boxes": use.count(),
        "measurable_boxes": {g: sizes[g]["boxes"] for g in groups}, "images": {g: sizes[g]["images"] for g in groups}, "unmeasurable_boxes": {g: sizes[g]["unmeasurable"] for g in groups},
        "ring_b": {g: ring[g] or {"n": 0} for g in groups}, "plate_chroma_secondary": {g: plate[g] or {"n": 0} for g in groups},
        "auc_misread_vs_correct": auc, "auc_ci95_cluster_bootstrap": [low, high], "bootstrap_reps": protocol.reps, "bootstrap_seed": protocol.seed, "bootstrap_skipped": ci["skipped"],
        "within_image": {"images_with_both": within["clusters"], "pairs": within["pairs"] or 0, "auc": within["auc"]},
        "verdict": verdict,
    }


# --- the arms over altered pictures


def target_colours(rows: DataFrame) -> dict:
    """Median (a, b) of the rings of each side, from measured boxes."""
    r = X.median_targets(rows.select(F.col("ring_a").alias("a"), F.col("ring_b").alias("b"))).first()
    return {s: [r[f"a_{s}"], r[f"b_{s}"]] for s in ("blue", "yellow")} | {f"n_{s}": r[f"n_{s}"] for s in ("blue", "yellow")}


def recolouring(spark: SparkSession, prepared: str, rows: DataFrame, model: P.Model, protocol: Protocol, model_hash: str = "") -> tuple[dict, DataFrame | None]:
    """The gate on unaltered pictures, and, if it holds, each arm's outcomes on altered ones; the report and the arms' boxes.

    rows are the boxes on record(image, outcome, ring_b, group). Altered pictures are made, read and dropped in a task.
    """
    use_checkpoints(spark)
    images, gt = prepared_part(spark, prepared, "test")
    code = F.when(F.col("group") == "misread", G.MISREAD).when(F.col("group") == "correct", G.CORRECT)
    recorded = rows.select("image", "outcome", "ring_b", code.alias("grp")).filter("grp is not null").checkpoint()
    gt = gt.join(recorded, "image", "left_semi")
    # The first target box of a picture is the one on record.
    targets = gt.filter(F.col("cls") == protocol.target).groupBy("image").agg(F.min("gt_idx").alias("gt_idx"))
    pictures = pictures_of_part(spark, prepared, "test", images, gt)
    plain = P.predict(pictures, model).checkpoint()
    met = outcomes_of(targets, M.match(gt, plain), protocol.threshold)
    gate = G.baseline(recorded, met, "image").checkpoint()
    dropped = [r["image"] for r in gate.filter(~F.col("ok")).select("image").orderBy("image").collect()]
    passed = len(dropped) <= R.MOST_MISMATCHES
    report = {"confidence_threshold": protocol.threshold, "checkpoint_sha256": model_hash, "platform": platform.platform(), "target_colours": {"blue": None, "yellow": None, "n_blue": None, "n_yellow": None}}
    report["baseline_gate"] = {"n_checked": gate.count(), "n_dropped": len(dropped), "dropped_images": dropped, "passed": passed}
    if not passed:  # nothing is altered
        return report | {"arms": {}, "verdict": "no verdict: the baseline is not met again"}, None
    all_targets = gt.filter(F.col("cls") == protocol.target)
    wanted = protocol.target
    report["target_colours"] = colours = target_colours(P.measure(pictures_of_part(spark, prepared, "test", images, gt.join(all_targets, "image", "left_semi")), lambda cls: cls == wanted))
    arms = G.arm_boxes(recorded, gate, "image").checkpoint()
    jobs = arms.groupBy("image").agg(F.sort_array(F.collect_list("arm")).alias("arms")).join(targets, "image")
    altered = pictures.join(jobs.select("image", "arms", F.col("gt_idx").cast("int").alias("target")), "image")
    found = P.predict_arms(altered, {s: tuple(colours[s]) for s in ("blue", "yellow")}, model).checkpoint()
    boxes = arm_outcomes(gt, targets, arms, plain, found, protocol).checkpoint()
    by = {r["arm"]: r for r in X.arms(boxes.withColumnsRenamed({"baseline_target_confidence": "before_conf", "new_target_confidence": "after_conf", "clipped_frac": "clipped"})).collect()}
    empty = {"n": 0, "successes": 0, "share": None, "low": 0.0, "high": 0.0, "median_change": None, "median_clipped": None}
    report["arms"] = {}
    for arm in P.ARMS:
        r = by[arm].asDict() if arm in by else empty
        report["arms"][arm] = {"n": r["n"], "successes": r["successes"], "share": r["share"], "ci95": [r["low"], r["high"]], "median_target_confidence_change": r["median_change"], "clipped_pixels_median": r["median_clipped"]}
    n = {a: report["arms"][a] for a in ("ring", "whole", "sham")}
    rule = R.recolour(F.lit(n["ring"]["n"]), *[F.lit(n[a]["successes"]) for a in ("ring", "whole", "sham")])
    report["verdict"] = spark.range(1).select(rule.alias("v")).first()["v"]
    return report, boxes


def arm_outcomes(gt: DataFrame, targets: DataFrame, arms: DataFrame, plain: DataFrame, found: DataFrame, protocol: Protocol) -> DataFrame:
    """arm, image, new_outcome, success, clipped_frac and the target's confidence before and after, for each arm's box.

    Every altered picture is matched as a picture of its own, named by arm and image.
    """
    name = lambda: F.concat_ws("#", "arm", "image")
    jobs = arms.withColumn("key", name())
    own_gt = jobs.select("image", "key").join(gt, "image").drop("image").withColumnRenamed("key", "image")
    own_targets = jobs.select("image", "key").join(targets, "image").drop("image").withColumnRenamed("key", "image")
    pred = found.filter("pred_idx >= 0").withColumn("image", name())
    outcome = outcomes_of(own_targets, M.match(own_gt, pred), protocol.threshold)
    boxed = own_targets.join(own_gt, ["image", "gt_idx"])
    after = M.best_confidence(boxed, pred, F.lit(protocol.target)).select("image", F.col("conf").alias("new_target_confidence"))
    before = M.best_confidence(targets.join(gt, ["image", "gt_idx"]), plain, F.lit(protocol.target)).select("image", F.col("conf").alias("baseline_target_confidence"))
    clipped = found.filter("pred_idx < 0").select(name().alias("key"), F.col("clipped").alias("clipped_frac"))
    out = jobs.join(outcome.select(F.col("image").alias("key"), F.col("outcome").alias("new_outcome")), "key").join(clipped, "key").join(after.withColumnRenamed("image", "key"), "key").join(before, "image")
    success = G.success(F.col("arm"), F.col("new_outcome"), protocol.target, protocol.misread)
    return out.select("arm", "image", "new_outcome", success.alias("success"), "clipped_frac", "baseline_target_confidence", "new_target_confidence")


# --- two further runs against each other

#: Fixed values of the comparison: the arms' folders, the files that each must have, and what only the treatment adds.
RUN_FOLDERS = {"2C": "run2c", "2A": "run2a"}
RUN_FILES = ["predictions_val.csv", "predictions_test.csv", "metrics.csv", "training_config.json", "run_record.json"]
RECORD_FIELDS = ["commit", "rfdetr", "albumentations", "split_sizes", "gpu", "pred_threshold"]
FLIP = {"HorizontalFlip.p": "0.5"}
CAST = {"PlanckianJitter.mode": "cied", "PlanckianJitter.temperature_limit": "[4000,15000]", "PlanckianJitter.sampling_method": "uniform", "PlanckianJitter.p": "0.5"}
COMMON = {"augmentation_backend": "albumentations", "seed": "20261001"}
CONSEQUENCE = {
    "void": "The first run stays: its failure did not come back in a retrain, so part of it is noise between runs.",
    "fixed": "The treatment's weights take the first run's place.",
    "fixed at a cost": "The first run stays; the result is mixed.",
    "displaced": "The first run stays: boxes are now missed instead of misread.",
    "not fixed": "The first run stays; the result is negative.",
    "invalid": "No verdict: a run failed its checks, or the runs cannot be compared.",
}


def treatment_fields(run: str) -> dict[str, str]:
    """Paths and values of the fields in which a run has its own values."""
    changes = FLIP | (CAST if run == "2A" else {})
    return {f"train_config.aug_config.{k}": v for k, v in changes.items()} | {f"train_config.{k}": v for k, v in COMMON.items()}


def absent_files(spark: SparkSession, results: str) -> list[str]:
    files = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    names = [f"{folder}/{f}" for folder in RUN_FOLDERS.values() for f in RUN_FILES]
    return [n for n in names if not (p := files.Path(f"{results}/{n}")).getFileSystem(conf).exists(p)]


def invalid_reasons(spark: SparkSession, results: str) -> list[str]:
    """Why the runs do not count: other configurations than allowed, wrong records, records that do not agree."""
    configs = lambda name, runs: [D.read_json(spark, f"{results}/{folder + '/' if folder else ''}{name}", run) for run, folder in runs.items()]
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    first = R.flatten(union(configs("training_config.json", {"first": ""}))).withColumn("run", F.explode(F.array(*map(F.lit, RUN_FOLDERS))))
    flat = R.flatten(union(configs("training_config.json", RUN_FOLDERS))).checkpoint()
    wanted = spark.createDataFrame([(r, p, v) for r in RUN_FOLDERS for p, v in treatment_fields(r).items()], "run string, path string, value string")
    show = lambda v: "<absent>" if v is None else v
    out = [f"{r['run']}: {r['path']}: run 1 {show(r['one'])}, saved {show(r['other'])}" for r in G.config_problems(first, flat, ["run"]).orderBy("run", "path").collect()]
    out += [f"{r['run']}: {r['path']}: needs {r['wanted']}, saved {show(r['value'])}" for r in G.treatment_problems(flat, wanted, ["run"]).orderBy("run", "path").collect()]
    extra = flat.filter(F.col("path").startswith("train_config.aug_config.")).join(wanted, ["run", "path"], "left_anti")
    out += [f"{r['run']}: {r['path']}: not of this run, saved {r['value']}" for r in extra.orderBy("run", "path").collect()]
    raw = union(configs("run_record.json", RUN_FOLDERS))
    part = lambda name: F.get_json_object("config", f"$.{name}")
    records = raw.select(F.col("run").alias("expected"), part("run").alias("run"), (part("config_check.ok") == "true").alias("check_ok"), *[part(f).alias(f) for f in RECORD_FIELDS]).checkpoint()
    said = {"run": "the record is of another run", "config_check": "its own config check did not pass"}
    out += [f"{r['expected']}: {said[r['problem']]}" for r in G.record_problems(records, "expected").orderBy("expected", "problem").collect()]
    of = lambda run: records.filter(F.col("expected") == run).withColumn("k", F.lit(1))
    out += [f"{r['field']} differs: 2C {show(r['one'])}, 2A {show(r['other'])}" for r in G.record_differences(of("2C"), of("2A"), ["k"], RECORD_FIELDS).orderBy("field").collect()]
    return out


def run_metrics(spark: SparkSession, path: str) -> dict:
    metrics = D.read_metrics(spark, path)
    test = metrics.filter(F.col("`test/mAP_50_95`").isNotNull()).first()
    lacking = F.lit(None).cast("double")
    column = lambda c: F.col(f"`{c}`").cast("double") if c in metrics.columns else lacking
    best = X.best_epoch(metrics.select(F.col("epoch").cast("double").cast("long").alias("epoch"), column("val/mAP_50_95").alias("val"), column("val/ema_mAP_50_95").alias("ema"))).first()
    if best["score"] is None:
        raise G.Refused(f"{path} has no validation scores")
    one = lambda c: float(test[c])
    return {"test_map_50_95": one("test/mAP_50_95"), "test_map_50": one("test/mAP_50"), "val_map_50_95": best["score"], "val_best_epoch": best["epoch"], "val_to_test_gap_map_50_95": best["score"] - one("test/mAP_50_95"), "test_ap": as_map(D.class_scores(metrics), "cls", "ap")}


def scored_run(spark: SparkSession, folder: str, parts: dict, rings: DataFrame, classes: DataFrame, protocol: Protocol) -> tuple[dict, DataFrame]:
    """A run's numbers, and what became of each target box. Refuses another number of target boxes, and boxes without a ring."""
    matched = {s: M.match(parts[s][1], D.read_predictions(spark, f"{folder}/predictions_{s}.csv")).checkpoint() for s in parts}
    best = M.best_threshold(M.sweep(*parts["val"], matched["val"])).first()
    images, gt = parts["test"]
    targets = gt.filter(F.col("cls") == protocol.target).select("image", "gt_idx")
    fates = outcomes_of(targets, matched["test"], best["threshold"])
    fates = fates.withColumn("outcome", F.when(F.col("outcome").isin(protocol.kinds), F.col("outcome")).otherwise("other")).checkpoint()
    G.refuse(G.uncovered(fates, rings, "image"), "no ring value for")
    side = S.side(F.col("value"))
    kinds = [*protocol.kinds, "other"]
    total = lambda df: {k: n for k, n in ((k, {r["outcome"]: r["n"] for r in df}.get(k, 0)) for k in kinds)}
    by_side = fates.join(rings.select("image", "value"), "image").groupBy(side.alias("side"), "outcome").agg(F.count("*").alias("n")).collect()
    table = M.outcomes(images, gt, matched["test"], best["threshold"]).checkpoint()
    precision = as_map(M.per_class(table, classes), "cls", "precision")
    report = {
        "threshold": best["threshold"], "val_micro_f1": best["f1"], "counts": total(fates.groupBy("outcome").agg(F.count("*").alias("n")).collect()),
        "by_side": {s: total([r for r in by_side if r["side"] == s]) for s in ("yellow", "blue")},
        f"precision_{protocol.misread}": precision.get(protocol.misread), "confusion": nested_confusion(table), "metrics": run_metrics(spark, f"{folder}/metrics.csv"),
    }
    return report, fates


def compared_runs(spark: SparkSession, prepared: str, results: str, protocol: Protocol) -> dict:
    """Two further runs judged against each other. Inputs are opened in order, each only when what precedes it holds:

    the files of both runs must be there; their configurations and records are read; the labels must have the fixed
    number of target boxes, one an image; every target box must have a ring value; the first run's outcomes must be
    those on record; only then are the two runs' predictions opened.
    """
    use_checkpoints(spark)
    absent = absent_files(spark, results)
    if absent:
        raise G.Refused(f"both runs must be complete before either is evaluated; missing: {', '.join(absent)}")
    invalid = invalid_reasons(spark, results)
    classes = frame_of(spark, class_names(D.categories_of(spark, prepared, ["valid", "test"])))
    parts = {s: prepared_part(spark, prepared, s) for s in ("val", "test")}
    refusals = {"several": "images have several target boxes", "number": f"target boxes, and {protocol.boxes} are fixed"}
    wrong = G.target_refusals(parts["test"][1], protocol.target, protocol.boxes).collect()
    if wrong:
        raise G.Refused("; ".join(f"{r['n']} {refusals[r['reason']]}" for r in wrong))
    recorded = spark.read.csv(f"{results}/backdrop_boxes.csv", header=True, nullValue="").select("image", "outcome", F.col("ring_b").cast("double").alias("value")).checkpoint()
    first, fates = scored_run(spark, results, parts, recorded, classes, protocol)
    G.refuse(G.not_reproduced(recorded, fates, protocol.kinds), "run 1 does not come out as on record (outcome, recorded, scored)")
    runs, boxes = {"run1": first}, {}
    for run, folder in RUN_FOLDERS.items():
        runs[run], boxes[run] = scored_run(spark, f"{results}/{folder}", parts, recorded, classes, protocol)
    paired = X.paired(boxes["2C"], boxes["2A"], F.col("outcome") == protocol.misread).first()
    scores = {run: {"map": m["test_map_50_95"], "val": m["val_map_50_95"], **m["test_ap"]} for run in RUN_FOLDERS for m in [runs[run]["metrics"]]}
    table = lambda run: spark.createDataFrame([(k, float(v)) for k, v in scores[run].items()], "name string, score double")
    kept = {r["name"]: r for r in R.guardrails(table("2C"), table("2A"), [protocol.target, protocol.misread]).collect()}
    overall = lambda k: {"2C": kept[k]["before"], "2A": kept[k]["after"], "margin": R.MAP_MARGIN, "ok": kept[k]["ok"]}
    by_class = {k: {"2C": r["before"], "2A": r["after"], "drop": r["before"] - r["after"], "ok": r["ok"]} for k, r in sorted(kept.items()) if k not in ("map", "val")}
    guard = {"G1": overall("map"), "G2": overall("val"), "G3": {"margin": R.CLASS_MARGIN, "classes": by_class, "ok": all(v["ok"] for v in by_class.values())}}
    guard["all_ok"] = all(guard[g]["ok"] for g in ("G1", "G2", "G3"))
    c, a = (runs[r]["counts"] for r in ("2C", "2A"))
    m_c, k_c, m_a, k_a, p = c[protocol.misread], c[protocol.target], a[protocol.misread], a[protocol.target], paired["p"]
    state = spark.range(1).select(R.run_decision(*[F.lit(v) for v in (m_c, k_c, m_a, k_a, p, guard["all_ok"], not invalid)]).alias("v")).first()["v"]
    criteria = {"void": m_c <= R.VOID_AT_MOST, "a_halved": m_a <= m_c // 2, "b_significant": p < R.ALPHA, "c_correct_not_missed": 2 * (k_a - k_c) >= m_c - m_a, "d_guardrails": guard["all_ok"]}
    return {
        "verdict": state, "consequence": CONSEQUENCE[state], "invalid_reasons": invalid,
        "primary": {"M_2C": m_c, "K_2C": k_c, "M_2A": m_a, "K_2A": k_a, "mcnemar_b_misread_by_2C_only": paired["b"], "mcnemar_c_misread_by_2A_only": paired["c"], "p_one_sided": p, "criteria": criteria},
        "guardrails": guard, "runs": runs,
    }


def file_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()
