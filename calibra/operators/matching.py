"""One-to-one matching of predictions with true boxes, and the tables that come of it.

An image's boxes are few, so they travel as two arrays and are folded by a higher-order function: a shuffle by image,
no Python. Predictions are visited by falling confidence, and a cut at a threshold takes away a suffix, so one matching
without a cut serves every threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.functions.geometry import box, iou, iou_of
from calibra.functions.scalars import ratio, wilson
from calibra.operators.ranges import running

MISSED, BACKGROUND = "missed", "background"
MIN_IOU = 0.5


def _edges(b: Column, *more: Column) -> Column:
    """A box by its edges and its area, in one struct without another within."""
    return F.struct(b["x"].alias("x0"), b["y"].alias("y0"), (b["x"] + b["w"]).alias("x1"), (b["y"] + b["h"]).alias("y1"), (b["w"] * b["h"]).alias("area"), *more)


def _inner(a: Column, b: Column) -> Column:
    """geometry.overlap() of two boxes by their edges."""
    side = lambda low, high: F.greatest(F.lit(0.0), F.least(a[high], b[high]) - F.greatest(a[low], b[low]))
    return side("x0", "x1") * side("y0", "y1")


def _overlapping(gts: Column, p: Column) -> Column:
    """iou and idx of the boxes that a prediction may take, all by their edges. Most boxes have no overlap."""
    met = F.transform(F.filter(gts, lambda g: _inner(g, p) > 0), lambda g: F.struct(iou_of(_inner(g, p), g["area"] + p["area"]).alias("iou"), g["idx"].alias("idx")))
    return F.filter(met, lambda m: m["iou"] >= MIN_IOU)


def _candidates(preds: Column, gts: Column) -> Column:
    """_overlapping() of each of preds; edges are taken once for each box."""
    edges = F.transform(gts, lambda g: _edges(g["box"], g["idx"].alias("idx")))
    found = F.transform(F.array(edges), lambda gs: F.transform(F.transform(preds, lambda p: _edges(p["box"])), lambda p: _overlapping(gs, p)))
    return F.get(found, F.lit(0))


def fold(preds: Column, gts: Column) -> Column:
    """For each of preds(box), in the given order, the idx of the one of gts(idx, box) that it takes, or null."""

    def step(acc: Column, some: Column) -> Column:
        # Of equal overlaps the highest index wins.
        best = F.array_max(F.filter(some, lambda m: ~F.array_contains(acc["used"], m["idx"])))
        after = F.get(
            F.transform(
                F.array(best),
                lambda b: F.struct(
                    F.when(b.isNull(), acc["used"]).otherwise(F.concat(acc["used"], F.array(b["idx"]))).alias("used"),
                    F.concat(acc["out"], F.array(b["idx"])).alias("out"),
                ),
            ),
            F.lit(0),
        )
        # Most predictions may take none.
        none = F.struct(acc["used"].alias("used"), F.concat(acc["out"], F.array(F.lit(None).cast("bigint"))).alias("out"))
        return F.when(F.size(some) == 0, none).otherwise(after)

    empty = F.array().cast("array<bigint>")
    return F.aggregate(_candidates(preds, gts), F.struct(empty.alias("used"), empty.alias("out")), step, lambda acc: acc["out"])


def match(gt: DataFrame, pred: DataFrame, by_class: bool = False) -> DataFrame:
    """Every prediction with the true box it takes: image, pred_idx, cls, conf, gt_idx, true_cls (null if none).

    gt has image, gt_idx, cls and a box; pred has image, pred_idx, cls, conf and a box. By falling confidence, then
    pred_idx, a prediction takes the free box of its image with the greatest overlap of at least MIN_IOU. With by_class
    only boxes of its own class count.
    """
    keys = ["image", "cls"] if by_class else ["image"]
    g = gt.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("gt_idx").cast("long").alias("idx"), F.col("cls").alias("c"), box().alias("box")))).alias("gts"))
    p = pred.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("conf")).alias("rank"), F.col("pred_idx"), F.col("cls").alias("c"), F.col("conf"), box().alias("box")))).alias("preds"))
    both = p.join(g, keys, "left").withColumn("gts", F.coalesce("gts", F.expr("array()").cast(g.schema["gts"].dataType)))
    both = both.withColumn("taken", fold(F.col("preds"), F.col("gts")))
    rows = both.select("image", "gts", F.explode(F.arrays_zip("preds", "taken")).alias("r"))
    true = F.get(F.filter("gts", lambda g: g["idx"] == F.col("r.taken")), F.lit(0))["c"]
    return rows.select("image", F.col("r.preds.pred_idx").alias("pred_idx"), F.col("r.preds.c").alias("cls"), F.col("r.preds.conf").alias("conf"), F.col("r.taken").alias("gt_idx"), true.alias("true_cls"))


def outcomes(images: DataFrame, gt: DataFrame, matched: DataFrame, threshold: float) -> DataFrame:
    """Counts of (truth, pred) over images: matched pairs, missed boxes, and predictions on the background."""
    kept = matched.filter(F.col("conf") >= threshold).join(images.select("image"), "image", "left_semi")
    seen = kept.select(F.coalesce("true_cls", F.lit(BACKGROUND)).alias("truth"), F.col("cls").alias("pred"))
    open_ = gt.join(images.select("image"), "image", "left_semi").join(kept.select("image", "gt_idx").filter("gt_idx is not null"), ["image", "gt_idx"], "left_anti")
    return seen.unionByName(open_.select(F.col("cls").alias("truth"), F.lit(MISSED).alias("pred"))).groupBy("truth", "pred").agg(F.count("*").alias("n"))


def sweep(images: DataFrame, gt: DataFrame, matched: DataFrame) -> DataFrame:
    """Micro F1 at 0.05 to 0.95 by hundredths, from one matching: threshold, correct, predicted, actual, f1.

    Predictions are counted by confidence first; the thresholds meet at most one row for each distinct confidence.
    """
    ids = images.select("image")
    actual = gt.join(ids, "image", "left_semi").agg(F.count("*").alias("actual"))
    counts = matched.join(ids, "image", "left_semi").groupBy("conf").agg(F.count("*").alias("predicted"), F.count_if(F.col("cls") == F.col("true_cls")).alias("correct"))
    grid = actual.select("actual", F.explode(F.transform(F.sequence(F.lit(5), F.lit(95)), lambda i: i / F.lit(100.0))).alias("threshold"))
    at = F.floor(F.col("conf") * 100 + 1e-9)
    at = F.when(F.col("conf") >= (at + 1) / 100, at + 1).when(F.col("conf") < at / 100, at - 1).otherwise(at)
    binned = counts.groupBy(F.least(F.lit(95), at).alias("bin")).agg(F.sum("predicted").alias("predicted"), F.sum("correct").alias("correct"))
    steps = grid.withColumn("bin", F.round(F.col("threshold") * 100).cast("long"))
    all_bins = steps.join(binned, "bin", "left")
    upto = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0)).cast("long").alias(c)
    out = all_bins.select("threshold", "actual", total("predicted"), total("correct"))
    return out.select("threshold", "correct", "predicted", "actual", ratio(2 * F.col("correct"), F.col("predicted") + F.col("actual")).alias("f1"))


def best_threshold(swept: DataFrame) -> DataFrame:
    """The threshold of the greatest F1, the lowest of equals."""
    return swept.agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("threshold"), F.max("f1").alias("f1"))


def micro_f1(table: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    correct, predicted, actual = total(F.col("truth") == F.col("pred")), total(F.col("pred") != MISSED), total(F.col("truth") != BACKGROUND)
    return table.agg(ratio(2 * correct, predicted + actual).alias("f1"))


def per_class(table: DataFrame, classes: DataFrame) -> DataFrame:
    """Precision and recall of every class of classes(cls), 0 where nothing counts."""
    true = table.groupBy(F.col("truth").alias("cls")).agg(F.sum("n").alias("n_gt"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("hits"))
    pred = table.groupBy(F.col("pred").alias("cls")).agg(F.sum("n").alias("n_pred"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    rows = classes.select("cls").join(true, "cls", "left").join(pred, "cls", "left").select("cls", zero("n_gt").alias("n_gt"), zero("n_pred").alias("n_pred"), zero("hits").alias("correct"))
    return rows.withColumns({"precision": ratio(F.col("correct"), F.col("n_pred")), "recall": ratio(F.col("correct"), F.col("n_gt"))})


def errors(table: DataFrame, partners: DataFrame) -> DataFrame:
    """For each class of partners(cls, partner): correct, partner, other, missed, the partner's share and its interval."""
    rows = partners.join(table, partners["cls"] == table["truth"], "left")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    out = rows.groupBy("cls", "partner").agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"),
        count(F.col("pred") == F.col("cls")).alias("correct"),
        count(F.col("pred") == F.col("partner")).alias("confused"),
        count(F.col("pred") == MISSED).alias("missed"),
    )
    out = out.withColumn("other", F.col("n") - F.col("correct") - F.col("confused") - F.col("missed"))
    out = out.withColumn("w", wilson(F.col("confused"), F.col("n")))
    return out.select("cls", "partner", "n", "correct", "confused", "other", "missed", ratio(F.col("confused"), F.col("n")).alias("share"), F.col("w.low").alias("low"), F.col("w.high").alias("high"))


def confusion(table: DataFrame) -> DataFrame:
    """Each true class with a map of what was predicted."""
    return table.groupBy("truth").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("pred", "n")))).alias("pred"))


def average_precision(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """AP at MIN_IOU over 101 recalls of each class with true boxes: cls, n_gt, ap. Ranks run over ranges, not whole classes.

    Predictions of images without boxes count as false. Equal confidences keep the order of image and pred_idx. The
    sample at a recall is the greatest precision at that recall or beyond. Precisions are first cut to the greatest of
    each hundredth of recall, 102 rows a class, before the samples are taken.
    """
    n_gt = gt.groupBy("cls").agg(F.count("*").alias("n_gt"))
    matched = match(gt, pred, by_class=True).select("cls", "conf", "image", "pred_idx", "gt_idx")
    ranked = running(matched, ["cls"], [F.desc("conf"), F.col("image"), F.col("pred_idx")], {"k": F.lit(1), "tp": F.col("gt_idx").isNotNull().cast("int")})
    ranked = ranked.join(n_gt, "cls").select("cls", (F.col("tp") / F.col("n_gt")).alias("recall"), (F.col("tp") / F.col("k")).alias("precision"))
    # The last sample that a point reaches: recall >= i / 100.
    at = F.floor(F.col("recall") * 100 + 1e-9)
    at = F.when(F.col("recall") < at / 100, at - 1).otherwise(at)
    points = ranked.groupBy("cls", at.alias("i")).agg(F.max("precision").alias("best"))
    grid = n_gt.select("cls", "n_gt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(100).cast("long"))).alias("i"))
    beyond = Window.partitionBy("cls").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    sampled = grid.join(points, ["cls", "i"], "left").withColumn("p", F.coalesce(F.max("best").over(beyond), F.lit(0.0)))
    return sampled.groupBy("cls", "n_gt").agg((F.sum("p") / 101).alias("ap"))


def mean_average_precision(ap: DataFrame) -> DataFrame:
    return ap.agg(F.avg("ap").alias("map"))


def visible(pred: DataFrame, threshold: float) -> DataFrame:
    """Predictions that a viewer shows, each image's in order: rank and rounded corners."""
    from calibra.functions.geometry import corners

    order = Window.partitionBy("image").orderBy(F.desc("conf"), "pred_idx")
    rows = pred.filter(F.col("conf") >= threshold).withColumns({"rank": F.row_number().over(order).cast("long"), "c": corners(box())})
    return rows.select("image", "rank", "cls", F.bround("conf", 3).alias("conf"), "c.x0", "c.y0", "c.x1", "c.y1")


def summary(pred: DataFrame, threshold: float, classes: DataFrame) -> DataFrame:
    """An image's visible detections as text, in the order of classes(cls, ord)."""
    counts = pred.filter(F.col("conf") >= threshold).groupBy("image", "cls").agg(F.count("*").alias("n")).join(classes, "cls")
    parts = F.sort_array(F.collect_list(F.struct("ord", F.concat(F.col("n").cast("string"), F.lit(" x "), F.col("cls")).alias("t"))))
    return counts.groupBy("image").agg(parts.alias("p")).select("image", F.array_join(F.transform("p", lambda x: x["t"]), ", ").alias("summary"))


def best_confidence(targets: DataFrame, pred: DataFrame, target_class: Column) -> DataFrame:
    """The greatest confidence of a class on each target box with enough overlap, at any threshold; 0 without one."""
    p = pred.select("image", F.col("cls").alias("p_cls"), "conf", box().alias("p_box"))
    rows = targets.withColumn("t_box", box()).join(p, "image", "left")
    good = (F.col("p_cls") == target_class) & (iou(F.col("t_box"), F.col("p_box")) >= MIN_IOU)
    return rows.groupBy("image", "gt_idx").agg(F.coalesce(F.max(F.when(good, F.col("conf"))), F.lit(0.0)).alias("conf"))


def label_conflicts(gt: DataFrame, limit: float = 0.9) -> DataFrame:
    """Images with two boxes of different classes that all but coincide: image, pairs."""
    from calibra.functions.geometry import iou_for_conflicts

    boxes = gt.groupBy("image").agg(F.collect_list(F.struct(F.col("gt_idx"), F.col("cls").alias("c"), box().alias("box"))).alias("b"))
    pairs = F.aggregate("b", F.lit(0), lambda n, a: n + F.size(F.filter("b", lambda o: (a["gt_idx"] < o["gt_idx"]) & (a["c"] != o["c"]) & (iou_for_conflicts(a["box"], o["box"]) > limit))))
    return boxes.select("image", pairs.cast("long").alias("pairs")).filter("pairs > 0")
