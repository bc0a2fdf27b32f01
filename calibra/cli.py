"""Command line: one command for each analysis of an image set, over files in the forms of calibra.sources."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.functions import scalars as S
from calibra.operators import matching as M
from calibra.operators import near_dup as N
from calibra.operators import sessions as T
from calibra.operators.gates import Refused
from calibra.operators.phash import perceptual_hash
from calibra.plans import reports, studies
from calibra.sources import datasets as D

#: Bits within which pictures are one capture, and within which they are twins in an audit.
SESSION_BITS, TWIN_BITS = 30, 20


def manifest_rows(spark: SparkSession, export: str) -> DataFrame:
    """Every image of an export with its moment, box counts, reason for exclusion and both hashes."""
    images, boxes = D.read_coco(spark, export)
    counts = boxes.groupBy("image").agg(F.collect_list("cls").alias("c"))
    rows = images.join(counts, "image", "left").join(M.label_conflicts(boxes), "image", "left").withColumn("at", S.captured_at(F.col("image")))
    n = F.coalesce(F.size("c"), F.lit(0))
    rows = rows.select(
        F.col("image").alias("file"), F.col("split").alias("published_split"), "file_name", "width", "height", "at", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss").alias("captured_at"),
        F.when(n > 0, S.format_counts(S.box_counts(F.col("c")))).otherwise("").alias("boxes"), S.exclusion(F.col("image"), F.col("at"), F.greatest(n, F.lit(0)), F.col("pairs") > 0).alias("exclusion"),
        F.array_distinct(F.coalesce("c", F.array().cast("array<string>"))).alias("classes"), "ord",
    )
    place = [F.col("folder").alias("published_split"), F.col("file").alias("file_name")]
    pictures = [D.read_pictures(spark, f"{export}/{s}").withColumn("image", F.concat_ws("/", "folder", "image")) for s in D.SPLITS]
    seen = perceptual_hash(pictures[0].unionByName(pictures[1]).unionByName(pictures[2])).select(F.split_part("image", F.lit("/"), F.lit(1)).alias("published_split"), F.split_part("image", F.lit("/"), F.lit(2)).alias("file_name"), F.col("phash").alias("phash256"))
    stored = D.file_hashes(spark, [f"{export}/{s}" for s in D.SPLITS]).select(*place, "sha256")
    keys = ["published_split", "file_name"]
    lost = F.when(F.col("sha256").isNull(), F.raise_error(F.concat(F.lit("no picture "), F.col("file_name"))).cast("boolean")).otherwise(F.lit(True))
    return rows.join(stored, keys, "left").filter(lost).join(seen, keys, "left")


def sessions_of(rows: DataFrame, bits: int) -> DataFrame:
    """id, ts, session of rows(id, ts, phash256): captures a few minutes apart, joined where pictures are near."""
    members = N.classes(rows.select("id", S.hex_words(F.col("phash256")).alias("words")).filter("words[0] is not null"))
    return T.merge_sessions(T.sessionize(rows.select("id", "ts")), N.hamming_links(members, 256, bits))


def manifest(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Writes every image of an export with hashes, session and split: whole days to test, whole sessions to validation."""
    T.use_checkpoints(spark)
    names = studies.class_names(D.categories_of(spark, args.export))
    rows = manifest_rows(spark, args.export).checkpoint()
    kept = rows.filter("exclusion = ''").select(F.col("file").alias("id"), F.col("at").alias("ts"), F.date_format("at", "yyyy-MM-dd").alias("day"), "classes", "phash256")
    sessions = sessions_of(kept, SESSION_BITS).select("id", "session").checkpoint()
    dates = T.test_dates(kept, names, test_least=args.test_least, rest_least=args.rest_least).checkpoint()
    pool = kept.join(dates.select(F.explode("dates").alias("day")), "day", "left_anti").join(sessions, "id")
    val = T.val_sessions(pool, names, kept.count())
    days = rows.withColumn("day", F.date_format("at", "yyyy-MM-dd")).join(sessions.withColumnRenamed("id", "file"), "file", "left")
    out = T.assign(days, dates, val).withColumn("session", F.col("session").cast("int")).checkpoint()
    D.write_csv(out.orderBy("ord").select(*[f.split()[0] for f in D.MANIFEST.split(", ")]), args.out)
    return out.groupBy("split", "exclusion").agg(F.count("*").alias("images")).orderBy("split", "exclusion")


def summary(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Images and boxes of each class by split, from a manifest."""
    rows = D.read_manifest(spark, args.manifest).select("split", F.explode(S.parse_counts(F.col("boxes"))).alias("cls", "n"))
    return rows.groupBy("cls", "split").agg(F.count("*").alias("images"), F.sum("n").alias("boxes")).orderBy("cls", "split")


def leak_audit(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """What the published split leaks, from a manifest's perceptual hashes; also written as JSON."""
    rows = D.read_manifest(spark, args.manifest).select(F.col("file").alias("id"), S.hex_words(F.col("phash256")).alias("words"), F.col("published_split").alias("split"))
    members = N.classes(rows.select("id", "words"))
    found = N.leakage(members, N.hamming_pairs(members, 256, args.bits), rows.select("id", "split"))
    names = {"items": "images", "tied": "with_tied_nearest_twins", "nearest_other": "nearest_twin_other_split", "nearest_other_min": "nearest_twin_other_split_min", "nearest_other_max": "nearest_twin_other_split_max", "any_other": "any_twin_other_split"}
    counts = found.withColumnsRenamed(names).first().asDict()
    if args.out:
        D.write_text(spark, args.out, reports.as_json({"max_bits": args.bits, **counts}))
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{c} long" for c in counts))


def sessions(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Capture sessions of a manifest's kept images, merged where near-duplicates link them."""
    rows = D.read_manifest(spark, args.manifest).filter("exclusion is null or exclusion = ''")
    return sessions_of(rows.select(F.col("file").alias("id"), F.to_timestamp("captured_at").alias("ts"), "phash256"), args.bits).orderBy("ts")


def prepare(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Writes the kept images and their labels by split. An image that the manifest lacks is an error, and one that is lost."""
    categories = D.categories_of(spark, args.export)
    images, boxes = D.read_coco(spark, args.export)
    known = D.read_manifest(spark, args.manifest).select(F.col("file").alias("image"), F.col("split").alias("to"))
    lost = D.missing_from(images, known, "image").count()
    if lost:
        raise KeyError(f"{lost} images of the export are not in the manifest")
    if known.filter("to is not null").isEmpty():
        raise ValueError("the manifest gives no image a split")
    kept = images.join(known.filter(F.col("to").isin(*D.PARTS)), "image").withColumnsRenamed({"split": "published", "to": "split"})
    D.write_coco(kept, boxes.drop("split").join(kept.select("image", "split"), "image"), categories, args.out)
    D.copy_pictures(kept, args.export, args.out)
    return kept.groupBy("split").agg(F.count("*").alias("images")).orderBy("split")


def protocol_of(args: argparse.Namespace) -> studies.Protocol:
    """The written protocol, with what the command line says otherwise."""
    said = {k: v for k, v in vars(args).items() if k in studies.Protocol.__dataclass_fields__ and v is not None}
    for k in ("suspects", "controls"):
        if k in said:
            said[k] = tuple(said[k].split(","))
    if "partners" in said:
        pairs = [p.split(":") for p in said["partners"].split(",")]
        said["partners"] = {a: b for x, y in pairs for a, b in ((x, y), (y, x))}
    return studies.Protocol(**said)


def evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    """Scores on validation and test at the threshold that validation chooses, errors by class, and the verdict."""
    result = studies.evaluation(spark, args.prepared, args.results, protocol_of(args))
    reports.deliver(spark, result, reports.evaluation(result), f"{args.results}/evaluation")


BOX_COLUMNS = ["image", "outcome", "ring_pixels", "ring_b", "plate_chroma", "group"]


def measured(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, nullValue="")
    return rows.select("image", "outcome", F.col("ring_b").cast("double").alias("ring_b"), F.col("plate_chroma").cast("double").alias("plate_chroma"), "group")


def backdrop(spark: SparkSession, args: argparse.Namespace) -> None:
    """Ring colours of misread and correct test boxes, AUC, interval and verdict: from pictures, or from a table of measured boxes."""
    if args.boxes_file:
        rows = measured(spark, args.boxes_file)
    else:
        T.use_checkpoints(spark)
        rows = studies.measured_boxes(spark, args.prepared, args.results, protocol_of(args)).checkpoint()
        D.write_csv(rows.select(*BOX_COLUMNS).coalesce(1).sortWithinPartitions("image"), f"{args.results}/backdrop_boxes.csv")
    result = studies.backdrop(rows, protocol_of(args))
    reports.deliver(spark, result, reports.backdrop(result), f"{args.results}/backdrop")


def recolour(spark: SparkSession, args: argparse.Namespace) -> None:
    """The baseline met again on unaltered pictures, then five arms on altered ones. --model names module:function, from pixels to detections."""
    module, _, name = args.model.partition(":")
    model = getattr(importlib.import_module(module), name)
    digest = studies.file_sha256(args.checkpoint) if args.checkpoint else ""
    result, boxes = studies.recolouring(spark, args.prepared, measured(spark, f"{args.results}/backdrop_boxes.csv"), model, protocol_of(args), digest)
    if boxes is not None:
        D.write_csv(boxes.coalesce(1).sortWithinPartitions("arm", "image"), f"{args.results}/recolour_boxes.csv")
    reports.deliver(spark, result, reports.recolouring(result), f"{args.results}/recolour")


def run2_eval(spark: SparkSession, args: argparse.Namespace) -> None:
    """Two further runs, the control and the treatment, judged by the written rule; refuses what does not allow a verdict."""
    result = studies.compared_runs(spark, args.prepared, args.results, protocol_of(args))
    reports.deliver(spark, result, reports.compared_runs(result), f"{args.results}/run2_evaluation")


COMMANDS = {
    "manifest": (manifest, ["--export", "--out"]), "prepare": (prepare, ["--export", "--manifest", "--out"]), "summary": (summary, ["--manifest"]),
    "leak-audit": (leak_audit, ["--manifest"]), "sessions": (sessions, ["--manifest"]), "evaluate": (evaluate, ["--prepared", "--results"]),
    "backdrop": (backdrop, ["--results"]), "recolour": (recolour, ["--prepared", "--results", "--model"]), "run2-eval": (run2_eval, ["--prepared", "--results"]),
}
STUDIES = ("evaluate", "backdrop", "recolour", "run2-eval")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="calibra", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    for name, (f, options) in COMMANDS.items():
        p = commands.add_parser(name, help=f.__doc__)
        for o in options:
            p.add_argument(o, required=True)
        if name in ("sessions", "leak-audit"):
            p.add_argument("--bits", type=int, default=SESSION_BITS if name == "sessions" else TWIN_BITS, help="bits within which two hashes are near")
        if name == "leak-audit":
            p.add_argument("--out", help="a JSON file for the counts")
        if name == "manifest":
            p.add_argument("--test-least", type=int, default=T.TEST_LEAST, help="images of each class that the test days must have")
            p.add_argument("--rest-least", type=int, default=T.REST_LEAST, help="and the other days")
        if name == "backdrop":
            p.add_argument("--prepared", help="a prepared set with pictures")
            p.add_argument("--boxes-file", help="a table of measured boxes, in place of pictures")
        if name == "recolour":
            p.add_argument("--checkpoint", help="the model's file, whose hash the report names")
        if name in STUDIES:
            for key in ("target", "misread", "suspects", "controls", "partners"):
                p.add_argument(f"--{key}")
            p.add_argument("--boxes", type=int, help="number of target boxes that the protocol fixes")
            p.add_argument("--threshold", type=float)
            p.add_argument("--reps", type=int)
            p.add_argument("--seed", type=int)
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"calibra {args.command}").getOrCreate()
    try:
        found = COMMANDS[args.command][0](spark, args)
    except Refused as e:
        print(f"refused: {e}")
        return 2
    if found is not None:
        print(reports.frame_table(found))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
