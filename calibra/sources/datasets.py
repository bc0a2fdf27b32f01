"""Readers and writers of labelled image sets, predictions, manifests, metrics and reports."""

from __future__ import annotations

import csv
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibra.operators.ranges import numbered
from calibra.sources.entries import joined_file, read_entries

SPLITS = ["train", "valid", "test"]
#: An entry of each array of a label file.
CATEGORY = "id bigint, name string, supercategory string"
IMAGE = "id bigint, file_name string, width int, height int, extra struct<name: string>"
ANNOTATION = "id bigint, image_id bigint, category_id bigint, bbox array<double>"
PREDICTIONS = "file string, class_name string, confidence double, x double, y double, w double, h double"
MANIFEST = "file string, published_split string, width int, height int, captured_at string, boxes string, sha256 string, phash256 string, exclusion string, session int, split string"
LABELS = "_annotations.coco.json"


def _labels(spark: SparkSession, folder: str, splits: list[str], name: str, schema: str) -> DataFrame:
    """split, pos and the fields of each entry of an array of the splits' label files."""
    rows = read_entries(spark, [(x, f"{folder}/{x}/{LABELS}") for x in splits], name)
    return rows.select(F.col("key").alias("split"), "pos", F.from_json("value", schema).alias("e")).select("split", "pos", "e.*")


def read_coco(spark: SparkSession, folder: str, splits: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """images(split, ord, image, file_name, width, height) and boxes(split, image, gt_idx, cls, x, y, w, h) of an export.

    An image's name is its original one where the export has it. Ids are local to a split's file. Images without boxes
    are in `images`. A box of an unknown image or category is an error. Files are read as streams, whatever their size.
    """
    splits = splits or SPLITS
    order = F.array_position(F.array(*map(F.lit, splits)), F.col("split")) - 1
    images = _labels(spark, folder, splits, "images", IMAGE)
    images = images.select("split", (order * F.lit(1 << 40) + F.col("pos")).alias("ord"), F.coalesce("extra.name", "file_name").alias("image"), "file_name", "id", "width", "height")
    names = _labels(spark, folder, splits, "categories", CATEGORY).select("split", F.col("id").alias("category_id"), F.col("name").alias("cls"))
    boxes = _labels(spark, folder, splits, "annotations", ANNOTATION).select("split", "pos", F.col("image_id").alias("id"), "category_id", "bbox")
    joined = boxes.join(images.select("split", "id", "image"), ["split", "id"], "left").join(names, ["split", "category_id"], "left")
    known = F.when(F.col("image").isNull() | F.col("cls").isNull(), F.raise_error(F.lit("a box names an unknown image or category")).cast("boolean")).otherwise(F.lit(True))
    place = (F.row_number().over(Window.partitionBy("split", "image").orderBy("pos")) - 1).cast("long")
    out = joined.filter(known).withColumn("gt_idx", place)
    return images.drop("id"), out.select("split", "image", "gt_idx", "cls", *[F.col("bbox")[i].alias(n) for i, n in enumerate("xywh")])


def categories_of(spark: SparkSession, folder: str, splits: list[str] | None = None) -> list[dict]:
    """The categories of an export, in its order. Splits that differ in them are an error."""
    kinds = _labels(spark, folder, splits or SPLITS, "categories", CATEGORY)
    rows = kinds.select("split", "pos", F.to_json(F.struct("id", "name", "supercategory")).alias("c")).collect()
    by = {s: [json.loads(r["c"]) for r in sorted((r for r in rows if r["split"] == s), key=lambda r: r["pos"])] for s in splits or SPLITS}
    first = next(iter(by.values()))
    if any(other != first for other in by.values()):
        raise ValueError("the splits of the export have different categories")
    return first


#: The folder of each part of a prepared set.
PARTS = {"train": "train", "val": "valid", "test": "test"}


def write_coco(images: DataFrame, boxes: DataFrame, categories: list[dict], folder: str) -> None:
    """A label file for each part, ids renumbered from 0 in the order of `ord` and gt_idx; read_coco reads it again.

    images has split (train, val or test), ord, image, file_name, width and height; boxes has split, image, gt_idx, cls
    and x, y, w, h. Categories stay as they are, so classes keep their ids. Ids run over ranges of the order; the lines of
    a file, an entry each, are sorted in ranges, and their files are joined as a stream.
    """
    spark = images.sparkSession
    ids = numbered(images.select("split", "ord", "image", "file_name", "width", "height"), ["split"], [F.col("ord")], "id")
    number = F.create_map(*[F.lit(v) for c in categories for v in (c["name"], c["id"])])
    rows = boxes.join(ids.select("split", "image", F.col("id").alias("image_id")), ["split", "image"])
    rows = numbered(rows, ["split"], [F.col("image_id"), F.col("gt_idx")], "id")
    comma = F.when(F.col("id") > 0, ", ").otherwise("")
    image = F.struct("id", "file_name", "width", "height", F.struct(F.col("image").alias("name")).alias("extra"))
    box = F.struct("id", "image_id", F.element_at(number, F.col("cls")).cast("long").alias("category_id"), F.array(*"xywh").alias("bbox"))
    entries = ids.select("split", F.lit(1).alias("part"), "id", F.concat(comma, F.to_json(image)).alias("value"))
    entries = entries.union(rows.select("split", F.lit(3), "id", F.concat(comma, F.to_json(box))))
    frame = [(s, n, 0, t) for s in PARTS for n, t in ((0, f'{{"categories": {json.dumps(categories)}, "images": ['), (2, '], "annotations": ['), (4, "]}"))]
    lines = entries.union(spark.createDataFrame(frame, "split string, part int, id long, value string"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    for split, name in PARTS.items():
        parts = f"{folder}/{name}/_parts"
        lines.filter(F.col("split") == split).repartitionByRange(tasks, "part", "id").sortWithinPartitions("part", "id").select("value").write.mode("overwrite").text(parts)
        joined_file(spark, parts, f"{folder}/{name}/{LABELS}")


def copy_pictures(images: DataFrame, source: str, folder: str) -> int:
    """Copies images(published, split, file_name) from an export's splits to the parts of a prepared set; a lost one is an error."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            for r in b.to_pylist():
                store, at = fs.FileSystem.from_uri(f"{source}/{r['published']}/{r['file_name']}")
                other, to = fs.FileSystem.from_uri(f"{folder}/{PARTS[r['split']]}/{r['file_name']}")
                other.create_dir(to.rpartition("/")[0])
                fs.copy_files(at, to, source_filesystem=store, destination_filesystem=other)
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    return images.select("published", "split", "file_name").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def missing_from(rows: DataFrame, known: DataFrame, key: str = "file") -> DataFrame:
    """Rows that a strict lookup would miss."""
    return rows.join(known.select(key), key, "left_anti")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """image, pred_idx, cls, conf and a box; pred_idx follows the rows of the files."""
    rows = spark.read.schema(PREDICTIONS).csv(path, header=True).withColumn("_row", F.monotonically_increasing_id())
    place = (F.row_number().over(Window.partitionBy("file").orderBy("_row")) - 1).cast("long")
    return rows.select(F.col("file").alias("image"), place.alias("pred_idx"), F.col("class_name").alias("cls"), F.col("confidence").alias("conf"), "x", "y", "w", "h")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).csv(path, header=True, nullValue="")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nulls are blank."""
    df.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def read_metrics(spark: SparkSession, path: str, score: str = "test/mAP_50_95") -> DataFrame:
    """A training's metrics by epoch, numbers all; blanks are null. Exactly one row must have the test score."""
    head = spark.read.text(path).first()
    names = next(csv.reader([head["value"]])) if head else []
    rows = spark.read.schema(T.StructType([T.StructField(n, T.DoubleType()) for n in names])).csv(path, header=True, nullValue="")
    if score not in names or rows.filter(F.col(f"`{score}`").isNotNull()).count() != 1:
        raise ValueError(f"{path} has not one row with {score}")
    return rows


def class_scores(metrics: DataFrame, prefix: str = "test/AP/") -> DataFrame:
    """Columns test/AP/<class> of the test row as rows: cls, ap."""
    names = [c for c in metrics.columns if c.startswith(prefix)]
    flat = F.explode(F.array(*[F.struct(F.lit(c[len(prefix) :]).alias("cls"), F.col(f"`{c}`").cast("double").alias("ap")) for c in names]))
    return metrics.select(flat.alias("r")).select("r.*").filter("ap is not null")


def read_json(spark: SparkSession, path: str, run: str) -> DataFrame:
    """A config or record file as one row: run, config."""
    return spark.read.text(path, wholetext=True).select(F.lit(run).alias("run"), F.col("value").alias("config"))


def read_lookup(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """key and a number, without blanks."""
    return spark.read.csv(path, header=True, nullValue="").select(key, F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull())


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """image, folder (the last of its path), width, height and data as RGB bytes, row by row.

    Formats are those of the machine's picture reader. A file that it cannot read is an error, and not left out.
    """
    rows = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")

    def rgb(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                image, folder, h, w = (b.column(c)[i].as_py() for c in ("image", "folder", "height", "width"))
                if h is None or h <= 0:
                    raise ValueError(f"{folder}/{image} cannot be read as a picture")
                # One or three or four channels, blue first; grey is all three.
                raw = np.frombuffer(b.column("data")[i].as_buffer(), np.uint8).reshape(h, w, -1)
                pixels = np.repeat(raw, 3, axis=2) if raw.shape[2] == 1 else raw[:, :, 2::-1]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((image, pa.string()), (folder, pa.string()), (w, pa.int32()), (h, pa.int32()), (pixels.tobytes(), pa.binary()))], ["image", "folder", "width", "height", "data"])

    part = lambda i: F.try_element_at(F.split("origin", "/"), F.lit(i))
    named = rows.select(part(-1).alias("image"), part(-2).alias("folder"), "height", "width", "data")
    return named.mapInArrow(rgb, "image string, folder string, width int, height int, data binary")


def file_hashes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, folder (the last of its path), sha256 and length of files."""
    part = lambda i: F.try_element_at(F.split("path", "/"), F.lit(i))
    return spark.read.format("binaryFile").load(path).select(part(-1).alias("file"), part(-2).alias("folder"), F.sha2("content", 256).alias("sha256"), "length")


def list_pictures(spark: SparkSession, path: str, most: int = 6) -> DataFrame:
    """The first files that are pictures, by path."""
    return spark.read.format("binaryFile").load(path).select("path").filter(F.lower("path").rlike(r"\.(jpe?g|png|webp)$")).orderBy("path").limit(most)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, in whatever store the path names."""
    files = spark._jvm.org.apache.hadoop.fs
    at = files.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
