import json

import numpy as np
import pytest
from pictures import png
from pyspark.sql import functions as F

from calibra import cli
from calibra.sources import datasets as D


def export(folder):
    cats = [{"id": 0, "name": "objects", "supercategory": "none"}, {"id": 1, "name": "b", "supercategory": "o"}, {"id": 2, "name": "a", "supercategory": "o"}]
    files = {"train": ["IMG_20251106_130044.jpg", "ZE_1.png"], "valid": ["IMG_20251106_140000.jpg"], "test": ["4.jpg", "IMG_20251107_090000.jpg", "IMG_20251107_090100.jpg"]}
    for s, names in files.items():
        (folder / s).mkdir(parents=True)
        images = [{"id": i, "file_name": f"x{i}.jpg", "width": 64, "height": 48, "extra": {"name": n}} for i, n in enumerate(names)]
        boxes = [{"id": i, "image_id": i, "category_id": 1 + i % 2, "bbox": [1.0, 2.0, 10.0, 20.0]} for i in range(len(names)) if names[i] != "IMG_20251107_090000.jpg"]
        (folder / s / D.LABELS).write_text(json.dumps({"categories": cats, "images": images, "annotations": boxes}))
        for i, n in enumerate(names):
            y, x = np.mgrid[:48, :64]
            (folder / s / f"x{i}.jpg").write_bytes(png(np.stack([(y * (3 + i) + 7 * len(s)) % 256, (x * (5 + len(n) % 7)) % 256, (x * y) % 256], axis=-1)))


def test_coco_manifest_prepare_and_evaluate(spark, tmp_path, capsys):
    export(tmp_path / "e")
    images, boxes = D.read_coco(spark, str(tmp_path / "e"))
    assert images.count() == 6 and boxes.count() == 5 and [r.image for r in images.orderBy("ord").collect()][2] == "IMG_20251106_140000.jpg"
    raw = cli.manifest_rows(spark, str(tmp_path / "e"))
    assert {r.exclusion for r in raw.collect()} == {"", "third_party_video", "third_party_press", "no_boxes"}
    split = F.when(F.col("exclusion") != "", "excluded").when(F.col("file").contains("1106_13"), "train").when(F.col("file").contains("1106_14"), "val").otherwise("test")
    D.write_csv(raw.select("file", "published_split", "width", "height", "captured_at", "boxes", "sha256", F.lit("0" * 64).alias("phash256"), "exclusion", F.lit(None).cast("int").alias("session"), split.alias("split")), str(tmp_path / "m2"))
    assert D.read_manifest(spark, str(tmp_path / "m2")).count() == 6
    for command in ("summary", "leak-audit", "sessions"):
        cli.main([command, "--manifest", str(tmp_path / "m2")])
    assert "with_twin" in capsys.readouterr().out
    cli.main(["prepare", "--export", str(tmp_path / "e"), "--manifest", str(tmp_path / "m2"), "--out", str(tmp_path / "p")])
    before = json.loads((tmp_path / "e" / "test" / D.LABELS).read_text())
    made = json.loads((tmp_path / "p" / "test" / D.LABELS).read_text())
    names = {i["id"]: i["extra"]["name"] for i in made["images"]}
    assert sorted(names) == list(range(len(names))) and made["categories"] == before["categories"]
    of = {i["id"]: i["extra"]["name"] for i in before["images"]}
    key = lambda boxes, of: sorted((of[a["image_id"]], a["category_id"], a["bbox"]) for a in boxes if of[a["image_id"]] in names.values())
    assert key(made["annotations"], names) == key(before["annotations"], of) and [a["id"] for a in made["annotations"]] == list(range(len(made["annotations"])))
    assert (tmp_path / "p" / "valid" / "x0.jpg").read_bytes() == (tmp_path / "e" / "valid" / "x0.jpg").read_bytes()
    again, some = D.read_coco(spark, str(tmp_path / "p"))
    assert again.count() == sum(1 for s in ("train", "valid", "test") for _ in json.loads((tmp_path / "p" / s / D.LABELS).read_text())["images"]) and some.count() > 0
    other = before | {"categories": before["categories"][:2]}
    (tmp_path / "e" / "test" / D.LABELS).write_text(json.dumps(other))
    with pytest.raises(ValueError, match="categories"):
        D.categories_of(spark, str(tmp_path / "e"))
    (tmp_path / "e" / "test" / D.LABELS).write_text(json.dumps(before))
    lost = D.read_manifest(spark, str(tmp_path / "m2")).filter("file <> '4.jpg'")
    D.write_csv(lost, str(tmp_path / "m3"))
    with pytest.raises(KeyError):
        cli.main(["prepare", "--export", str(tmp_path / "e"), "--manifest", str(tmp_path / "m3"), "--out", str(tmp_path / "q")])
    (tmp_path / "r").mkdir()
    for s, name in (("val", "IMG_20251106_140000.jpg"), ("test", "IMG_20251107_090100.jpg")):
        (tmp_path / "r" / f"predictions_{s}.csv").write_text(f"file,class_name,confidence,x,y,w,h\n{name},b,0.9000,1.0,2.0,10.0,20.0\n{name},a,0.2000,50.0,2.0,10.0,20.0\n")
    cli.main(["evaluate", "--prepared", str(tmp_path / "p"), "--results", str(tmp_path / "r")])
    assert json.loads((tmp_path / "r" / "evaluation.json").read_text())["test"]["per_class"]["b"]["n_gt"] == 1 and "Verdict" in capsys.readouterr().out


def test_small_readers(spark, tmp_path):
    (tmp_path / "metrics.csv").write_text("epoch,val/mAP_50_95,test/mAP_50_95,test/AP/a,test/AP/b\n1,0.5,,,\n2,0.6,0.7,0.8,0.9\n")
    metrics = D.read_metrics(spark, str(tmp_path / "metrics.csv"))
    assert {r.cls: r.ap for r in D.class_scores(metrics).collect()} == {"a": 0.8, "b": 0.9}
    (tmp_path / "two.csv").write_text("epoch,test/mAP_50_95\n1,0.5\n2,0.6\n")
    with pytest.raises(ValueError):
        D.read_metrics(spark, str(tmp_path / "two.csv"))
    (tmp_path / "c.json").write_text('{"a": {"b": 1}}')
    assert D.read_json(spark, str(tmp_path / "c.json"), "x").first().run == "x"
    (tmp_path / "ring.csv").write_text("image,ring_b\ni,1.5\nj,\n")
    assert D.read_lookup(spark, str(tmp_path / "ring.csv"), "image", "ring_b").count() == 1
    hashes = D.file_hashes(spark, str(tmp_path / "c.json")).first()
    assert hashes.length == 15 and len(hashes.sha256) == 64
    (tmp_path / "pics").mkdir()
    for n in ("b.PNG", "a.jpg", "c.txt"):
        (tmp_path / "pics" / n).write_bytes(b"x")
    assert [r.path.rpartition("/")[2] for r in D.list_pictures(spark, str(tmp_path / "pics")).collect()] == ["a.jpg", "b.PNG"]
    (tmp_path / "boxes.csv").write_text("image,outcome,ring_pixels,ring_b,plate_chroma,group\n" + "".join(f"i{k % 9},x,200,{k},1.0,{'misread' if k % 2 else 'correct'}\n" for k in range(60)))
    cli.main(["backdrop", "--boxes-file", str(tmp_path / "boxes.csv"), "--results", str(tmp_path), "--reps", "50"])
    assert json.loads((tmp_path / "backdrop.json").read_text())["bootstrap_reps"] == 50


def test_png(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(np.tile(np.array([255, 0, 10], np.uint8), (2, 3, 1))))
    r = D.read_pictures(spark, str(tmp_path)).first()
    assert (r.image, r.folder, r.width, r.height, bytes(r.data)) == ("a.png", tmp_path.name, 3, 2, bytes([255, 0, 10] * 6))
