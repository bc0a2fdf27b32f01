import csv
import json

import numpy as np
import pytest
from pictures import png
from stub_model import by_colour

from calibra import cli
from calibra.operators import pixels as P
from calibra.plans import studies
from calibra.sources import datasets as D

KINDS = [{"id": 0, "name": "all", "supercategory": "none"}, *({"id": i + 1, "name": n, "supercategory": "all"} for i, n in enumerate("tmabz"))]
IDS = {k["name"]: k["id"] for k in KINDS}
T_BOX, A_BOX = [20.0, 16.0, 16.0, 12.0], [50.0, 2.0, 8.0, 8.0]
WORDS = ["--target", "t", "--misread", "m", "--suspects", "t,m", "--controls", "a,b", "--partners", "t:m,a:b"]
HEAD = ["file", "class_name", "confidence", "x", "y", "w", "h"]


def table(path, head, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="") as f:
        csv.writer(f).writerows([head, *rows])


def prepared(folder, n, pictures=()):
    for part in ("valid", "test"):
        (folder / part).mkdir(parents=True)
        images = [{"id": i, "file_name": f"f{i}.png", "width": 64, "height": 48, "extra": {"name": f"i{i}"}} for i in range(n)]
        boxes = [{"id": 2 * i + k, "image_id": i, "category_id": IDS[c], "bbox": b} for i in range(n) for k, (c, b) in enumerate((("t", T_BOX), ("a", A_BOX)))]
        (folder / part / D.LABELS).write_text(json.dumps({"categories": KINDS, "images": images, "annotations": boxes}))
    for i, p in enumerate(pictures):
        (folder / "test" / f"f{i}.png").write_bytes(png(p))


def predictions(path, read):
    """A row for each image: what its target is read as (None: missed), and its other box."""
    rows = [(f"i{i}", c, 0.9, *T_BOX) for i, c in enumerate(read) if c] + [(f"i{i}", "a", 0.8 if i % 5 else 0.2, *A_BOX) for i in range(len(read))]
    table(path, HEAD, rows)


def metrics(path, test=0.7, val=0.8, ap=None):
    ap = {"t": 0.5, "m": 0.5, "a": 0.9, "b": 0.8, "z": 0.7} | (ap or {})
    table(path, ["epoch", "val/mAP_50_95", "val/ema_mAP_50_95", "test/mAP_50_95", "test/mAP_50", *(f"test/AP/{c}" for c in ap)], [[0, 0.1, val - 0.1], [1, val, ""], [2, "", 0.2, test, test + 0.1, *ap.values()]])


def runs(folder, n=60, misread=(40, 40, 10)):
    """A first run and two more, each with so many targets read as m and the others as t."""
    config = {"train_config": {"lr": 0.1, "seed": 1, "epochs": 50, "output_dir": "x"}, "model_config": {"pretrain_weights": "C:\\cache\\w.pth"}, "class_names": list("tmabz"), "num_classes": 5, "machine": "one"}
    for name, many in zip(("", "run2c", "run2a"), misread):
        to = folder / name
        for part in ("val", "test"):
            predictions(to / f"predictions_{part}.csv", ["m" if i < many else "t" for i in range(n)])
        metrics(to / "metrics.csv")
        own = json.loads(json.dumps(config))
        if name:
            aug = {"HorizontalFlip": {"p": 0.5}} | ({"PlanckianJitter": {"mode": "cied", "temperature_limit": [4000, 15000], "sampling_method": "uniform", "p": 0.5}} if name == "run2a" else {})
            own["train_config"] |= {"aug_config": aug, "augmentation_backend": "albumentations", "seed": 20261001, "output_dir": "y"}
            own["model_config"]["pretrain_weights"] = "/tmp/w.pth"
            own["machine"] = "other"
            record = {"run": "2C" if name == "run2c" else "2A", "commit": "c", "rfdetr": "1", "albumentations": "2", "split_sizes": {"test": n}, "gpu": "g", "pred_threshold": 0.01, "config_check": {"ok": True, "problems": []}}
            (to / "run_record.json").write_text(json.dumps(record))
        (to / "training_config.json").write_text(json.dumps(own))
    table(folder / "backdrop_boxes.csv", ["image", "outcome", "ring_pixels", "ring_b", "plate_chroma", "group"], [(f"i{i}", "m" if i < misread[0] else "t", 500, 10 if i % 3 else -10, 5, "misread" if i < misread[0] else "correct") for i in range(n)])


def run2(tmp_path, *more):
    return cli.main(["run2-eval", "--prepared", str(tmp_path / "p"), "--results", str(tmp_path / "r"), *WORDS, "--boxes", "60", *more])


def changed(path, change):
    made = json.loads(path.read_text())
    change(made)
    path.write_text(json.dumps(made))


def test_run2_eval_fixed_and_its_report(spark, tmp_path):
    prepared(tmp_path / "p", 60)
    runs(tmp_path / "r")
    assert run2(tmp_path) == 0
    r = json.loads((tmp_path / "r" / "run2_evaluation.json").read_text())
    assert r["verdict"] == "fixed" and r["invalid_reasons"] == []
    p = r["primary"]
    assert (p["M_2C"], p["K_2C"], p["M_2A"], p["K_2A"], p["mcnemar_b_misread_by_2C_only"], p["mcnemar_c_misread_by_2A_only"]) == (40, 20, 10, 50, 30, 0)
    assert p["p_one_sided"] == pytest.approx(2**-30) and all(p["criteria"][k] for k in ("a_halved", "b_significant", "c_correct_not_missed", "d_guardrails")) and not p["criteria"]["void"]
    assert r["runs"]["2A"]["counts"] == {"t": 50, "m": 10, "missed": 0, "other": 0}
    assert r["runs"]["run1"]["by_side"]["blue"] == {"t": 6, "m": 14, "missed": 0, "other": 0}  # every third image of 60
    assert r["runs"]["2C"]["precision_m"] == 0 and r["runs"]["2C"]["confusion"]["t"] == {"m": 40, "t": 20}
    assert r["runs"]["run1"]["metrics"] == {"test_map_50_95": 0.7, "test_map_50": pytest.approx(0.8), "val_map_50_95": 0.8, "val_best_epoch": 1, "val_to_test_gap_map_50_95": pytest.approx(0.1), "test_ap": {"t": 0.5, "m": 0.5, "a": 0.9, "b": 0.8, "z": 0.7}}
    assert set(r["guardrails"]["G3"]["classes"]) == set("abz") and r["guardrails"]["all_ok"]
    text = (tmp_path / "r" / "run2_evaluation.md").read_text()
    assert "**Verdict: fixed**" in text and "| 2A | 0.05 | 50 | 10 | 0 | 0 |" in text
    metrics(tmp_path / "r" / "run2a" / "metrics.csv", ap={"a": 0.8})
    assert run2(tmp_path) == 0
    assert json.loads((tmp_path / "r" / "run2_evaluation.json").read_text())["verdict"] == "fixed at a cost"
    # what voids a run is listed, and there is no other verdict then
    changed(tmp_path / "r" / "run2a" / "training_config.json", lambda c: (c["train_config"].update(lr=0.2, seed=5), c["train_config"].pop("epochs"), c["model_config"].update(pretrain_weights="/tmp/v.pth")))
    changed(tmp_path / "r" / "run2c" / "training_config.json", lambda c: c["train_config"]["aug_config"].update(PlanckianJitter={"p": 0.5}))
    changed(tmp_path / "r" / "run2c" / "run_record.json", lambda c: c.update(run="2A", gpu="h", config_check={"ok": False}))
    assert run2(tmp_path) == 0
    r = json.loads((tmp_path / "r" / "run2_evaluation.json").read_text())
    assert r["verdict"] == "invalid" and [x.split(",")[0] for x in r["invalid_reasons"]] == [
        "2A: model_config.pretrain_weights: run 1 C:\\cache\\w.pth", "2A: train_config.epochs: run 1 50", "2A: train_config.lr: run 1 0.1", "2A: train_config.seed: needs 20261001",
        "2C: train_config.aug_config.PlanckianJitter.p: not of this run", "2C: its own config check did not pass", "2C: the record is of another run", "gpu differs: 2C h",
    ]


def test_refusals_come_in_order_and_leave_later_inputs_unopened(spark, tmp_path, capsys, monkeypatch):
    prepared(tmp_path / "p", 60)
    runs(tmp_path / "r")
    opened = []
    real_predictions, real_coco = D.read_predictions, D.read_coco
    monkeypatch.setattr(D, "read_predictions", lambda s, path: opened.append(path.rpartition("/r/")[2]) or real_predictions(s, path))
    monkeypatch.setattr(D, "read_coco", lambda s, folder, splits=None: opened.append("labels") or real_coco(s, folder, splits))

    def refused(*more):
        opened.clear()
        assert run2(tmp_path, *more) == 2
        return capsys.readouterr().out

    record = tmp_path / "r" / "run2a" / "run_record.json"
    kept = record.read_text()
    record.unlink()
    assert "missing: run2a/run_record.json" in refused() and opened == []
    record.write_text(kept)
    assert "60 target boxes, and 59 are fixed" in refused("--boxes", "59") and set(opened) == {"labels"}
    labels = (tmp_path / "p" / "test" / D.LABELS).read_text()
    changed(tmp_path / "p" / "test" / D.LABELS, lambda c: c["annotations"][1].update(category_id=IDS["t"]))
    out = refused("--boxes", "61")
    assert "1 images have several target boxes" in out and set(opened) == {"labels"}
    (tmp_path / "p" / "test" / D.LABELS).write_text(labels)
    rings = (tmp_path / "r" / "backdrop_boxes.csv").read_text()
    (tmp_path / "r" / "backdrop_boxes.csv").write_text(rings.replace("i7,m,500,10,", "i7,m,500,,"))
    assert "no ring value for: i7" in refused() and not any(o.startswith("run2") for o in opened)
    (tmp_path / "r" / "backdrop_boxes.csv").write_text(rings.replace("i7,m,", "i7,missed,"))
    assert "does not come out as on record" in refused() and not any(o.startswith("run2") for o in opened)


def coloured(n):
    """Pictures with a yellow or a blue ground; the target box itself is grey."""
    out = []
    for i in range(n):
        p = np.empty((48, 64, 3), np.uint8)
        p[:] = (40, 60, 200) if i % 3 == 0 else (210, 190, 30)
        p[16:28, 20:36] = 128
        out.append(p)
    return out


def test_backdrop_and_recolour_from_pictures(spark, tmp_path, capsys):
    n = 30
    prepared(tmp_path / "p", n, coloured(n))
    blue = [i % 3 == 0 for i in range(n)]
    predictions(tmp_path / "r" / "predictions_test.csv", ["t" if b else "m" for b in blue])
    common = ["--prepared", str(tmp_path / "p"), "--results", str(tmp_path / "r"), *WORDS, "--reps", "60"]
    assert cli.main(["backdrop", *common]) == 0
    r = json.loads((tmp_path / "r" / "backdrop.json").read_text())
    assert r["n_target_boxes"] == 30 and r["measurable_boxes"] == {"correct": 10, "misread": 20} and r["unmeasurable_boxes"] == {"correct": 0, "misread": 0}
    assert r["auc_misread_vs_correct"] == 1 and r["auc_ci95_cluster_bootstrap"] == [1, 1] and r["bootstrap_skipped"] == 0
    assert r["verdict"] == "inconclusive"  # fewer than 15 correct boxes
    assert r["ring_b"]["misread"]["median"] == pytest.approx(P.to_lab(np.array([210, 190, 30]))[2])
    assert r["within_image"]["pairs"] == 0 and "**Verdict: inconclusive**" in (tmp_path / "r" / "backdrop.md").read_text()
    assert cli.main(["recolour", *common, "--model", "stub_model:by_colour"]) == 0
    r = json.loads((tmp_path / "r" / "recolour.json").read_text())
    assert r["baseline_gate"] == {"n_checked": 30, "n_dropped": 0, "dropped_images": [], "passed": True}
    assert r["target_colours"]["n_blue"] == 10 and r["target_colours"]["yellow"] == pytest.approx(P.to_lab(np.array([210, 190, 30]))[1:].tolist())
    colours = {s: tuple(r["target_colours"][s]) for s in ("blue", "yellow")}
    want = {}
    for i, p in enumerate(coloured(n)):  # by hand, one picture and arm after the other
        for arm in ("reverse",) if blue[i] else ("ring", "sham", "whole"):
            (_, altered, clipped), = P.arm_pictures(p, T_BOX, [T_BOX, A_BOX], [arm], colours)
            read = by_colour(altered)[0][0]
            want.setdefault(arm, []).append((read == ("m" if arm == "reverse" else "t"), clipped))
    for arm, rows in want.items():
        a = r["arms"][arm]
        assert (a["n"], a["successes"], a["clipped_pixels_median"]) == (len(rows), sum(s for s, _ in rows), pytest.approx(float(np.median([c for _, c in rows]))))
    assert r["arms"]["keep"]["n"] == 0 and r["arms"]["keep"]["share"] is None and r["arms"]["ring"]["successes"] == 20 and r["verdict"] == "for (local)"
    assert r["arms"]["ring"]["median_target_confidence_change"] == pytest.approx(0.6)
    boxes = spark.read.csv(str(tmp_path / "r" / "recolour_boxes.csv"), header=True)
    assert boxes.count() == 70 and {r.baseline_target_confidence for r in boxes.filter("arm = 'ring'").collect()} == {"0.3"}
    # three outcomes that are not met again: nothing is altered
    rows = [r.asDict() for r in spark.read.csv(str(tmp_path / "r" / "backdrop_boxes.csv"), header=True).collect()]
    table(tmp_path / "q" / "backdrop_boxes.csv", list(rows[0]), [[("m" if k == "outcome" and r["image"] in ("i0", "i3", "i6") else v) for k, v in r.items()] for r in rows])
    assert cli.main(["recolour", "--prepared", str(tmp_path / "p"), "--results", str(tmp_path / "q"), *WORDS, "--model", "stub_model:by_colour"]) == 0
    r = json.loads((tmp_path / "q" / "recolour.json").read_text())
    assert r["baseline_gate"]["dropped_images"] == ["i0", "i3", "i6"] and r["arms"] == {} and r["verdict"].startswith("no verdict")
    assert not (tmp_path / "q" / "recolour_boxes.csv").exists()


def test_a_picture_of_another_size_is_an_error(spark, tmp_path):
    prepared(tmp_path / "p", 1, [np.zeros((40, 64, 3), np.uint8)])
    predictions(tmp_path / "r" / "predictions_test.csv", ["t"])
    with pytest.raises(Exception, match="not as large as its label"):
        cli.main(["backdrop", "--prepared", str(tmp_path / "p"), "--results", str(tmp_path / "r"), *WORDS])


def test_evaluation_has_every_class_and_the_verdict(spark, tmp_path):
    prepared(tmp_path / "p", 20)
    for part, many in (("val", 2), ("test", 12)):
        predictions(tmp_path / "r" / f"predictions_{part}.csv", ["m" if i < many else None if i == 19 else "t" for i in range(20)])
    assert cli.main(["evaluate", "--prepared", str(tmp_path / "p"), "--results", str(tmp_path / "r"), *WORDS]) == 0
    r = json.loads((tmp_path / "r" / "evaluation.json").read_text())
    assert list(r["test"]["per_class"]) == list("tmabz") and r["test"]["per_class"]["z"] == {"precision": 0, "recall": 0, "n_gt": 0, "n_pred": 0}
    e = r["test"]["errors"]["t"]
    assert (e["n_gt"], e["correct"], e["partner"], e["missed"], e["other"], e["partner_share"], e["confused_as"]) == (20, 7, 12, 1, 0, 0.6, {"m": 12, "missed": 1})
    assert r["test"]["errors"]["z"]["partner_class"] is None and r["confidence_threshold"] == 0.05 and r["test"]["background_predictions"] == 0
    assert set(r["test"]["ap50_recomputed"]) == {"t", "a"} and r["test"]["map50_recomputed"] == pytest.approx((r["test"]["ap50_recomputed"]["t"] + r["test"]["ap50_recomputed"]["a"]) / 2)
    # m has no boxes, so its own largest error is not its partner
    assert r["verdict"] == "mixed" and len(r["verdict_reasons"]) == 2 and "| z | 0 | 0 |" in (tmp_path / "r" / "evaluation.md").read_text()


def test_classes_of_an_export():
    assert studies.class_names(KINDS) == list("tmabz")
    assert studies.class_names([{"name": "x", "supercategory": "none"}, {"name": "y"}]) == ["x", "y"]
