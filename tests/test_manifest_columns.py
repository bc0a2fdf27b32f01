import hashlib
import json

import numpy as np
import pytest
from pictures import png

from calibra import cli
from calibra.operators import phash as H
from calibra.sources import datasets as D


def noise(seed, n=32):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:n, :n]
    waves = sum(rng.normal() * np.cos(rng.normal() * x / 4 + rng.normal() * y / 4 + rng.normal()) for _ in range(8))
    return np.clip(128 + 40 * waves[..., None] + np.zeros(3), 0, 255).astype(np.uint8)


@pytest.fixture(scope="module")
def export(tmp_path_factory):
    """Six days of twelve captures, one a quarter of an hour; the first of a day looks like the last of the day before."""
    folder, names, k = tmp_path_factory.mktemp("export"), {}, 0
    for part, days in (("train", range(1, 5)), ("valid", [5]), ("test", [6])):
        (folder / part).mkdir()
        images, boxes = [], []
        for day in days:
            for i in range(12):
                name = f"IMG_202505{day:02d}_{10 + i // 4:02d}{15 * (i % 4):02d}00.jpg" if (day, i) != (2, 5) else "ZE_7.png"
                looks = 100 * (day - 1) + 11 if i == 0 and day in (2, 3) else 100 * day + i
                (folder / part / f"f{k}.png").write_bytes(png(noise(looks)))
                names[name] = (part, f"f{k}.png", day, i)
                images.append({"id": k, "file_name": f"f{k}.png", "width": 32, "height": 32, "extra": {"name": name}})
                boxes += [{"id": 2 * k + j, "image_id": k, "category_id": 1 + j, "bbox": [1.0 + 9 * j, 2.0, 5.0, 6.0]} for j in range(2) if j == 0 or i % 3]
                k += 1
        kinds = [{"id": 0, "name": "all", "supercategory": "none"}, {"id": 1, "name": "a", "supercategory": "all"}, {"id": 2, "name": "b", "supercategory": "all"}]
        (folder / part / D.LABELS).write_text(json.dumps({"info": {"x": [{}]}, "categories": kinds, "images": images, "annotations": boxes}))
    return folder, names


def test_a_written_manifest_is_whole_and_commands_go_on_from_it(spark, export, tmp_path, capsys):
    folder, names = export
    out = str(tmp_path / "m")
    cli.main(["manifest", "--export", str(folder), "--out", out, "--test-least", "8", "--rest-least", "20"])
    rows = {r.file: r for r in D.read_manifest(spark, out).collect()}
    assert set(rows) == set(names)
    for name, (part, file, *_) in names.items():
        raw = (folder / part / file).read_bytes()
        assert rows[name].published_split == part and rows[name].sha256 == hashlib.sha256(raw).hexdigest()
    seeds = {n: (100 * (d - 1) + 11 if i == 0 and d in (2, 3) else 100 * d + i) for n, (_, _, d, i) in names.items()}
    assert all(rows[n].phash256 == H.hash_of(noise(s)) for n, s in seeds.items())
    kept = {n: r for n, r in rows.items() if not r.exclusion}
    assert rows["ZE_7.png"].split == "excluded" and rows["ZE_7.png"].session is None and len(kept) == 71
    # of every day a session a capture, but that the first of the second and third day are one with the last before
    at = {(d, i): n for n, (_, _, d, i) in names.items()}
    assert rows[at[2, 0]].session == rows[at[1, 11]].session and rows[at[3, 0]].session == rows[at[2, 11]].session
    assert sorted({r.session for r in kept.values()}) == list(range(1, 70))
    tested = {names[n][2] for n, r in kept.items() if r.split == "test"}
    assert tested and all(r.split == "test" for n, r in kept.items() if names[n][2] in tested) and 0.15 <= sum(r.split == "test" for r in kept.values()) / 71 <= 0.25
    by = {}
    for r in kept.values():
        if r.split != "test":
            by.setdefault(r.session, set()).add(r.split)
    assert all(len(s) == 1 for s in by.values()) and 0.12 * 71 <= sum(r.split == "val" for r in kept.values()) <= 0.17 * 71
    cli.main(["prepare", "--export", str(folder), "--manifest", out, "--out", str(tmp_path / "p")])
    images, _ = D.read_coco(spark, str(tmp_path / "p"))
    parts = {}
    for r in images.collect():
        parts[r.image] = {"train": "train", "valid": "val", "test": "test"}[r.split]
    assert parts == {n: r.split for n, r in kept.items()}
    capsys.readouterr()
    cli.main(["leak-audit", "--manifest", out, "--out", str(tmp_path / "leaks.json")])
    leaks = json.loads((tmp_path / "leaks.json").read_text())
    assert list(leaks) == ["max_bits", "images", "with_twin", "with_tied_nearest_twins", "nearest_twin_other_split", "nearest_twin_other_split_min", "nearest_twin_other_split_max", "any_twin_other_split"]
    assert leaks["images"] == 72 and leaks["with_twin"] == 4
    cli.main(["sessions", "--manifest", out])
    assert "session" in capsys.readouterr().out


def test_a_lost_picture_and_a_rule_that_no_day_meets(spark, export, tmp_path):
    folder, _ = export
    with pytest.raises(Exception, match="no set of dates"):
        cli.main(["manifest", "--export", str(folder), "--out", str(tmp_path / "m")])
    import shutil

    shutil.copytree(folder, tmp_path / "e")
    (tmp_path / "e" / "train" / "f3.png").unlink()
    with pytest.raises(Exception, match="no picture f3.png"):
        cli.main(["manifest", "--export", str(tmp_path / "e"), "--out", str(tmp_path / "m"), "--test-least", "8", "--rest-least", "20"])
