import io
import json
import random
import tracemalloc

import pytest

from calibra.sources import datasets as D
from calibra.sources import entries as E


class Slow(io.BytesIO):
    """Gives a few bytes at a time, so that values and characters are cut anywhere."""

    def read(self, n=-1):
        return super().read(min(n, 7)) if n > 0 else super().read()


def test_entries_are_those_of_a_whole_parse():
    rnd = random.Random(2)
    made = {"info": {"a": [1, {"b": "]}"}]}, "images": [{"id": i, "name": rnd.choice(["ä]", 'q"\\{', "漢字", "x" * 30])} for i in range(40)], "n": 12, "empty": [], "annotations": [{"bbox": [rnd.random(), -1e-7], "t": None}, 5, "s", [1, 2], True], "last": -3.5}
    for text in (json.dumps(made), json.dumps(made, indent=2, ensure_ascii=False)):
        got = {}
        for name, place, value in E.array_entries(Slow(text.encode()), {"images", "annotations", "empty"}):
            assert place == len(got.setdefault(name, []))
            got[name].append(json.loads(value))
        assert got == {k: made[k] for k in ("images", "annotations")}


@pytest.mark.parametrize("text", ["[1]", '{"images": [{"id": 1}', '{"images": [{"id": 1} {"id": 2}]', '{"a" 1}', ""])
def test_broken_files_are_errors(text):
    with pytest.raises(ValueError):
        list(E.array_entries(io.BytesIO(text.encode()), {"images"}))


class Boxes(io.RawIOBase):
    """A file of a million boxes that is made as it is read."""

    def __init__(self, n):
        self.n, self.at, self.rest = n, -1, b""

    def read(self, size=-1):
        while len(self.rest) < size and self.at <= self.n:
            if self.at < 0:
                self.rest += b'{"annotations": ['
            elif self.at == self.n:
                self.rest += b"]}"
            else:
                self.rest += b'%s{"id": %d, "image_id": %d, "category_id": 1, "bbox": [1.0, 2.0, 3.0, 4.0]}' % (b", " if self.at else b"", self.at, self.at // 9)
            self.at += 1
        out, self.rest = self.rest[:size], self.rest[size:]
        return out


def test_memory_stays_flat_over_a_million_boxes():
    tracemalloc.start()
    count = sum(1 for _ in E.array_entries(Boxes(1_000_000), {"annotations"}))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == 1_000_000 and peak < 20 << 20


def test_written_labels_over_several_ranges(spark, tmp_path):
    rnd = random.Random(5)
    images = [("train" if i % 4 else "val", 1000 - i, f"i{i}", f"f{i}.png", 64, 48) for i in range(200)]
    boxes = [(s, n, k, rnd.choice("ab"), float(k), 1.0, 2.0, 3.0) for s, _, n, *_ in images for k in range(rnd.randint(0, 4))]
    kinds = [{"id": 4, "name": "a", "supercategory": "o"}, {"id": 2, "name": "b", "supercategory": "o"}]
    frame = spark.createDataFrame(images, "split string, ord long, image string, file_name string, width int, height int")
    D.write_coco(frame, spark.createDataFrame(boxes, "split string, image string, gt_idx long, cls string, x double, y double, w double, h double"), kinds, str(tmp_path))
    for split, folder in D.PARTS.items():
        made = json.loads((tmp_path / folder / D.LABELS).read_text())
        want = [n for _, _, n in sorted((o, s, n) for s, o, n, *_ in images if s == split)]
        assert [i["extra"]["name"] for i in made["images"]] == want and [i["id"] for i in made["images"]] == list(range(len(want)))
        own = sorted(((want.index(n), k, c) for s, n, k, c, *_ in boxes if s == split))
        assert [(a["image_id"], a["bbox"][0], a["category_id"]) for a in made["annotations"]] == [(i, float(k), {"a": 4, "b": 2}[c]) for i, k, c in own]
        assert [a["id"] for a in made["annotations"]] == list(range(len(own))) and made["categories"] == kinds
        assert sorted(p.name for p in (tmp_path / folder).iterdir() if not p.name.startswith(".")) == [D.LABELS]
    again, found = D.read_coco(spark, str(tmp_path))
    assert again.count() == 200 and found.count() == len(boxes)
