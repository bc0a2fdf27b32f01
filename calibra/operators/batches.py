"""Pictures out of Arrow batches, one at a time, so that a task holds a batch and one decoded picture."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


#: Rows whose small columns are turned into Python values at once.
ROWS = 256


def pictures_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, dict]]:
    """Name, pixels (height x width x 3) and the other columns of each picture. A size that differs from the data's is an error."""
    for whole in batches:
        for first in range(0, whole.num_rows, ROWS):
            batch = whole.slice(first, ROWS)
            others = [c for c in batch.schema.names if c not in ("image", "width", "height", "data")]
            values = [batch.column(c).to_pylist() for c in others]
            data = batch.column("data")
            for i, (name, width, height) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("image", "width", "height")), strict=True)):
                pixels = np.frombuffer(data[i].as_buffer(), np.uint8)
                if len(pixels) != 3 * width * height:
                    raise ValueError(f"{name} is not {width} x {height}")
                yield name, pixels.reshape(height, width, 3), {c: v[i] for c, v in zip(others, values, strict=True)}
