"""The entries of arrays in a large JSON file, read as a stream: a task holds a chunk of text and a batch of entries."""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Bytes that are read at a time, and entries in a batch of rows.
CHUNK, BATCH = 1 << 20, 4096
BLANK = " \t\r\n"


class _Text:
    """Text of which the part that was used is dropped, and that is read on where a value is not complete."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.decode, self.parse = stream, codecs.getincrementaldecoder("utf-8")().decode, json.JSONDecoder().raw_decode
        self.text, self.at, self.ended, self.step = "", 0, False, CHUNK

    def more(self) -> bool:
        if self.ended:
            return False
        raw = self.stream.read(self.step)
        self.ended = not raw
        self.text, self.at = self.text[self.at :] + self.decode(raw, final=self.ended), 0
        return True

    def peek(self) -> str:
        """The next character that is not blank; empty at the end."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in BLANK:
                self.at += 1
            if self.at < len(self.text):
                return self.text[self.at]
            if not self.more():
                return ""

    def skip(self, wanted: str) -> None:
        if self.peek() != wanted:
            raise ValueError(f"JSON has {self.peek()!r} where {wanted!r} should be")
        self.at += 1

    def value(self) -> tuple[object, str]:
        """The next value and its text. Where it is cut off, twice as much is read each time."""
        self.peek()
        while True:
            try:
                found, end = self.parse(self.text, self.at)
                if end < len(self.text) or self.ended:  # a number may go on
                    text, self.at, self.step = self.text[self.at : end], end, CHUNK
                    return found, text
            except json.JSONDecodeError:
                if self.ended:
                    raise
            self.step = max(CHUNK, 2 * (len(self.text) - self.at))
            self.more()


def array_entries(stream: BinaryIO, names: set[str]) -> Iterator[tuple[str, int, str]]:
    """Name, place and text of each entry of the arrays `names` of a JSON object, in the file's order."""
    text = _Text(stream)
    text.skip("{")
    while text.peek() != "}":
        key, _ = text.value()
        text.skip(":")
        if key in names and text.peek() == "[":
            text.skip("[")
            place = 0
            while text.peek() != "]":
                yield key, place, text.value()[1]
                place += 1
                if text.peek() == ",":
                    text.skip(",")
            text.skip("]")
        else:
            text.value()
        if text.peek() == ",":
            text.skip(",")


def read_entries(spark: SparkSession, paths: list[tuple[str, str]], name: str) -> DataFrame:
    """key, pos and value (JSON) of each entry of the array `name` in the files, given as (key, path). A file is one task's stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, path in zip(b.column("key").to_pylist(), b.column("path").to_pylist(), strict=True):
                store, at = fs.FileSystem.from_uri(path)
                held: list[tuple[int, str]] = []
                with store.open_input_stream(at) as f:
                    for _, place, value in array_entries(f, {name}):
                        held.append((place, value))
                        if len(held) == BATCH:
                            yield _rows(key, held)
                            held = []
                if held:
                    yield _rows(key, held)

    listed = spark.createDataFrame(paths, "key string, path string")
    return listed.repartition(max(1, len(paths)), "key").mapInArrow(run, "key string, pos long, value string")


def _rows(key: str, held: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key] * len(held)), pa.array([p for p, _ in held], pa.int64()), pa.array([v for _, v in held], pa.string())], ["key", "pos", "value"])


def joined_file(spark: SparkSession, folder: str, path: str) -> None:
    """One file of a folder's part files, in the order of their names, copied as a stream by a task; the parts go when it is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _ in range(b.num_rows):
                store, source = fs.FileSystem.from_uri(folder)
                parts = sorted(f.path for f in store.get_file_info(fs.FileSelector(source)) if f.base_name.startswith("part-"))
                store, at = fs.FileSystem.from_uri(path)
                with store.open_output_stream(at + ".tmp") as out:
                    for p in parts:
                        with store.open_input_stream(p) as part:
                            while block := part.read(CHUNK):
                                out.write(block)
                store.move(at + ".tmp", at)
                store.delete_dir(source)
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    spark.range(0, 1, 1, 1).mapInArrow(run, "n long").collect()
