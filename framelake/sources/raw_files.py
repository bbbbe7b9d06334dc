"""Raw media files: visible rows of frames, and samples as 32-bit floats, one file a stream, whole or not at all.

Register ``RawSink`` with ``spark.dataSource.register`` or call ``write_raw``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType

#: Formats of three planes with the bits by which width and height of the later ones are halved.
PLANAR = {"i420": (1, 1), "i422": (1, 0), "i440": (0, 1), "i444": (0, 0)}


def plane_layout(pixel_format: Column, plane: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """struct(first_row, byte_offset, row_bytes, rows) of the visible rectangle in a plane; null where the format has no such plane or its chroma cannot be cut there.

    Formats are nv12, p010, bgra8, rgba8, i420, i422, i440 and i444. Planes of
    interleaved chroma keep whole pairs, so x and width stay and rows are halved.
    """
    even = lambda *values: F.greatest(*(v % 2 for v in values)) == 0
    layout = lambda row, at, size, rows: F.struct(row.cast("long").alias("first_row"), at.cast("long").alias("byte_offset"), size.cast("long").alias("row_bytes"), rows.cast("long").alias("rows"))
    half = lambda v, bit: F.shiftright(v, bit)
    found = (
        F.when((pixel_format.isin("nv12", *PLANAR)) & (plane == 0), layout(y, x, width, height))
        .when((pixel_format == "nv12") & (plane == 1) & even(x, y, width, height), layout(half(y, 1), x, width, half(height, 1)))
        .when((pixel_format == "p010") & (plane == 0), layout(y, x * 2, width * 2, height))
        .when((pixel_format == "p010") & (plane == 1) & even(x, y, width, height), layout(half(y, 1), x * 2, width * 2, half(height, 1)))
        .when(pixel_format.isin("bgra8", "rgba8") & (plane == 0), layout(y, x * 4, width * 4, height))
    )
    for name, (across, down) in PLANAR.items():
        halved = [*([x, width] if across else []), *([y, height] if down else [])]
        whole = even(*halved) if halved else F.lit(True)
        found = found.when((pixel_format == name) & plane.isin(1, 2) & whole, layout(half(y, down), half(x, across), half(width, across), half(height, down)))
    return found


@F.arrow_udf(BinaryType())
def visible_rows(data: pa.Array, offset: pa.Array, stride: pa.Array, layout: pa.Array) -> pa.Array:
    """The rows of a plane that a layout shows, put end to end; null without a layout or where the plane is too short for it."""
    out = []
    for plane, start, step, at in zip(data, offset.to_pylist(), stride.to_pylist(), layout.to_pylist(), strict=True):
        out.append(None)
        if at is None or not plane.is_valid or start is None or step is None:
            continue
        bytes_ = np.frombuffer(plane.as_buffer(), np.uint8)
        first, size, rows = start + at["first_row"] * step + at["byte_offset"], at["row_bytes"], at["rows"]
        if min(start, step, size, rows) < 0 or rows and first + (rows - 1) * step + size > len(bytes_):
            continue
        out[-1] = np.lib.stride_tricks.as_strided(bytes_[first:], (rows, size), (step, 1)).tobytes() if rows and size else b""
    return pa.array(out, pa.binary())


@dataclass
class Written(WriterCommitMessage):
    """Files of one task as (made, wanted)."""

    files: list[tuple[str, str]]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class RawSink(DataSource):
    """Options: path (a folder of any store that Arrow opens) and suffix (of the files). Rows: stream (text), position, data (bytes) and samples (floats).

    A stream's file holds, in order of position, the bytes of each row or else
    its samples as little-endian 32-bit floats; rows of neither add nothing. All
    rows of a stream must come to one task in order, as ``write_raw`` sees to.
    Files are made under a folder of the job and moved into place on commit; a
    failed task or job leaves nothing. Existing files of the same name are
    replaced when the job commits.
    """

    @classmethod
    def name(cls) -> str:
        return "raw_media"

    def schema(self) -> str:
        return "stream string, position long, data binary, samples array<float>"

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        return RawWriter(self.options["path"], self.options.get("suffix", ".raw"))


class RawWriter(DataSourceWriter):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix
        self.job = f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = _opened(self.path)
        store.create_dir(f"{root}/{self.job}", recursive=True)
        files: list[tuple[str, str]] = []
        stream, out = None, None
        try:
            for row in iterator:
                if "/" in row.stream or row.stream.startswith("."):
                    raise ValueError(f"stream {row.stream!r} is no file name")
                if row.stream != stream:
                    if out:
                        out.close()
                    # Attempts of one task do not meet, and a second one is not mistaken for the first.
                    made = f"{root}/{self.job}/{uuid.uuid4().hex}"
                    stream, out = row.stream, store.open_output_stream(made)
                    files.append((made, f"{root}/{row.stream}{self.suffix}"))
                if row.data is not None:
                    out.write(bytes(row.data))
                elif row.samples is not None:
                    out.write(np.asarray(row.samples, "<f4").tobytes())
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _opened(self.path)
        pairs = [pair for message in messages if message for pair in message.files]
        if len({wanted for _, wanted in pairs}) < len(pairs):
            self.abort(messages)
            raise ValueError("rows of one stream came to several tasks, or not in a row")
        for made, wanted in pairs:
            store.move(made, wanted)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _opened(self.path)
        with suppress(FileNotFoundError):
            store.delete_dir(f"{root}/{self.job}")


def write_raw(rows: DataFrame, path: str, suffix: str = ".raw") -> None:
    """Writes rows (stream, position, data and, or samples) as one file for each stream, in order of position and not through the driver."""
    spark = rows.sparkSession
    spark.dataSource.register(RawSink)
    missing = [F.lit(None).cast(kind).alias(name) for name, kind in (("data", "binary"), ("samples", "array<float>")) if name not in rows.columns]
    named = rows.select("*", *missing).select(F.col("stream").cast("string").alias("stream"), F.col("position").cast("long").alias("position"), "data", F.col("samples").cast("array<float>").alias("samples"))
    ordered = named.where("stream IS NOT NULL").repartition("stream").sortWithinPartitions("stream", "position")
    ordered.write.format("raw_media").option("suffix", suffix).mode("append").save(path)
