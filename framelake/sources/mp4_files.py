"""MP4 files of any store as a table of boxes, read by ranges: headers, and the payloads that are asked for.

Register ``BoxSource`` with ``spark.dataSource.register`` and read with
``spark.read.format("mp4_boxes").option("kinds", "stts,stsz").load(folder)``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from framelake.sources.mp4 import BOX_SCHEMA, scan_boxes

SCHEMA = f"{BOX_SCHEMA}, payload binary, bytes_read long"

#: Bytes of a payload that is read at most; the tables of a track are far smaller. Longer ones are an error.
MOST_PAYLOAD = 1 << 28


class FilePartition(InputPartition):
    """One file: a task reads it from its headers on."""

    def __init__(self, path: str, size: int):
        super().__init__(path)
        self.path, self.size = path, size


class BoxSource(DataSource):
    """Options: path (a file or folder of any store that Arrow opens), kinds (of the payloads to read, by commas; none without).

    Columns are those of ``sources.mp4.boxes``, payload and bytes_read, which is
    what was read of the file so far. A file has a partition. Between headers
    nothing is read, so the size of media data costs nothing. A file without
    exactly one moov box, or whose moov has not exactly one mvhd box, has a row
    with that error and no kind at its end; other faults are rows as in
    ``boxes``. With option pushdown, which needs the setting
    spark.sql.python.filterPushdown.enabled, a filter on ``kind`` by equality or
    a list narrows the payloads that are read; Spark still applies it.
    """

    @classmethod
    def name(cls) -> str:
        return "mp4_boxes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return FilteringBoxReader(self.options) if self.options.get("pushdown", "false").lower() == "true" else BoxReader(self.options)


class BoxReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.kinds = {k.strip() for k in options.get("kinds", "").split(",") if k.strip()}

    def partitions(self) -> list[FilePartition]:
        store, path = _opened(self.path)
        found = store.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.is_file else [f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
        return [FilePartition(f.path, f.size) for f in sorted(files, key=lambda f: f.path)]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        store, _ = _opened(self.path)
        count = 0
        movies: list[int] = []
        headers: list[int] = []
        with store.open_input_file(partition.path) as file:

            def take(at: int, n: int) -> bytes:
                nonlocal count
                part = file.read_at(n, at)
                count += len(part)
                return part

            for at, size, kind, header, depth, parent, error in scan_boxes(take, partition.size):
                payload = None
                if error is None and kind in self.kinds:
                    if size - header > MOST_PAYLOAD:
                        error = "invalid: payload is too long"
                    else:
                        payload = take(at + header, size - header)
                if error is None and kind == "moov" and depth == 0:
                    movies.append(at)
                if error is None and kind == "mvhd" and depth == 1 and parent in movies:
                    headers.append(parent)
                yield partition.path, at, size, kind, header, depth, parent, error, payload, count
        faults = {"invalid: no moov box": not movies, "invalid: more than one moov box": len(movies) > 1, "invalid: moov has no mvhd box": bool(set(movies) - set(headers)), "invalid: more than one mvhd box": len(set(headers)) < len(headers)}
        for fault, holds in faults.items():
            if holds:
                yield partition.path, partition.size, 0, None, 0, 0, -1, fault, None, count


class FilteringBoxReader(BoxReader):
    """Narrows the payloads that are read to the kinds that filters leave."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("kind",):
                self.kinds &= {f.value}
            elif isinstance(f, In) and f.attribute == ("kind",):
                self.kinds &= set(f.value)
            yield f


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
