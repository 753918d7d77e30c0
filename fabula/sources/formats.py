"""File formats for ``spark.read.format``: ``epub``, ``wav`` and ``voices``.

Files are dealt over partitions, and a task opens them itself and reads no more than the schema asks for: of a WAV file its
header, of an EPUB without ``html`` its package and navigation.  Reading the same through ``binaryFile`` would load whole files.
Paths are local or of a store that pyarrow opens (file, s3, gs, hdfs); for other stores, use the functions over ``binaryFile``.
"""

from __future__ import annotations

import json
import posixpath
import wave
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from fabula.sources.epub import PARTS, book_parts

#: Files of one partition where the option ``filesPerPartition`` says nothing.
FILES = {"epub": 1, "wav": 256, "voices": 256}


@dataclass
class Files(InputPartition):
    """Files of one partition: paths within the store, with their sizes."""

    files: list[tuple[str, int]]


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class _Reader(DataSourceReader):
    def __init__(self, name: str, schema: StructType, options: dict[str, str]):
        if "path" not in options:
            raise ValueError(f"{name} needs a path")
        self.columns, self.options = schema.fieldNames(), options
        self.per, self.suffix = int(options.get("filesperpartition", FILES[name])), ".epub" if name == "epub" else ".wav"

    def partitions(self) -> list[InputPartition]:
        """The files of the folder, or the one file, in order of path; an empty folder has no partitions."""
        store, path = _store(self.options["path"])
        own = store.get_file_info(path)
        if own.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.options["path"])
        found = [own] if own.is_file else [f for f in store.get_file_info(pafs.FileSelector(path)) if f.is_file and f.base_name.lower().endswith(self.suffix)]
        files = sorted((f.path, f.size) for f in found)
        return [Files(files[k : k + self.per]) for k in range(0, len(files), self.per)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = _store(self.options["path"])
        for path, size in partition.files:
            for row in self.rows(store, path, size):
                yield tuple(row[c] for c in self.columns)

    def rows(self, store: pafs.FileSystem, path: str, size: int) -> Iterator[dict]:
        raise NotImplementedError


class _Books(_Reader):
    def rows(self, store, path, size):
        with store.open_input_file(path) as f:
            yield from book_parts(path, f, html="html" in self.columns)


class _Waves(_Reader):
    def header(self, store, path) -> dict:
        """What the header states; zeros where it states nothing."""
        try:
            with store.open_input_file(path) as f, wave.open(f) as w:
                frames, rate, channels = w.getnframes(), w.getframerate(), w.getnchannels()
            return {"seconds": frames / rate if rate else 0.0, "frames": frames, "rate": rate, "channels": channels}
        except (wave.Error, EOFError):
            return {"seconds": 0.0, "frames": 0, "rate": 0, "channels": 0}

    def rows(self, store, path, size):
        known = {"path": path, "file": posixpath.basename(path), "bytes": size}
        yield known | (self.header(store, path) if set(self.columns) - set(known) - {"builtin"} else {})


class _Voices(_Waves):
    def __init__(self, name, schema, options):
        """The manifest of builtin voices, a JSON array of file names, is read once and goes with the reader."""
        super().__init__(name, schema, options)
        self.builtin = set()
        if options.get("manifest"):
            store, path = _store(options["manifest"])
            with store.open_input_file(path) as f:
                self.builtin = set(json.loads(f.read()))

    def rows(self, store, path, size):
        for row in super().rows(store, path, size):
            yield row | {"builtin": row["file"] in self.builtin}


class _Source(DataSource):
    kind: type[_Reader]

    def reader(self, schema: StructType) -> DataSourceReader:
        return self.kind(self.name(), schema, {k.lower(): v for k, v in self.options.items()})


class EpubSource(_Source):
    """Spine documents of books: book, pos, html, points.  A schema without ``html`` leaves the documents packed."""

    kind = _Books

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return PARTS


class WavSource(_Source):
    """WAV files by what their headers state; a schema of path, file and bytes alone opens none."""

    kind = _Waves

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return "path string, file string, bytes long, seconds double, frames long, rate int, channels int"


class VoiceSource(_Source):
    """Voices of a folder: file, seconds, and whether the JSON array in the option ``manifest`` lists the file as builtin."""

    kind = _Voices

    @classmethod
    def name(cls) -> str:
        return "voices"

    def schema(self) -> str:
        return "file string, seconds double, builtin boolean"


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    for source in (EpubSource, WavSource, VoiceSource):
        spark.dataSource.register(source)
