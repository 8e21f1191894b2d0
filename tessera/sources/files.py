"""Documents as a Spark data source: `spark.read.format("tessera_files").load(folder)` and `df.write.format("tessera_files").save(folder)`.

Reading gives what `loaders.load` gives, rejected files as rows with a reason, and empty files too, which a scan of Spark's leaves out. The driver lists names and sizes only; files go to tasks by bytes, and tasks read them. Filters on `ext` and `length` are
tested on the listing, so files that they rule out are not opened. Writing puts JSON lines into a folder that no reader looks into and renames it
when all tasks are done; a write that fails is removed whole. The folder is a path that driver and executors share.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import Row, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from tessera.sources import loaders

NAME = "tessera_files"
SCHEMA = "doc_id string, content string, title string, source string, format string, records array<string>, record_count int, ext string, length long, reason string"
#: Bytes of files for a task.
TASK_BYTES = 64 * 1024 * 1024


def local(path: str) -> str:
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{NAME} reads shared paths, not {parts.scheme}")
    return os.path.abspath(unquote(parts.path) if parts.scheme else path)


@dataclass
class Files(ds.InputPartition):
    paths: list[tuple[str, str, int]]  # path, extension, length


def listing(folder: str) -> Iterator[tuple[str, str, int]]:
    """Path, lower-case extension and length of the files below a folder, in order; names that begin with _ or . are hidden."""
    for at, folders, files in os.walk(folder):
        folders[:] = sorted(f for f in folders if f[0] not in "_.")
        for name in sorted(f for f in files if f[0] not in "_."):
            yield os.path.join(at, name), os.path.splitext(name)[1][1:].lower(), os.path.getsize(os.path.join(at, name))


_COMPARE: dict[type, Callable[[object, object], bool]] = {
    ds.EqualTo: lambda a, b: a == b, ds.In: lambda a, b: a in b, ds.LessThan: lambda a, b: a < b, ds.LessThanOrEqual: lambda a, b: a <= b, ds.GreaterThan: lambda a, b: a > b, ds.GreaterThanOrEqual: lambda a, b: a >= b
}


class Reader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str], readers: dict[str, loaders.Reader]):
        self.folder, self.readers = local(options["path"]), readers
        self.most_bytes, self.most_chars, self.task_bytes = (int(options.get(k, v)) for k, v in (("most_bytes", loaders.MOST_BYTES), ("most_chars", loaders.MOST_CHARS), ("task_bytes", TASK_BYTES)))
        self.tests: list[tuple[int, Callable, object]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if type(f) in _COMPARE and column in (("ext",), ("length",)):
                self.tests.append((1 if column == ("ext",) else 2, _COMPARE[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        """Neighbouring files of up to `task_bytes` together; files that are too large or of a kind that is not read weigh nothing, as they are not opened."""
        out, held, size = [], [], 0
        for file in listing(self.folder):
            if not all(test(file[at], value) for at, test, value in self.tests):
                continue
            weight = 0 if self.unread(*file[1:]) else file[2]
            if held and (size + weight > self.task_bytes or len(held) >= 10_000):
                out.append(Files(held))
                held, size = [], 0
            held.append(file)
            size += weight
        return [*out, Files(held)]

    def unread(self, ext: str, length: int) -> str | None:
        return "too large" if length > self.most_bytes else "format not read" if ext in loaders.UNREAD and ext not in self.readers else None

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, ext, length in partition.paths:
            text = form = records = None
            reason = self.unread(ext, length)
            if not reason:
                with open(path, "rb") as f:
                    text, form, records, reason = loaders.parsed(ext, f.read(), self.most_chars, self.readers)
            source = f"file:{path}"
            doc_id = hashlib.sha1(f"file:{source}".encode()).hexdigest()
            yield doc_id, text, os.path.splitext(os.path.basename(path))[0], source, form, records, None if records is None else len(records), ext, length, reason


@dataclass
class Written(ds.WriterCommitMessage):
    rows: int
    name: str


class Writer(ds.DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.folder, self.overwrite, self.name = local(options["path"]), overwrite, uuid.uuid4().hex
        self.work = os.path.join(self.folder, f"_work-{self.name}")

    def write(self, iterator: Iterator[Row]) -> Written:
        os.makedirs(self.work, exist_ok=True)
        path, n = os.path.join(self.work, f"part-{uuid.uuid4().hex}"), 0
        try:
            with open(path, "w", encoding="utf-8") as f:  # without an extension until it is whole: a task that is killed leaves a part that is not taken over
                for row in iterator:
                    f.write(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str) + "\n")
                    n += 1
        except BaseException:
            os.remove(path)
            raise
        if n:
            os.rename(path, f"{path}.jsonl")
        else:
            os.remove(path)
        return Written(n, os.path.basename(path))

    def commit(self, messages: list[Written | None]) -> None:
        """Only what the tasks that count have named is taken over; a second attempt of a task leaves nothing."""
        named = {f"{m.name}.jsonl" for m in messages if m and m.rows}
        os.makedirs(self.work, exist_ok=True)
        for name in set(os.listdir(self.work)) - named:
            os.remove(os.path.join(self.work, name))
        old = [f for f in os.listdir(self.folder) if f.startswith("batch-")] if self.overwrite else []
        os.rename(self.work, os.path.join(self.folder, f"batch-{self.name}"))
        for f in old:
            shutil.rmtree(os.path.join(self.folder, f))

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.work, ignore_errors=True)


def register(spark: SparkSession, name: str = NAME, readers: dict[str, loaders.Reader] | None = None) -> None:
    """Makes the format known to a session; `readers` adds or replaces the readers of extensions, as in `loaders.load`. Turns on the filter pushdown of Python sources, which this one needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    own, own_name = dict(readers or {}), name

    class FileDocuments(ds.DataSource):
        @classmethod
        def name(cls) -> str:
            return own_name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: StructType) -> Reader:
            return Reader(dict(self.options), own)

        def writer(self, schema: StructType, overwrite: bool) -> Writer:
            return Writer(dict(self.options), overwrite)

    spark.dataSource.register(FileDocuments)
