"""A data source over folders of ZIP archives that hold one CSV file each, named PAIR-KIND-DAY.zip.

The option keep (ranges of days by pair) decides from the names which archives are opened at all; days may also be folders,
and folders of other days are not even listed.  Of the opened ones, only the columns of the schema that was asked for are parsed.
Archives are read by range: a scan streams the member, a scan of heads inflates its first lines and stops.

Ranges are an option and not filters that the source takes over (pushFilters): Spark 4.1 remembers taken filters with the table and not with
the scan, so that a frame used once with and once without a filter reads the same archives both times.
"""

from __future__ import annotations

import datetime as dt
import io
import json
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.csv
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "vigil_zip_csv"
HEAD = "file string, pair string, day date, headed boolean, first array<string>"
#: Bytes of archives in a partition; bytes that each archive counts at least; bytes of CSV parsed at once.
PARTITION_BYTES, OPEN_BYTES, BLOCK = 32 << 20, 1 << 20, 4 << 20
_NAME = re.compile(r"(?P<pair>[^/]+?)-[^/]*?(?P<day>\d{4}-\d{2}-\d{2})?\.zip$")
_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")
#: Schemes that pyarrow knows under another name.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and host that Hadoop would take it to have."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str] | None:
    """The store and the path in it, or None where pyarrow does not know the store."""
    scheme, _, rest = uri.partition(":")
    rest = "//" + rest if scheme == "file" and not rest.startswith("//") else rest  # Hadoop writes file:/a
    try:
        return pyarrow.fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")
    except (pa.ArrowInvalid, OSError, ValueError):
        return None


def pair_and_day(path: str) -> tuple[str | None, dt.date | None]:
    """What an archive's name says; a name without a date has none."""
    name = _NAME.search("/" + path)
    if not name:
        return None, None
    return name["pair"].lstrip("/"), dt.date.fromisoformat(name["day"]) if name["day"] else None


def looks_numeric(token: bytes) -> bool:
    try:
        float(token)
    except ValueError:
        return False
    return True


def _member(name: str, archive: zipfile.ZipFile) -> str:
    if len(inside := archive.namelist()) != 1:
        raise ValueError(f"{name} has {len(inside)} members")
    return inside[0]


def head(name: str, file) -> tuple[bool, list[str]]:
    """Whether the first line is a header, and the fields of the first record; no more than the lines up to it are inflated."""
    with zipfile.ZipFile(file) as archive, archive.open(_member(name, archive)) as raw:
        first = raw.readline()
        headed = bool(first.strip()) and not looks_numeric(first.split(b",", 1)[0].strip())
        record = raw.readline() if headed else first
    text = record.decode("utf-8", "replace").strip()
    return headed, text.split(",") if text else []


def rows(name: str, file, columns: tuple[str, ...], wanted: list[str]) -> Iterator[pa.RecordBatch]:
    """The wanted columns of an archive, as text, batch by batch.

    Columns are named by place.  Only the first line may be a header: it is one if its first field is no number.  A line
    with another number of fields ends the job, wherever it stands.
    """
    with zipfile.ZipFile(file) as archive:
        member = _member(name, archive)
        with archive.open(member) as raw:
            line = raw.readline()
            headed = not looks_numeric(line.split(b",", 1)[0].strip())
            while line and not line.strip():
                line = raw.readline()
                headed = bool(line) and not looks_numeric(line.split(b",", 1)[0].strip())
            if not line or headed and not _any(raw):
                return
        wrong: list[int] = []

        def other(row) -> str:
            wrong.append(row.actual_columns)
            return "error"

        with archive.open(member) as raw:
            if headed:
                while not raw.readline().strip():
                    pass
            try:
                yield from pyarrow.csv.open_csv(
                    raw,
                    pyarrow.csv.ReadOptions(column_names=list(columns), block_size=BLOCK, use_threads=False),
                    pyarrow.csv.ParseOptions(invalid_row_handler=other),
                    pyarrow.csv.ConvertOptions(column_types=dict.fromkeys(columns, pa.string()), include_columns=wanted or [columns[0]], strings_can_be_null=False),
                )
            except pa.ArrowInvalid as error:
                raise ValueError(f"{name} has a line of {wrong[0]} fields" if wrong else f"{name}: {error}") from error


def _any(raw) -> bool:
    return any(line.strip() for line in iter(raw.readline, b""))


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.uri, self.columns = options["path"], tuple(c for c in options.get("columns", "").split(",") if c)
        self.fields, self.bytes = schema.names, int(options.get("partitionbytes", PARTITION_BYTES))
        self.keep = kept(options.get("keep"))

    def wanted(self, pair: str | None, day: dt.date | None) -> bool:
        return self.keep is None or day is not None and any(a <= day <= b for a, b in self.keep.get(pair, ()))

    def _found(self, store: pyarrow.fs.FileSystem, folder: str) -> Iterator[pyarrow.fs.FileInfo]:
        """Archives below a folder, without those in folders of days that are not wanted."""
        ranges = {r for own in (self.keep or {}).values() for r in own}
        for info in sorted(store.get_file_info(pyarrow.fs.FileSelector(folder)), key=lambda i: i.path):
            if info.type == pyarrow.fs.FileType.Directory:
                if not _DAY.fullmatch(info.base_name) or self.keep is None or any(a <= dt.date.fromisoformat(info.base_name) <= b for a, b in ranges):
                    yield from self._found(store, info.path)
            elif info.path.endswith(".zip"):
                yield info

    def partitions(self) -> list[_Files]:
        """The wanted archives in the order of their paths, several small ones together."""
        store, root = file_system(self.uri)
        info = store.get_file_info(root)
        if info.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(self.uri)
        out, size = [], 0
        for found in [info] if info.type == pyarrow.fs.FileType.File else self._found(store, root):
            if self.wanted(*pair_and_day(found.path)):
                if not out or size + max(found.size, OPEN_BYTES) > self.bytes:
                    out.append(_Files([]))
                    size = 0
                out[-1].paths.append(found.path)
                size += max(found.size, OPEN_BYTES)
        return out or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(self.uri)
        for path in partition.paths:
            with store.open_input_file(path) as file:
                yield from self.archive(path, file)

    def archive(self, path: str, file) -> Iterator[pa.RecordBatch]:
        pair, day = pair_and_day(path)
        same, seq = {"file": path, "pair": pair, "day": day}, 0
        if not self.columns:
            headed, first = head(path, file)
            yield self._batch(same, {"headed": pa.array([headed]), "first": pa.array([first], pa.list_(pa.string()))}, 1)
            return
        for batch in rows(path, file, self.columns, [c for c in self.columns if c in self.fields]):
            own = {"seq": pa.array(range(seq, seq + batch.num_rows), pa.int64()), **dict(zip(batch.schema.names, batch.columns, strict=True))}
            yield self._batch(same, own, batch.num_rows)
            seq += batch.num_rows

    def _batch(self, same: dict, own: dict, n: int) -> pa.RecordBatch:
        types = {"file": pa.string(), "pair": pa.string(), "day": pa.date32()}
        arrays = [own[c] if c in own else pa.repeat(pa.scalar(same[c], types[c]), n) for c in self.fields]
        return pa.RecordBatch.from_arrays(arrays, names=self.fields)


def kept(text: str | None) -> dict[str, list[tuple[dt.date, dt.date]]] | None:
    """Ranges of days by pair from the JSON list of (pair, first day, last day); None if there is no list."""
    if text is None:
        return None
    out: dict[str, list[tuple[dt.date, dt.date]]] = {}
    for pair, first, last in json.loads(text):
        out.setdefault(pair, []).append((dt.date.fromisoformat(first), dt.date.fromisoformat(last)))
    return out


class ZipCsv(DataSource):
    """format("vigil_zip_csv"): options path, keep, and columns (names by place), without which it gives heads."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        columns = [c for c in self.options.get("columns", "").split(",") if c]
        return "file string, seq long, pair string, day date, " + ", ".join(f"`{c}` string" for c in columns) if columns else HEAD

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(dict(self.options), schema)


def from_content(columns: str, schema: StructType):
    """The same over rows (path, content) of Spark's own reader of files, for stores that only Hadoop knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ArchiveReader({"path": "", "columns": columns}, schema)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                yield from reader.archive(path, io.BytesIO(content))

    return run
