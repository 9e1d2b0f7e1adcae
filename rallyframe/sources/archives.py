"""Annotation archives as a data source: ZIP files of CSV members, planned member by member.

Planning reads the archives' central directories alone. A member's name tells its match and rally, so these and the
name decide which members are read at all; small members share a task up to `partitionBytes`, and a member is
decompressed as a stream, in batches. Neither an archive nor a member is held whole.

    archives.annotations(spark, "data/*.zip", matches=[3], columns=("frame", "x", "y"))

Keys and columns are options and not pushed filters: Spark 4.1 keeps the plan of a pushed filter for later queries
over the same DataFrame, which then lack rows.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import math
import re
import zipfile
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

# How members are named, by convention, and the columns of their rows.
CONVENTIONS = {"plain": r"(\d+)_csv_(\d+)\.csv", "endpoint": r"(\d+)_endpoint_csv_(\d+)\.csv"}
COLUMNS = {"frame": "bigint", "visibility": "int", "x": "double", "y": "double", "theta": "double", "l": "double"}
KEYS = {"archive": "string", "member": "string", "match_id": "bigint", "rally_id": "bigint"}
TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
BATCH_ROWS = 8192


def _number(text: str | None) -> float | None:
    try:
        value = float(text) if text is not None else math.nan
    except ValueError:
        return None
    return value if math.isfinite(value) else None


@dataclass(frozen=True)
class Member:
    archive: str
    member: str
    match_id: int
    rally_id: int
    size: int


@dataclass
class Part(ds.InputPartition):
    """Members of one archive that a task reads one after the other."""

    members: list[Member]


def _opened(uri: str) -> Any:
    system, path = pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)
    return system.open_input_file(path)


def listed(path: str) -> list[str]:
    """The archives of a path: a file, a folder's ZIP files, or names with * and ? in the last part."""
    system, plain = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    prefix = path[: len(path) - len(plain)]
    folder, _, name = plain.rpartition("/")
    if any(c in name for c in "*?["):
        found = [f.path for f in system.get_file_info(pafs.FileSelector(folder or ".")) if fnmatch.fnmatch(f.base_name, name)]
    elif system.get_file_info(plain).type == pafs.FileType.Directory:
        found = [f.path for f in system.get_file_info(pafs.FileSelector(plain)) if f.base_name.lower().endswith(".zip")]
    else:
        found = [plain]
    if not found:
        raise FileNotFoundError(f"no archive at {path}")
    return sorted(prefix + f for f in found)


def planned(archive: str, convention: str) -> list[Member]:
    """The members whose name fits; of several with one key the last in the directory counts."""
    pattern = re.compile(CONVENTIONS[convention], re.IGNORECASE)
    found = {}
    with _opened(archive) as file, zipfile.ZipFile(file) as z:
        for info in z.infolist():
            if not info.is_dir() and (m := pattern.fullmatch(info.filename.rpartition("/")[2])):
                key = int(m[1]), int(m[2])
                found.pop(key, None)
                found[key] = Member(archive, info.filename, *key, info.file_size)
    return list(found.values())


class ArchiveReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]):
        self.path, self.convention = options["path"], options.get("convention", "plain")
        if self.convention not in CONVENTIONS:
            raise ValueError(f"convention must be one of {', '.join(CONVENTIONS)}")
        self.partition_bytes = int(options.get("partitionbytes", 4 << 20))
        self.names = names
        numbers = lambda name: {int(n) for n in options[name].split(",") if n} if name in options else None
        self.matches, self.rallies, self.member = numbers("match_id"), numbers("rally_id"), options.get("member", "*")

    def _wanted(self, m: Member) -> bool:
        known = (self.matches is None or m.match_id in self.matches) and (self.rallies is None or m.rally_id in self.rallies)
        return known and fnmatch.fnmatchcase(m.member, self.member)

    def partitions(self) -> list[Part]:
        parts: list[Part] = []
        archives = listed(self.path)
        with ThreadPoolExecutor(16) as pool:
            found = pool.map(lambda a: planned(a, self.convention), archives)
        for members in found:
            held = 0
            for m in members:
                if self._wanted(m):
                    if not held or held + m.size > self.partition_bytes:
                        parts.append(Part([]))
                        held = 0
                    parts[-1].members.append(m)
                    held += max(m.size, 1)
        return parts or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        for member in partition.members:
            with _opened(member.archive) as file, zipfile.ZipFile(file) as z, z.open(member.member) as raw:
                yield from self._batches(member, io.TextIOWrapper(raw, "utf-8-sig", newline=""))

    def _batches(self, member: Member, text: io.TextIOBase) -> Iterator[pa.RecordBatch]:
        reader = csv.DictReader(text)
        heads = {(h or "").strip().lower(): h for h in reader.fieldnames or ()}
        seen: set[int] = set()
        kinds = {n: (KEYS | COLUMNS)[n] for n in self.names}
        rows: list[list[Any]] = []

        def batch() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, TYPES[k]) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

        for source in reader:
            row = {c: _number(source.get(heads.get(c, ""))) for c in COLUMNS}
            if row["frame"] is None or row["visibility"] not in (0, 1):
                raise ValueError(f"invalid annotation in {member.archive}: {member.member}, line {reader.line_num}")
            row["frame"], row["visibility"] = int(row["frame"]), int(row["visibility"])
            if row["frame"] in seen:
                raise ValueError(f"repeated frame {row['frame']} in {member.archive}: {member.member}")
            seen.add(row["frame"])
            rows.append([row[n] if n in COLUMNS else getattr(member, n) for n in self.names])
            if len(rows) >= BATCH_ROWS:
                yield batch()
                rows.clear()
        if rows:
            yield batch()


class AnnotationArchives(ds.DataSource):
    """Options: `path`; `convention`, plain or endpoint; `match_id` and `rally_id`, comma-separated numbers; `member`,
    a pattern with * and ?; `columns`, comma-separated; `partitionBytes`, the uncompressed bytes of the members that
    share a task. What isn't given is everything."""

    @classmethod
    def name(cls) -> str:
        return "annotation_archives"

    def _names(self) -> list[str]:
        known = KEYS | COLUMNS
        names = [c.strip() for c in self.options.get("columns", ",".join(known)).split(",")]
        if missing := [n for n in names if n not in known]:
            raise ValueError(f"unknown columns: {', '.join(missing)}")
        return names

    def schema(self) -> str:
        return ", ".join(f"{n} {(KEYS | COLUMNS)[n]}" for n in self._names())

    def reader(self, schema: Any) -> ds.DataSourceReader:
        return ArchiveReader({k.lower(): v for k, v in dict(self.options).items()}, self._names())


def annotations(spark: SparkSession, path: str, convention: str = "plain", matches: Iterable[int] | None = None, rallies: Iterable[int] | None = None, member: str = "*", columns: tuple[str, ...] = (), partition_bytes: int = 4 << 20) -> DataFrame:
    """Rows of the wanted members of the archives at a path, local or of a store that Arrow knows. A row without a
    frame or with another visibility than 0 or 1, and a frame that a member repeats, are errors."""
    spark.dataSource.register(AnnotationArchives)
    options = {"convention": convention, "member": member, "partitionBytes": str(partition_bytes)}
    for name, values in (("match_id", matches), ("rally_id", rallies)):
        if values is not None:
            options[name] = ",".join(map(str, values))
    if columns:
        options["columns"] = ",".join(columns)
    return spark.read.format("annotation_archives").options(**options).load(path)
