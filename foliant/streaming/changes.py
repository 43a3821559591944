"""File changes as a stream: a Python data source whose offsets are numbered listings of a folder.

A listing (path, size, modification time) is stored below the ``state`` folder only when it differs from the last; an offset is
its number. The rows between two offsets are the difference of two stored listings: created, edited and deleted files, a renamed
one as deleted and created. So a batch that is run again gives the same rows, and a restarted query goes on from its checkpoint
and sees what happened meanwhile. Listings before the committed offset are deleted. Contents are never read.
"""

from __future__ import annotations

import time
import uuid
import zlib
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from foliant.scale import ship

#: Parts of a listing: the tasks that compare it with the next.
PARTS = 8
SCHEMA = "path string, change string, size long, ts timestamp"
_LISTING = pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified", pa.int64())])


class Part(InputPartition):
    def __init__(self, start: int, end: int, part: int):
        self.start, self.end, self.part = start, end, part


class FolderReader(DataSourceStreamReader):
    def __init__(self, folder: str, state: str, parts: int):
        self.folder, self.state, self.parts = folder, state, parts
        self._last: dict[str, tuple[int, int]] | None = None
        self._version = 0

    def _store(self) -> tuple[arrow_fs.FileSystem, str]:
        return arrow_fs.FileSystem.from_uri(self.state)

    def _listings(self) -> list[int]:
        store, root = self._store()
        found = store.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True))
        return sorted(int(f.base_name[8:]) for f in found if f.base_name.startswith("listing-"))

    def _load(self, version: int, part: int) -> dict[str, tuple[int, int]]:
        """A part of a stored listing; version 0 is the empty one."""
        store, root = self._store()
        at = f"{root}/listing-{version}/{part}.parquet"
        if not version or store.get_file_info(at).type == arrow_fs.FileType.NotFound:
            return {}
        with store.open_input_file(at) as f:
            t = pq.read_table(f)
        return dict(zip(t["path"].to_pylist(), zip(t["size"].to_pylist(), t["modified"].to_pylist(), strict=True), strict=True))

    def _list(self) -> dict[str, tuple[int, int]]:
        source, root = arrow_fs.FileSystem.from_uri(self.folder)
        found = source.get_file_info(arrow_fs.FileSelector(root, recursive=True, allow_not_found=True))
        return {f.path: (f.size, f.mtime_ns or 0) for f in found if f.type == arrow_fs.FileType.File}

    def _save(self, version: int, files: dict[str, tuple[int, int]]) -> None:
        """Written under another name and moved, so that a listing is there as a whole or not at all."""
        store, root = self._store()
        temp = f"{root}/_{uuid.uuid4().hex}"
        store.create_dir(temp, recursive=True)
        parts: dict[int, list] = {}
        for path, (size, modified) in files.items():
            parts.setdefault(zlib.crc32(path.encode("utf-8", "surrogateescape")) % self.parts, []).append((path, size, modified))
        for k, rows in parts.items():
            with store.open_output_stream(f"{temp}/{k}.parquet") as f:
                pq.write_table(pa.table([list(x) for x in zip(*rows, strict=True)], _LISTING), f)
        with store.open_output_stream(f"{temp}/seen") as f:
            f.write(str(time.time()).encode())
        store.move(temp, f"{root}/listing-{version}")

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        if self._last is None:
            self._version = max(self._listings(), default=0)
            self._last = {k: v for p in range(self.parts) for k, v in self._load(self._version, p).items()}
        now = self._list()
        if now != self._last:
            self._save(self._version + 1, now)
            self._version, self._last = self._version + 1, now
        return {"version": self._version}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(start["version"], end["version"], p) for p in range(self.parts)] if start != end else []

    def read(self, partition: Part):
        old, new = self._load(partition.start, partition.part), self._load(partition.end, partition.part)
        store, root = self._store()
        with store.open_input_stream(f"{root}/listing-{partition.end}/seen") as f:
            seen = datetime.fromtimestamp(float(f.read()), UTC)
        for path, (size, modified) in new.items():
            if old.get(path) != (size, modified):
                yield path, "edited" if path in old else "created", size, datetime.fromtimestamp(modified / 1e9, UTC)
        for path in old.keys() - new.keys():
            yield path, "deleted", None, seen

    def commit(self, end: dict) -> None:
        store, root = self._store()
        for v in self._listings():
            if v < end["version"]:
                store.delete_dir(f"{root}/listing-{v}")


class FolderChanges(DataSource):
    """Format ``folder_changes``: options path (folder), state (folder for the listings, one for each query) and parts."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"], self.options["state"], int(self.options.get("parts", PARTS)))


def changes(spark: SparkSession, folder: str, state: str, parts: int = PARTS) -> DataFrame:
    """Streaming (path, change, size, ts) of a folder's files, at any depth; the first listing's files are all created.

    A missing folder is an empty one. Of several changes between two listings the last state counts. An edit that leaves size
    and modification time as they were isn't seen.
    """
    ship(spark)
    spark.dataSource.register(FolderChanges)
    return spark.readStream.format("folder_changes").option("path", folder).option("state", state).option("parts", parts).load()
