"""Folders and tables as file DataFrames, and the registry of sources."""

from __future__ import annotations

import logging
import os
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from functools import reduce

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.paths import SUPPORTED, basename, excluded, extension
from foliant.scale import ship
from foliant.sources.parsing import parse_file, title_of

log = logging.getLogger(__name__)

FILE_COLUMNS = ("file_path", "file_name", "file_extension", "file_size", "md5_hash", "modified_time", "title", "source", "content")


@dataclass
class Source:
    path: str
    exclude_rules: list[str] = field(default_factory=list)
    enabled: bool = True


class SourceList:
    """Ordered sources, one a path."""

    def __init__(self, sources: list[Source] = ()):
        self.items: list[Source] = []
        for s in sources:
            self.add(s)

    def add(self, source: Source) -> None:
        source.path = os.path.abspath(source.path)
        old = self.get(source.path)
        if old:
            self.items[self.items.index(old)] = source
        else:
            self.items.append(source)

    def get(self, path: str) -> Source | None:
        return next((s for s in self.items if s.path == os.path.abspath(path)), None)

    def remove(self, path: str) -> bool:
        found = self.get(path)
        if found:
            self.items.remove(found)
        return found is not None

    def update(self, path: str, **changes) -> bool:
        found = self.get(path)
        for k, v in changes.items() if found else ():
            setattr(found, k, v)
        return found is not None

    def enabled(self) -> list[Source]:
        return [s for s in self.items if s.enabled]

    def current(self) -> Source | None:
        return next(iter(self.enabled() or self.items), None)

    def all_excludes(self) -> list[str]:
        return [r for s in self.enabled() for r in s.exclude_rules]

    def to_dicts(self) -> list[dict]:
        return [asdict(s) for s in self.items]

    @classmethod
    def from_dicts(cls, rows: list[dict]) -> SourceList:
        names = Source.__dataclass_fields__
        return cls([Source(**{k: v for k, v in r.items() if k in names}) for r in rows if r.get("path")])

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(s.path, s.exclude_rules, s.enabled, i) for i, s in enumerate(self.items)]
        return spark.createDataFrame(rows, "source string, exclude_rules array<string>, enabled boolean, ord int")


def list_directory(spark: SparkSession, directory: str, exclude: list[str] = ()) -> DataFrame:
    """(file_path, file_name, file_extension, file_size, modified_time, source) of the supported files below a folder; no file
    is opened. Rules exclude while listing. Missing folder: raises."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    return _described(raw.select("path", "length", "modificationTime"), directory, exclude)


def _described(raw: DataFrame, directory: str, exclude: list[str]) -> DataFrame:
    path = F.regexp_replace("path", "^file:/*", "/")
    t = raw.withColumn("file_path", path).withColumn("file_name", basename(F.col("file_path"))).withColumn("file_extension", extension(F.col("file_name")))
    t = t.where(F.col("file_extension").isin(*SUPPORTED)).where(~excluded(F.col("file_path"), directory, list(exclude)))
    rest = [c for c in raw.columns if c not in ("path", "length", "modificationTime")]
    return t.select("file_path", "file_name", "file_extension", F.col("length").alias("file_size"), F.col("modificationTime").alias("modified_time"), F.lit(directory).alias("source"), *rest)


def with_hash_and_title(files: DataFrame) -> DataFrame:
    """``files`` with content: adds md5_hash, and the title from the first 64 Ki characters."""
    text = F.when(~F.col("file_extension").isin(".pdf", ".docx"), F.decode("content", "UTF-8"))
    return files.withColumn("md5_hash", F.md5("content")).withColumn("title", title_of(F.substring(text, 1, 1 << 16), F.col("file_extension"), F.col("file_name")))


def scan_directory(spark: SparkSession, directory: str, exclude: list[str] = (), with_content: bool = True) -> DataFrame:
    """Files of the supported kinds below a folder, with hash and title; rules exclude while listing. Missing folder: raises."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    t = with_hash_and_title(_described(raw.select("path", "length", "modificationTime", "content"), directory, exclude))
    return t.select(*[c for c in FILE_COLUMNS if with_content or c != "content"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["content", "read_size", "read_time", "read_error"]
    for b in batches:
        for i, path in enumerate(b["file_path"].to_pylist()):
            try:
                store, at = arrow_fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as f:
                    content, error = f.read(), None
                found = store.get_file_info(at)
                size, modified = found.size, found.mtime
            except OSError as e:  # gone or unreadable: told in the row
                content, error, size, modified = None, f"{type(e).__name__}: {e}", None, None
            read = [pa.array([content], pa.binary()), pa.array([size], pa.int64()), pa.array([modified], pa.timestamp("us", "UTC")), pa.array([error], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.slice(i, 1).columns, *read], [*b.schema.names, *names])


def read_contents(files: DataFrame) -> DataFrame:
    """``files`` with content, read_size, read_time and read_error of the file that ``file_path`` names, each opened once by the
    task that holds its row, which holds one file at a time; nothing else is listed or read."""
    ship(files.sparkSession)
    more = T.StructType.fromDDL("content binary, read_size long, read_time timestamp, read_error string")
    return files.mapInArrow(_read, T.StructType([*files.schema.fields, *more.fields]))


def scan_sources(spark: SparkSession, sources: SourceList, scan=scan_directory) -> tuple[DataFrame | None, list[dict]]:
    """All enabled sources in one frame, and the errors of those that can't be read; ``scan`` may be ``list_directory``."""
    frames, errors = [], []
    for s in sources.enabled():
        try:
            frames.append(scan(spark, s.path, s.exclude_rules))
        except AnalysisException as e:
            errors.append({"source": s.path, "error": str(e).split("\n")[0]})
    return (reduce(DataFrame.unionByName, frames) if frames else None), errors


def read_text(spark: SparkSession, path: str) -> str:
    """A file's whole text: paragraphs of PDF and Word files one a line, others decoded; empty if it can't be read."""
    suffix = os.path.splitext(path)[1].lower()
    try:
        content = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
        return "\n".join(p.content for p in parse_file(suffix, content)) if suffix in (".pdf", ".docx") else content.decode("utf-8", "ignore")
    except Exception as e:  # whatever a reader or parser raises, the caller gets an empty text
        log.warning("%s can't be read: %s", path, e)
        return ""


def documents_as_files(documents: DataFrame) -> DataFrame:
    """The documents table as files: /source/lang/doc_id.txt, hash of the text as content hash."""
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return documents.select(path.alias("file_path"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), F.lit(".txt").alias("file_extension"), F.octet_length("text").cast("long").alias("file_size"), F.md5(F.encode("text", "UTF-8")).alias("md5_hash"), F.concat(F.lit("/"), "source").alias("source"), "doc_id", "text")


def with_metadata(df: DataFrame) -> DataFrame:
    return df.select("file_path", "file_name", "file_extension", "file_size", "md5_hash", "source")
