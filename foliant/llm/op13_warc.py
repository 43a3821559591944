"""WARC archives: monolithic gzip files become files of one gzip member a record, with a sidecar index of offsets.

Spark's text writer puts records into files that are one gzip stream each (``write_monolithic``), as careless tools do. The
normaliser reads such files (of any origin, in any store that Spark reads) as a stream of lines, in the one task that a gzip
file allows: the stream is inflated once, and at no time is more than one record held. Each record is written as its own member
by way of Arrow's file systems (file, hdfs, s3, gs), below a name that belongs to the task's attempt; the index, a Parquet
table that Spark commits, names the archives that count, so a lost or repeated task leaves no trace in it. ``read_records``
opens archives at the index's offsets and inflates single members.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.grams import frugal
from foliant.scale import read_table, release, shared_dir, ship, sized, stash

#: Payloads of fewer bytes are never replaced by a reference.
MIN_PAYLOAD = 100
#: Records a monolithic file at most, so that files stay of a size that one task inflates.
RECORDS = 20_000
#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "<urn:page:{}>"
DATE = "1970-01-01T00:00:00Z"
LEVEL = 6
INDEX = "archive string, offset long, length long, record_id string, record_type string, source string"
RECORD = "archive string, offset long, record_id string, record_type string, refers_to string, stated_digest string, payload_bytes long, payload_digest string"


def payload_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def with_revisits(df: DataFrame, key: str = "page_id", payload: str = "html", min_bytes: int = MIN_PAYLOAD) -> DataFrame:
    """``df`` with __digest, __bytes and __refers: the least key among the rows of equal payload, where another row has it.

    Short payloads refer to nothing. Rows that share the least key are all responses; rows without a key refer to the least key
    of their payload if there is one, else they are responses.
    """
    t = df.withColumn("__digest", payload_digest(F.col(payload))).withColumn("__bytes", F.coalesce(F.octet_length(payload), F.lit(0)).cast("long"))
    long_ = t.where(F.col("__bytes") >= min_bytes).select("__digest", F.col(key).alias("__key"))
    # Only payloads that occur twice travel on; counts of a hot payload meet as one row a task.
    first = long_.groupBy(F.col("__digest").alias("__d")).agg(F.min("__key").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1 and __first is not null").drop("__n")
    first = sized(stash(first))
    j = t.join(first, t["__digest"] == first["__d"], "left")
    return j.withColumn("__refers", F.when(~F.col("__first").eqNullSafe(F.col(key)), F.col("__first"))).drop("__d", "__first")


def _uri(url: Column) -> Column:
    """A URL fit for a header line: white space and control characters are escaped."""
    return F.regexp_replace(url, r"[\x00-\x20\x7F]", "%20")


def record_text(key: str = "page_id", url: str = "url", payload: str = "html", date: str = DATE) -> Column:
    """A row's record without the two line ends that follow it. A revisit has the payload's headers and digest, not the payload."""
    nl, body = "\r\n", F.coalesce(F.col(payload), F.lit(""))
    name = lambda c: F.format_string(ID.replace("{}", "%s"), F.coalesce(c.cast("string"), F.lit("")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{nl}Content-Type: text/html; charset=utf-8{nl}Content-Length: "), F.col("__bytes").cast("string"), F.lit(nl * 2))
    block = F.when(F.col("__refers").isNull(), F.concat(http, body)).otherwise(http)
    refers = F.concat(F.lit(f"WARC-Profile: {PROFILE}{nl}WARC-Refers-To: "), name(F.col("__refers")), F.lit(nl))
    head = [
        F.lit(f"{VERSION}{nl}WARC-Type: "),
        F.when(F.col("__refers").isNull(), "response").otherwise("revisit"),
        F.lit(f"{nl}WARC-Record-ID: "),
        name(F.col(key)),
        F.lit(f"{nl}WARC-Date: {date}{nl}"),
        F.when(F.col(url).isNotNull(), F.concat(F.lit("WARC-Target-URI: "), _uri(F.col(url)), F.lit(nl))).otherwise(""),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("__digest"), F.lit(nl)),
        F.when(F.col("__refers").isNotNull(), refers).otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{nl}Content-Length: "),
    ]
    return F.concat(*head, F.octet_length(block).cast("string"), F.lit(nl * 2), block)


def write_monolithic(df: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_PAYLOAD) -> None:
    """One record a row, in files that are one gzip stream each."""
    records = with_revisits(df.select(key, url, payload), key, payload, min_bytes).select(record_text(key, url, payload).alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(folder)


def parse_lines(lines):
    """(head, block) of each record in an iterator of lines, which come without their line feeds; at most one record is held.

    What stands between records (empty lines, or the rest of a damaged record) is passed over up to the next version line. A
    record cut short by the end of the file is left out.
    """
    lines = iter(lines)
    for line in lines:
        if not line.startswith(b"WARC/"):
            continue
        head = [line]
        for line in lines:
            if not line.rstrip(b"\r"):
                break
            head.append(line)
        found = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", b"\n".join(head))
        if not found:
            continue
        want, got, block = int(found[1]), 0, []
        while got < want:
            line = next(lines, None)
            if line is None:
                return
            piece = line + b"\n"
            block.append(piece)
            got += len(piece)
        # The last piece may hold the line end that follows the block.
        yield b"".join(x.rstrip(b"\r") + b"\r\n" for x in head) + b"\r\n", b"".join(block)[:want]


def header(head: bytes, name: str) -> str | None:
    """A header's value; names are compared without regard to case, values may go on in indented lines."""
    found = re.search(rb"(?ims)^" + name.encode() + rb":[ \t]*(.*?)[ \t]*\r?\n(?![ \t])", head)
    return re.sub(r"\r?\n[ \t]+", " ", found[1].decode("utf-8", "replace")) if found else None


def member(data: bytes) -> bytes:
    """One gzip member, the same for the same bytes at any time."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _opened(uri: str):
    return arrow_fs.FileSystem.from_uri(uri)


def _rewrite(folder: str):
    """Map from (file, line) in file order to INDEX rows; writes an archive for each file."""

    def run(batches):
        store, root = _opened(folder)
        current: list = [None]  # the file that lines come from
        waiting: list = []

        def feed():
            """Lines of the present file; ends when another file begins."""
            while True:
                if not waiting:
                    b = next(batches, None)
                    if b is None:
                        return
                    waiting.extend(zip(b["file"].to_pylist(), b["line"].to_pylist(), strict=True))
                    waiting.reverse()
                    continue
                if waiting[-1][0] != current[0]:
                    return
                yield waiting.pop()[1]

        out: list[tuple] = []
        while True:
            for _ in feed():  # what follows the last record of a file
                pass
            if not waiting:
                break
            current[0] = waiting[-1][0]
            name = f"{uuid.uuid4().hex}.warc.gz"
            at = 0
            with store.open_output_stream(f"{root}/{name}", compression=None) as sink:
                for head, block in parse_lines(feed()):
                    data = member(head + block + b"\r\n\r\n")
                    sink.write(data)
                    out.append((name, at, len(data), header(head, "WARC-Record-ID"), header(head, "WARC-Type"), current[0]))
                    at += len(data)
                    if len(out) >= 4096:
                        yield _rows(out, INDEX)
                        out = []
        if out:
            yield _rows(out, INDEX)

    return frugal(run)


def _rows(rows: list[tuple], kind: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64()}
    fields = [f.split() for f in kind.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[t]) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])


def normalise(spark: SparkSession, monolithic: str, folder: str) -> DataFrame:
    """Rewrite every file below ``monolithic``: archives in ``folder``/archives, the index in ``folder``/index; returns the index.

    Files that already have a member a record, and plain ones, are read alike. No records, no archives and an empty index.
    """
    ship(spark)
    _opened(folder)[0].create_dir(_opened(folder)[1] + "/archives", recursive=True)
    lines = spark.read.option("lineSep", "\n").text(monolithic).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    lines.mapInArrow(_rewrite(f"{folder}/archives"), INDEX).write.parquet(f"{folder}/index")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _payload(block: bytes, kind: str | None) -> bytes:
    """What follows the HTTP headers; other content types are payload as a whole."""
    return block.partition(b"\r\n\r\n")[2] if (kind or "").startswith("application/http") else block


def _read(folder: str):
    """Map from INDEX rows to RECORD rows: one member each, by its offset."""

    def run(batches):
        store, root = _opened(folder)
        name, source = None, None
        for b in batches:
            out = []
            for archive, offset, length in zip(b["archive"].to_pylist(), b["offset"].to_pylist(), b["length"].to_pylist(), strict=True):
                if archive != name:
                    if source is not None:
                        source.close()
                    name, source = archive, store.open_input_file(f"{root}/{archive}")
                source.seek(offset)
                z = zlib.decompressobj(31)
                data = z.decompress(source.read(length)) + z.flush()
                if not z.eof or z.unused_data:
                    raise ValueError(f"{archive} at {offset}: {length} bytes aren't one gzip member")
                head, _, rest = data.partition(b"\r\n\r\n")
                head += b"\r\n\r\n"
                body = _payload(rest[: int(header(head, "Content-Length"))], header(head, "Content-Type"))
                out.append((archive, offset, header(head, "WARC-Record-ID"), header(head, "WARC-Type"), header(head, "WARC-Refers-To"), header(head, "WARC-Payload-Digest"), len(body), hashlib.sha256(body).hexdigest()))
            yield _rows(out, RECORD)
        if source is not None:
            source.close()

    return frugal(run)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """RECORD rows of the records that ``index`` names (all, or those that a filter left); payload figures are of what is stored."""
    ship(index.sparkSession)
    return index.select("archive", "offset", "length").mapInArrow(_read(f"{folder}/archives"), RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with payload_bytes and payload_digest of the full payload: revisits take those of the record they refer to."""
    full = records.where("record_type <> 'revisit'")
    wanted = records.where("record_type = 'revisit'").select(F.col("refers_to").alias("__id")).distinct()
    # Records that share an id have the payload that the revisit states; see with_revisits.
    target = full.join(wanted, full["record_id"] == wanted["__id"], "left_semi").select(F.col("record_id").alias("__to"), F.concat(F.lit("sha256:"), "payload_digest").alias("__stated"), F.col("payload_bytes").alias("__bytes"), F.col("payload_digest").alias("__digest")).distinct()
    target = sized(stash(target))
    j = records.join(target, (records["refers_to"] == target["__to"]) & (records["stated_digest"] == target["__stated"]), "left")
    mine = F.col("record_type") == "revisit"
    return j.withColumn("payload_bytes", F.when(mine, F.col("__bytes")).otherwise(F.col("payload_bytes"))).withColumn("payload_digest", F.when(mine, F.col("__digest")).otherwise(F.col("payload_digest"))).drop("__to", "__stated", "__bytes", "__digest")


def page_of(record_id: Column) -> Column:
    """The page id in a record id; null for a row without one."""
    return F.regexp_extract(record_id, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def archive_pages(df: DataFrame, folder: str, **names) -> DataFrame:
    """Write ``df`` to monolithic files, normalise them, and return the index; the monolithic files go.

    Null payloads are empty, null URLs have no header line, null keys an empty id; repeated rows give a record each; very long
    payloads are records like any other; an empty table gives an empty index. Columns other than the three named aren't read.
    """
    spark = df.sparkSession
    write_monolithic(df, f"{folder}/monolithic", **names)
    index = normalise(spark, f"{folder}/monolithic", folder)
    release(spark, [f"{folder}/monolithic"])
    return index


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    index = archive_pages(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    read = stash(read_records(index, folder))
    release(spark, [folder])
    records = resolved(read)
    return records.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))
