"""The index as Parquet tables in segments: a change writes what changed, one batch job a sync.

Layout below the root: segment-<version>-<id>/<table>/, manifest-<version>.json and snapshot-<name>.json. A segment holds the rows
of the files that a change brought, and in ``gone`` the paths whose rows in earlier segments no longer count. Small segments are
merged as they pile up. User state (own tags, stars, clusters) is kept apart and survives reindexing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import lexical
from foliant.operators.search import Engine
from foliant.operators.tags import add_tags, keyword_tags, tags_of
from foliant.operators.vectors import Embedder, embed
from foliant.scale import scratch, sized, stash
from foliant.sources.parsing import CHUNK, ChunkConfig, chunk_files, explode_chunks
from foliant.sources.scan import SourceList, list_directory, read_contents, scan_sources, with_hash_and_title

#: Columns of the stored tables. n_lex and tokens of a file are the number and the summed length of its chunks with a token.
FILE = "file_path string, file_name string, file_extension string, file_size long, md5_hash string, modified_time timestamp, title string, source string, error string, chunk_count int, n_lex long, tokens long"
TABLES = {
    "files": FILE,
    "chunks": CHUNK,
    "postings": "id string, dl int, term string, tf long, file_path string",
    "auto_tags": "file_path string, tag string, ord int",
    "seen": "file_path string, file_size long, modified_time timestamp",
    "gone": "file_path string",
}
META = ("file_path", "file_name", "file_extension", "file_size", "md5_hash", "modified_time", "title", "source", "change")
#: Segments at the end that are merged together: at least so many, each no larger than all after it; and the most segments.
MERGE, MOST = 4, 16
#: Rows of ``gone`` up to which they are broadcast: paths, some 16 MB.
GONE_ROWS = 100_000
#: Bytes of files that a task opens, one at a time.
READ_BYTES = 64 << 20
#: Errors that a sync returns one by one; all are in the files table.
ERRORS = 1000
EMPTY = {"version": 0, "embedding_dim": None, "model": None, "n": 0, "dl": 0, "segments": []}


def diff(scan: DataFrame, indexed: DataFrame) -> DataFrame:
    """``scan`` with change: new, updated or unchanged, by path and content hash."""
    old = indexed.select("file_path", F.col("md5_hash").alias("__old"))
    change = F.when(F.col("__old").isNull(), "new").when(F.col("__old") == F.col("md5_hash"), "unchanged").otherwise("updated")
    return scan.join(old, "file_path", "left").withColumn("change", change).drop("__old")


def orphans(scan: DataFrame, indexed: DataFrame) -> DataFrame:
    return indexed.join(scan.select("file_path"), "file_path", "left_anti")


@dataclass
class Index:
    """A versioned index below ``root``.

    A manifest, written under another name and renamed into place, lists the segments and the statistics of keyword scores, so
    readers see all of a change or nothing, also after a crash. Segments that neither of the last two manifests nor a snapshot
    names are deleted.
    """

    spark: SparkSession
    root: str
    embedder: Embedder | None = None
    config: ChunkConfig = ChunkConfig()
    #: Called as progress(done, total, what) at each step of a change.
    progress: Callable[[int, int, str], None] | None = None

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, pattern: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self._fs().globStatus(self._path(pattern)) or [])

    def _read(self, name: str) -> dict:
        stream = self._fs().open(self._path(name))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, name: str, info: dict) -> bool:
        """Write a small file as a whole; False if it is there already."""
        fs, temp, at = self._fs(), self._path(f"_{uuid.uuid4().hex}.new"), self._path(name)
        out = fs.create(temp, True)
        out.write(bytearray(json.dumps(info).encode()))
        out.close()
        if fs.exists(at) or not fs.rename(temp, at):
            fs.delete(temp, False)
            return False
        return True

    def info(self) -> dict:
        """The current manifest: version, embedding_dim, model, n and dl (chunks with a token, and their tokens), segments."""
        found = self._names("manifest-*.json")
        return self._read(found[-1]) if found else dict(EMPTY)

    def _commit(self, info: dict) -> None:
        if not self._put(f"manifest-{info['version']:010d}.json", info):
            raise RuntimeError(f"version {info['version']} was committed by another writer")
        self._clean()

    def _clean(self) -> None:
        """Delete manifests before the last two, and segments that neither of these nor a snapshot names."""
        fs, manifests = self._fs(), self._names("manifest-*.json")
        for old in manifests[:-2]:
            fs.delete(self._path(old), False)
        used = {s["folder"] for m in (*manifests[-2:], *self._names("snapshot-*.json")) for s in self._read(m)["segments"]}
        for folder in set(self._names("segment-*")) - used:
            fs.delete(self._path(folder), True)

    def _kind(self, name: str, info: dict) -> str:
        return TABLES[name] + (", embedding array<float>" if name == "chunks" and info["embedding_dim"] else "")

    def table(self, name: str, info: dict | None = None, segments: list[dict] | None = None) -> DataFrame | None:
        """The rows that count, in the version ``info`` (the current one); None before the first version.

        A row counts unless its path is gone since its segment. Filters reach the scans: a term's postings are read, not all.
        """
        info = info or self.info()
        segments = info["segments"] if segments is None else segments
        if not segments:
            return None
        read = lambda t, i, s: self.spark.read.schema(self._kind(t, info)).parquet(f"{self.root}/{s['folder']}/{t}").withColumn("__at", F.lit(i))
        rows = reduce(DataFrame.unionByName, [read(name, i, s) for i, s in enumerate(segments)])
        lost = [(i, s) for i, s in enumerate(segments) if i and s["gone"]]
        if lost:
            gone = reduce(DataFrame.unionByName, [read("gone", i, s) for i, s in lost]).groupBy("file_path").agg(F.max("__at").alias("__gone"))
            gone = F.broadcast(gone) if sum(s["gone"] for _, s in lost) <= GONE_ROWS else gone
            rows = rows.join(gone, "file_path", "left").where("__gone is null or __at >= __gone").drop("__gone")
        if name == "seen":
            rows = rows.groupBy("file_path").agg(F.max_by(F.struct("file_size", "modified_time"), "__at").alias("s")).select("file_path", "s.*", F.lit(0).alias("__at"))
        return rows.drop("__at")

    def stats(self, info: dict | None = None) -> DataFrame:
        """One row (n, avgdl) for keyword scores, from the manifest."""
        info = info or self.info()
        return self.spark.createDataFrame([(info["n"], info["dl"] / info["n"] if info["n"] else 0.0)], "n long, avgdl double")

    def stale(self, embedder: Embedder) -> bool:
        """The stored vectors are of another dimension than the embedder's, or of another model where both have a name."""
        info = self.info()
        dim, model, name = info["embedding_dim"], info["model"], getattr(embedder, "name", None)
        return dim is not None and (dim != embedder.dim or bool(model and name and model != name))

    def _tell(self, done: int, total: int, what: str) -> None:
        if self.progress is not None:
            self.progress(done, total, what)

    def sync(self, sources: SourceList, incremental: bool = True, retry_failed: bool = False) -> dict:
        """Bring the index to what the enabled sources hold. Returns the counts by change.

        Folders are listed; only files whose size or time is not as last seen are opened, each once, and only those whose hash
        differs are parsed. An edit that leaves size and time as they were isn't seen; ``incremental=False`` opens all files.
        Files that failed are opened again when they change, or with ``retry_failed``.
        """
        listing, errors = scan_sources(self.spark, sources, list_directory)
        stats = {"new": 0, "updated": 0, "unchanged": 0, "removed": 0, "errors": errors, "sources": len(sources.enabled())}
        if listing is None:
            return stats
        self._tell(0, 3, "scan")
        info = self.info()
        info, gone = self.info(), None
        listing = listing.dropDuplicates(["file_path"])  # a source may lie below another
        with scratch(self.spark):
            if info["segments"]:
                seen = self.table("seen", info)
                s = seen.select("file_path", F.col("file_size").alias("__size"), F.col("modified_time").alias("__time"))
                if retry_failed:
                    s = s.join(self.table("files", info).where("error is not null").select("file_path"), "file_path", "left_anti")
                same = F.col("file_size").eqNullSafe(F.col("__size")) & F.col("modified_time").eqNullSafe(F.col("__time")) & F.lit(incremental)
                listing = listing.join(s, "file_path", "left").withColumn("__open", ~same).drop("__size", "__time")
            else:
                listing = listing.withColumn("__open", F.lit(True))
            listing = stash(listing)
            if info["segments"]:
                gone = seen.select("file_path").join(listing.select("file_path"), "file_path", "left_anti")
            return self._apply(info, self._opened(listing.where("__open").drop("__open")), gone, stats, incremental, listing)

    def _opened(self, ask: DataFrame) -> DataFrame:
        """``ask`` with content, dealt out by bytes: rows are small before their files are read."""
        n, size = ask.agg(F.count(F.lit(1)), F.sum("file_size")).first()
        tasks = max(min(n, self.spark.sparkContext.defaultParallelism), (size or 0) // READ_BYTES, 1)
        return read_contents(ask.repartition(tasks, "file_path")).drop("read_size", "read_time")

    def sync_files(self, files: DataFrame, incremental: bool = True) -> dict:
        """The same for a table of files with content: (file_path, file_name, file_extension, file_size, modified_time, source, content).

        All rows are compared by hash; files that the table lacks go."""
        info = self.info()
        gone = self.table("seen", info).select("file_path").join(files.select("file_path"), "file_path", "left_anti") if info["segments"] else None
        stats = {"new": 0, "updated": 0, "unchanged": 0, "removed": 0, "errors": [], "sources": 0}
        return self._apply(info, files, gone, stats, incremental, None)

    def reindex(self, sources: SourceList, paths: list[str]) -> dict[str, str | None]:
        """Index these files anew, whatever their hashes: path -> None, or why it failed. A file that is gone loses its rows.

        Only these files are opened; they must lie in an enabled source and not be excluded there."""
        from foliant.functions.paths import SUPPORTED, basename, excluded, extension, under

        out: dict[str, str | None] = dict.fromkeys(paths)
        if not out or not sources.enabled():
            return out | {p: "not found in any enabled source" for p in out}
        t = self.spark.createDataFrame([(p,) for p in out], "file_path string")
        inside = [F.when(under(F.col("file_path"), F.lit(s.path)) & ~excluded(F.col("file_path"), s.path, s.exclude_rules), F.lit(s.path)) for s in sources.enabled()]
        t = t.withColumn("file_name", basename(F.col("file_path"))).withColumn("file_extension", extension(F.col("file_name"))).withColumn("source", F.coalesce(*inside))
        read = read_contents(t.where(F.col("source").isNotNull() & F.col("file_extension").isin(*SUPPORTED)).repartition("file_path"))
        found = read.where("content is not null").withColumn("file_size", F.col("read_size")).withColumn("modified_time", F.col("read_time"))
        stats = self._apply(self.info(), found.drop("read_size", "read_time"), t.select("file_path"), {"errors": []}, False, None)
        there = {r.file_path for r in self.table("seen").join(F.broadcast(t.select("file_path")), "file_path", "left_semi").collect()}
        failed = {e["source"]: e["error"] for e in stats["errors"]}
        return {p: failed.get(p) if p in there else "not found in any enabled source" for p in out}

    def remove(self, paths: list[str]) -> None:
        """A version without these files."""
        if paths and self.info()["segments"]:
            self._apply(self.info(), None, self.spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "file_path string"), {"errors": []}, True, None)

    def _apply(self, info: dict, read: DataFrame | None, gone: DataFrame | None, stats: dict, incremental: bool, listing: DataFrame | None) -> dict:
        """Commit a segment with the changed files of ``read`` (with content), and ``gone``; nothing is written if nothing changed."""
        folder = f"segment-{info['version'] + 1:010d}-{uuid.uuid4().hex[:8]}"
        at = f"{self.root}/{folder}"
        files = self.table("files", info)
        parsed, counts = None, {}
        if read is not None:
            self._tell(1, 3, "parse")
            if "md5_hash" not in read.columns:
                read = with_hash_and_title(read)
            old = files.where("error is null") if files is not None and incremental else self.spark.createDataFrame([], "file_path string, md5_hash string")
            marked = diff(read, old)
            # What is unchanged needs no parsing: without content it gives no chunks.
            marked = marked.withColumn("content", F.when(F.col("change") != "unchanged", F.col("content")))
            chunk_files(marked, self.config, META).write.parquet(f"{at}/_parsed")
            parsed = self.spark.read.parquet(f"{at}/_parsed")
            counts = {r.change: r["count"] for r in parsed.groupBy("change").count().collect()}
        kept = None if files is None else files.select("file_path")
        # Paths whose older rows no longer count: those that are gone, and those that have new rows.
        fresh = None if parsed is None else parsed.where("change <> 'unchanged'")
        dead = [x for x in (gone, None if fresh is None or files is None else fresh.select("file_path")) if x is not None]
        dead = reduce(DataFrame.unionByName, dead).distinct() if dead else self.spark.createDataFrame([], TABLES["gone"])
        if info["segments"]:
            known = self.table("seen", info).select("file_path").unionByName(kept).distinct()
            dead = dead.join(known, "file_path", "left_semi")
        self._save("gone", dead, at)
        dead = self.spark.read.schema(TABLES["gone"]).parquet(f"{at}/gone")
        n_gone = dead.count()
        removed = n_gone - (0 if fresh is None else dead.join(fresh.select("file_path"), "file_path", "left_semi").count()) if gone is not None else 0
        stats |= {"removed": removed, **{k: v for k, v in counts.items() if k in stats}}
        if listing is not None and incremental:
            stats["unchanged"] = listing.count() - stats["new"] - stats["updated"]
        if not counts and not n_gone:
            self._fs().delete(self._path(folder), True)
            return stats
        self._tell(2, 3, "write")
        failed = self._rows(parsed, fresh, at, info)
        minus = files.join(sized(dead), "file_path", "left_semi").agg(F.sum("n_lex"), F.sum("tokens")).first() if n_gone and files is not None else (0, 0)
        plus = self.spark.read.schema(FILE).parquet(f"{at}/files").agg(F.sum("n_lex"), F.sum("tokens")).first()
        self._fs().delete(self._path(f"{folder}/_parsed"), True)
        dim, model = (self.embedder.dim, getattr(self.embedder, "name", None)) if self.embedder else (info["embedding_dim"], info["model"])
        segment = {"folder": folder, "gone": n_gone, "bytes": self._fs().getContentSummary(self._path(folder)).getLength()}
        n, dl = (info[k] - (minus[i] or 0) + (plus[i] or 0) for i, k in enumerate(("n", "dl")))
        self._commit(info | {"version": info["version"] + 1, "embedding_dim": dim, "model": model, "n": n, "dl": dl, "segments": [*info["segments"], segment]})
        self._merge()
        self._tell(3, 3, "done")
        stats["errors"] = stats["errors"] + failed
        return stats

    def _rows(self, parsed: DataFrame | None, fresh: DataFrame | None, at: str, info: dict) -> list[dict]:
        """Write a segment's tables; returns the first errors."""
        if parsed is None:
            for name in TABLES.keys() - {"gone"}:
                self._save(name, self.spark.createDataFrame([], self._kind(name, info)), at)
            return []
        self._save("seen", parsed.select("file_path", "file_size", "modified_time"), at)
        chunks = explode_chunks(fresh)
        if self.embedder is not None:
            chunks = embed(chunks, self.embedder)
        self._save("chunks", chunks, at)
        post = lexical.postings(explode_chunks(fresh).select(F.struct("chunk_id", "file_path").alias("id"), "content"), text="content")
        self._save("postings", post.select(F.col("id.chunk_id").alias("id"), "dl", "term", "tf", F.col("id.file_path").alias("file_path")), at)
        body = fresh.select("file_path", F.array_join(F.transform("chunks", lambda c: c["content"]), "\n").alias("text"), F.coalesce("title", "file_name").alias("title"))
        self._save("auto_tags", keyword_tags(body).select("file_path", "tag", "ord"), at)
        post = self.spark.read.schema(TABLES["postings"]).parquet(f"{at}/postings")
        sums = post.groupBy("file_path", "id").agg(F.first("dl").alias("dl")).groupBy("file_path").agg(F.count(F.lit(1)).alias("n_lex"), F.sum("dl").alias("tokens"))
        meta = fresh.withColumn("chunk_count", F.size("chunks")).drop("chunks").join(sums, "file_path", "left").na.fill(0, ["n_lex", "tokens"])
        self._save("files", meta.select(*[c.split()[0] for c in FILE.split(", ")]), at)
        return [{"source": r.file_path, "error": r.error} for r in fresh.where("error is not null").select("file_path", "error").limit(ERRORS).collect()]

    def _save(self, name: str, rows: DataFrame, at: str) -> None:
        """Postings lie by term, a frequent term in several files; everything else by path."""
        if name == "postings":
            rows = rows.repartitionByRange("term", "id").sortWithinPartitions("term", "id")
        elif name != "chunks":
            rows = rows.sortWithinPartitions("file_path")
        rows.write.parquet(f"{at}/{name}")

    def _merge(self) -> None:
        """Merge the segments at the end that are due: a row is written again only when its segment at least doubles, or nearly so."""
        info = self.info()
        sizes = [s["bytes"] for s in info["segments"]]
        first, total = len(sizes) - 1, sizes[-1]
        while first > 0 and sizes[first - 1] <= total:
            first -= 1
            total += sizes[first]
        if len(sizes) - first >= MERGE:
            self.merge(first)
        elif len(sizes) > MOST:
            self.merge(len(sizes) // 2)

    def merge(self, first: int = 0) -> None:
        """Write the segments from ``first`` on as one, without the rows that no longer count. Searches give what they gave."""
        info = self.info()
        old = info["segments"][first:]
        if not old:
            return
        folder = f"segment-{info['version'] + 1:010d}-{uuid.uuid4().hex[:8]}"
        at = f"{self.root}/{folder}"
        for name in TABLES.keys() - {"gone"}:
            self._save(name, self.table(name, info, old), at)
        gone = self.spark.read.schema(TABLES["gone"]).parquet(*[f"{self.root}/{s['folder']}/gone" for s in old]).distinct()
        self._save("gone", gone if first else gone.limit(0), at)
        n_gone = self.spark.read.schema(TABLES["gone"]).parquet(f"{at}/gone").count()
        segment = {"folder": folder, "gone": n_gone, "bytes": self._fs().getContentSummary(self._path(folder)).getLength()}
        self._commit(info | {"version": info["version"] + 1, "segments": [*info["segments"][:first], segment]})

    def snapshot(self, name: str, note: dict | None = None) -> None:
        """Keep the current version under a name: its manifest is copied, its segments stay as long as the snapshot does."""
        if not self._put(f"snapshot-{name}.json", self.info() | {"note": note or {}}):
            raise ValueError(f"there is a snapshot {name}")

    def snapshots(self) -> dict[str, dict]:
        """Name -> manifest and note."""
        return {n.removeprefix("snapshot-").removesuffix(".json"): self._read(n) for n in self._names("snapshot-*.json")}

    def drop_snapshot(self, name: str) -> None:
        self._fs().delete(self._path(f"snapshot-{name}.json"), False)
        self._clean()

    def restore(self, name: str, mode: str = "overwrite") -> str | None:
        """A new version with a snapshot's rows; no data is copied. ``overwrite`` first takes a snapshot to undo by, whose name is
        returned; ``merge`` keeps files that the snapshot lacks. A snapshot of another model or dimension raises."""
        if mode not in ("overwrite", "merge"):
            raise ValueError("mode must be overwrite or merge")
        info, kept = self.info(), self._read(f"snapshot-{name}.json")
        if info["segments"] and (kept["model"], kept["embedding_dim"]) != (info["model"], info["embedding_dim"]):
            raise ValueError(f"made for {kept['model']} with {kept['embedding_dim']} dimensions")
        kept.pop("note")
        if mode == "overwrite" or not info["segments"]:
            undo = f"undo-{name}-{info['version']}" if info["segments"] else None
            if undo:
                self.snapshot(undo)
            self._commit(kept | {"version": info["version"] + 1})
            return undo
        # The snapshot's files replace the present ones of the same path: one segment says so, the snapshot's own follow.
        folder = f"segment-{info['version'] + 1:010d}-{uuid.uuid4().hex[:8]}"
        at = f"{self.root}/{folder}"
        theirs = self.table("files", kept)
        for t in TABLES.keys() - {"gone"}:
            self._save(t, self.spark.createDataFrame([], self._kind(t, info)), at)
        self._save("gone", theirs.select("file_path"), at)
        n_gone = theirs.count()
        lost = self.table("files", info).join(theirs.select("file_path"), "file_path", "left_semi").agg(F.sum("n_lex"), F.sum("tokens")).first()
        n, dl = (info[k] + kept[k] - (lost[i] or 0) for i, k in enumerate(("n", "dl")))
        segment = {"folder": folder, "gone": n_gone, "bytes": 0}
        self._commit(info | {"version": info["version"] + 1, "n": n, "dl": dl, "segments": [*info["segments"], segment, *kept["segments"]]})
        return None

    def searchable(self, own_tags: DataFrame | None = None, info: dict | None = None) -> DataFrame:
        """Chunks with id and file_tags, ready for the search engine."""
        info = info or self.info()
        tags = self.table("auto_tags", info)
        tags = add_tags(own_tags, tags) if own_tags is not None else tags
        return self.table("chunks", info).withColumnRenamed("chunk_id", "id").join(tags_of(tags), "file_path", "left").withColumn("file_tags", F.coalesce("file_tags", F.array().cast("array<string>")))

    def engine(self, mode: str = "hybrid", own_tags: DataFrame | None = None) -> Engine:
        """A search engine over the stored chunks, postings and vectors of one version; of the postings it reads the query's terms."""
        info = self.info()
        return Engine(self.searchable(own_tags, info), self.embedder, mode, self.table("postings", info), self.stats(info))
