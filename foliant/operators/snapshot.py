"""Snapshots of table folders, and the application's settings."""

from __future__ import annotations

import json
import os
import shutil
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SnapshotError(ValueError):
    pass


def create_snapshot(data_dir: str, target: str, model: str, embedding_dim: int, sources: list[dict] = ()) -> str:
    """Zip the folder, with a description of what it holds. The description's file name and keys."""
    meta = {"app_version": "1", "model": model, "embedding_dim": embedding_dim, "created_at": time.strftime("%Y-%m-%dT%H:%M:%S"), "sources": list(sources)}
    with open(os.path.join(data_dir, "meta.json"), "w", encoding="utf-8") as f:
        json.dump(meta, f)
    try:
        return shutil.make_archive(target.removesuffix(".zip"), "zip", data_dir)
    finally:
        os.remove(os.path.join(data_dir, "meta.json"))


def read_meta(archive: str) -> dict:
    import zipfile

    with zipfile.ZipFile(archive) as z:
        if "meta.json" not in z.namelist():
            raise SnapshotError("the archive has no meta.json")
        return json.loads(z.read("meta.json"))


def restore_snapshot(archive: str, data_dir: str, model: str, embedding_dim: int, mode: str = "overwrite") -> str | None:
    """Unpack over the folder; ``overwrite`` empties it first, after a snapshot to undo by, whose path is returned; ``merge`` keeps
    files that the archive lacks. Another model or dimension raises."""
    meta = read_meta(archive)
    if (meta.get("model"), int(meta.get("embedding_dim") or 0)) != (model, int(embedding_dim)):
        raise SnapshotError(f"made for {meta.get('model')} with {meta.get('embedding_dim')} dimensions")
    undo = None
    os.makedirs(data_dir, exist_ok=True)
    if mode == "overwrite":
        undo = create_snapshot(data_dir, f"{data_dir.rstrip('/')}.undo-{time.time_ns()}", model, embedding_dim)
        for name in os.listdir(data_dir):
            p = os.path.join(data_dir, name)
            shutil.rmtree(p) if os.path.isdir(p) else os.remove(p)
    elif mode != "merge":
        raise ValueError("mode must be overwrite or merge")
    shutil.unpack_archive(archive, data_dir)
    os.remove(os.path.join(data_dir, "meta.json"))
    return undo


@dataclass
class Settings:
    """The application's settings. Names and defaults are those of the settings file."""

    top_k: int = 10
    search_mode: str = "hybrid"
    model: str = "hash"
    device: str = "auto"
    priority: str = "gpu,cpu"
    chunk_max: int = 800
    chunk_overlap: int = 100
    batch_size: int = 32
    theme: str = "dark"
    last_folder: str = ""
    index_sources: list[dict] = field(default_factory=list)
    recent_searches: list[str] = field(default_factory=list)
    auto_index_enabled: bool = False
    auto_index_debounce_ms: int = 1500
    cluster_enabled: bool = True
    cluster_auto: bool = False

    @classmethod
    def load(cls, path: str) -> Settings:
        """From JSON, field by field; a value of another kind than the default's, or none, leaves the default, as does an unreadable file."""
        out = cls()
        try:
            with open(path, encoding="utf-8") as f:
                stored = json.load(f)
        except (OSError, ValueError):
            return out
        for name, usual in asdict(out).items():
            value = stored.get(name) if isinstance(stored, dict) else None
            if type(value) is type(usual):
                setattr(out, name, value)
        return out

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, ensure_ascii=False)

    def update(self, path: str, **changes) -> bool:
        """Set values; saves and returns True only if one changed."""
        old = asdict(self)
        for k, v in changes.items():
            if k not in self.__dataclass_fields__:
                raise KeyError(k)
            setattr(self, k, v)
        if asdict(self) == old:
            return False
        self.save(path)
        return True

    def push_search(self, query: str, cap: int = 50) -> None:
        if query.strip():
            self.recent_searches = [query, *(q for q in self.recent_searches if q != query)][:cap]


def recent_searches(log: DataFrame, cap: int = 50) -> DataFrame:
    """(q, ts) of a search log: each query once, the latest first."""
    return log.where(F.trim("q") != "").groupBy("q").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), "q").limit(cap)
