"""The change stream and the watcher: each change once, over restarts; bursts and failed syncs survive a program's end."""

import os
import time
from collections import Counter

import pytest

from foliant.sources.scan import Source, SourceList
from foliant.streaming.changes import changes
from foliant.streaming.watch import Watcher


def drain(spark, folder, at) -> Counter:
    """The rows that a query gives which goes on from its checkpoint and ends with what is there."""
    seen = Counter()
    stream = changes(spark, str(folder), f"{at}/state", parts=3).writeStream.foreachBatch(lambda b, _: seen.update((os.path.relpath(r.path, folder), r.change, r["size"]) for r in b.collect()))
    stream.option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start().awaitTermination(60)
    return seen


def test_changes_are_seen_once(spark, tmp_path):
    d = tmp_path / "docs"
    assert drain(spark, d, tmp_path) == {}  # no folder yet
    (d / "sub").mkdir(parents=True)
    (d / "a.md").write_text("one")
    (d / "sub/b.txt").write_text("two")
    assert drain(spark, d, tmp_path) == {("a.md", "created", 3): 1, ("sub/b.txt", "created", 3): 1}
    assert drain(spark, d, tmp_path) == {}
    (d / "a.md").write_text("one more")
    (d / "sub/b.txt").rename(d / "sub/c.txt")
    assert drain(spark, d, tmp_path) == {("a.md", "edited", 8): 1, ("sub/b.txt", "deleted", None): 1, ("sub/c.txt", "created", 3): 1}
    os.utime(d / "a.md", ns=(1, 10**18))
    (d / "sub/c.txt").unlink()
    assert drain(spark, d, tmp_path) == {("a.md", "edited", 8): 1, ("sub/c.txt", "deleted", None): 1}
    assert len([p for p in (tmp_path / "state").iterdir() if p.name.startswith("listing-")]) <= 2


def test_a_batch_that_runs_again_gives_the_same_rows(spark, tmp_path):
    """The program dies in a batch: files change before it is started again, and the batch still has its own rows."""
    d = tmp_path / "docs"
    d.mkdir()
    (d / "a.md").write_text("one")

    def die(batch, _):
        batch.collect()
        raise OSError("killed")

    q = changes(spark, str(d), f"{tmp_path}/state").writeStream.foreachBatch(die).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="killed"):
        q.awaitTermination(60)
    (d / "a.md").unlink()
    (d / "b.md").write_text("later")
    batches = []
    for _ in range(2):  # Spark ends the first run with the batch that was open
        q = changes(spark, str(d), f"{tmp_path}/state").writeStream.foreachBatch(lambda b, i: batches.append((i, sorted((os.path.basename(r.path), r.change) for r in b.collect()))))
        q.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(60)
    assert batches == [(0, [("a.md", "created")]), (1, [("a.md", "deleted"), ("b.md", "created")])]


def until(w, reached, seconds=60):
    end = time.monotonic() + seconds
    while not reached() and time.monotonic() < end and w.active():
        time.sleep(0.05)
    return reached()


def test_one_sync_a_burst_over_a_restart(spark, tmp_path):
    d, other = tmp_path / "docs", tmp_path / "other"
    d.mkdir()
    other.mkdir()
    sources = SourceList([Source(str(d), ["*secret*"]), Source(str(other)), Source(str(tmp_path / "off"), enabled=False)])
    calls = []
    make = lambda quiet: Watcher(spark, sources, lambda s: calls.append(len(s.enabled())) or {"n": len(calls)}, str(tmp_path / "cp"), quiet_ms=quiet, poll_ms=200)
    (d / "a.md").write_text("1")
    w = make(60_000)
    assert w.start() and not w.start()
    assert until(w, lambda: any(p["numInputRows"] for p in w.query.recentProgress))  # the change is in the state, its timer set
    w.stop()
    assert calls == [] and w.results == []
    (d / "b.md").write_text("2")  # while nobody watches
    w = make(1500)
    w.start()
    assert until(w, lambda: len(w.results) == 1)
    assert [b[3] for b in w.bursts] == [2] and calls == [2]
    (d / "b.md").write_text("2 edited")
    (d / "secret.md").write_text("not for us")
    (d / "x.tmp").write_text("nor this")
    assert until(w, lambda: len(w.results) == 2)
    (d / "a.md").unlink()
    assert until(w, lambda: len(w.results) == 3)
    w.stop()
    assert [b[3] for b in w.bursts] == [2, 1, 1] and calls == [2, 2, 2] and not w.errors
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert not Watcher(spark, SourceList([Source(str(d), enabled=False)]), dict, str(tmp_path / "none")).start()


def test_a_failed_sync_is_not_lost(spark, tmp_path):
    d = tmp_path / "docs"
    d.mkdir()
    (d / "a.md").write_text("1")
    fail, calls = [5], []

    def sync(_):
        calls.append(time.monotonic())
        if fail[0]:
            fail[0] -= 1
            raise OSError("busy")
        return {"ok": True}

    make = lambda: Watcher(spark, SourceList([Source(str(d))]), sync, str(tmp_path / "cp"), quiet_ms=200, retries=2, poll_ms=200)
    w = make()
    w.start()
    until(w, lambda: False)  # the stream ends with the third error
    assert len(calls) == 3 and len(w.errors) == 3 and not w.active() and "busy" in str(w.query.exception())
    assert calls[1] - calls[0] >= 0.4 and calls[2] - calls[1] >= 0.8
    w = make()
    w.start()
    assert until(w, lambda: len(w.results) == 1) and len(w.errors) == 2
    w.stop()
    assert w.results == [{"ok": True}] and [b[3] for b in w.bursts] == [1]
