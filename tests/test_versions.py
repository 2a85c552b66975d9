"""Versions of the store under writers that meet, snapshots held in state, and the watched folder."""

import os
import time
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from postlake.operators import lifecycle
from postlake.operators.versions import Conflict, Versions
from postlake.streaming import folder, sync


def frame(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "k string")


def keys(versions, number=None):
    return sorted(r["k"] for r in versions.read(number).collect())


def test_writers_that_meet_lose_nothing(spark, tmp_path):
    store, other = (Versions(spark, f"file://{tmp_path}/t") for _ in range(2))
    with pytest.raises(ValueError):
        store.read()
    base = store.commit(frame(spark, "a"), None)
    other.commit(other.read().union(frame(spark, "b")), base)
    with pytest.raises(Conflict):
        store.commit(store.read(1).union(frame(spark, "c")), base)
    assert keys(store) == ["a", "b"]
    tries = []

    def fold(rows):
        if not tries:
            other.update(lambda r: r.union(frame(spark, "d")))
        tries.append(1)
        return rows.union(frame(spark, "c"))

    assert store.update(fold).number == 4 and len(tries) == 2
    assert keys(store) == ["a", "b", "c", "d"] and keys(store, 2) == ["a", "b"]


def test_a_killed_writer_leaves_the_version(spark, tmp_path, monkeypatch):
    store = Versions(spark, f"file://{tmp_path}/t")
    store.commit(frame(spark, "a"), None)
    monkeypatch.setattr(Versions, "_claim", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        store.update(lambda rows: rows.union(frame(spark, "b")))
    monkeypatch.undo()
    assert keys(store) == ["a"] and store.update(lambda rows: rows.union(frame(spark, "c"))).number == 2
    assert len(os.listdir(tmp_path / "t" / "data")) == 3


def test_a_batch_is_applied_once_and_old_versions_go(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/t")
    store.commit(frame(spark, "a"), None)
    for batch in (0, 0, 1, 1, 0):
        store.update(lambda rows: rows.union(frame(spark, "x")), app="s", batch=batch)
    assert keys(store) == ["a", "x", "x"]
    store.vacuum(keep=1)
    assert store.numbers() == [3] and keys(store) == ["a", "x", "x"]


SCHEMA = "company_id long, job_id string, url string, title string, posted_at timestamp_ntz, pos long, ts timestamp_ntz, snapshot_rows long"


def rows(spark, data):
    return spark.createDataFrame(data, "company_id long, job_id string, url string, title string, posted_at string, pos long, ts string, snapshot_rows long").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("posted_at", "ts")})


def test_split_late_and_repeated_snapshots(spark, tmp_path):
    """A board over three micro-batches, a repeated row, an old snapshot's rows after a newer one, and one that is never whole."""
    old, new = "2024-01-01 00:00:00", "2024-01-02 00:00:00"
    job = lambda board, i, ts, n: (board, f"gh_{board}_{i}", f"https://x.org/{board}/{i}", f"Role {i}", None, i, ts, n)
    batches = [[job(1, 0, new, 3), job(2, 0, new, 2)], [job(1, 1, new, 3), job(1, 0, new, 3), job(1, 0, old, 2)], [job(1, 2, new, 3), job(1, 1, old, 2)]]
    for i, data in enumerate(batches):
        rows(spark, data).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1 if i < 2 else 0)
    stored = spark.createDataFrame([(b, f"gh_{b}_{i}", f"https://x.org/{b}/{i}", f"Role {i}", "open") for b in (1, 2) for i in (0, 2, 5)], "company_id long, job_id string, url string, title string, status string")
    stored = stored.withColumns({c: F.lit(v).cast("timestamp_ntz") for c, v in (("first_seen", "2023-12-01 00:00:00"), ("last_seen", "2023-12-01 00:00:00"), ("closed_at", None), ("posted_at", None))})
    store = sync.Snapshots(spark, f"file://{tmp_path}/store")
    store.publish(stored)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = sync.start(stream, store, f"file://{tmp_path}/checkpoint")
    query.awaitTermination()
    whole = rows(spark, [job(1, i, new, 3) for i in range(3)]).drop("ts", "snapshot_rows")
    wanted = lifecycle.sync_statuses(stored, whole, F.lit(new).cast("timestamp_ntz")).drop("change")
    show = lambda df: sorted(map(str, df.select("job_id", "status", "closed_at", "last_seen").collect()))
    assert show(store.read()) == show(wanted)
    assert {r["job_id"]: r["status"] for r in store.read().collect()} == {"gh_1_0": "open", "gh_1_2": "open", "gh_1_5": "closed", "gh_2_0": "open", "gh_2_2": "open", "gh_2_5": "open"}


def test_changed_pages_are_read_again(spark, tmp_path):
    watched = tmp_path / "pages"
    watched.mkdir()
    (watched / "a.html").write_text("one")
    (watched / "b.html").write_text("same")
    (watched / "note.txt").write_text("no page")
    out = []

    def run():
        stream = folder.changed_pages(spark, str(watched)).writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True)
        stream.foreachBatch(lambda df, _: out.extend((os.path.basename(r["url"]), r["html"]) for r in df.collect())).start().awaitTermination()

    run()
    assert sorted(out) == [("a.html", "one"), ("b.html", "same")]
    (watched / "a.html").write_text("two")
    os.utime(watched / "a.html", ns=(1, 2_000_000_000_000_000_000))
    (watched / "b.html").unlink()
    run()
    run()
    assert sorted(out) == [("a.html", "one"), ("a.html", "two"), ("b.html", "same")]


class Held:
    """A map state that counts its calls."""

    def __init__(self):
        self.of, self.calls = {}, 0

    def __getattr__(self, name):
        self.calls += 1
        return {"containsKey": self.of.__contains__, "getValue": self.of.__getitem__, "updateValue": self.of.__setitem__, "removeKey": self.of.pop, "iterator": lambda: iter(list(self.of.items()))}[name]


def test_state_is_called_by_parts_not_by_rows():
    """20,000 rows in 4 micro-batches of two parts, the last one repeated: some calls for each part, each row out once."""
    columns = ["company_id", "ts", "snapshot_rows", "pos"]
    part = lambda first, n: pd.DataFrame({"company_id": 1, "ts": pd.Timestamp("2024-01-02"), "snapshot_rows": 20_000, "pos": range(first, first + n)})
    processor = object.__new__(sync._Whole)
    processor.columns, processor.time, processor.size, processor.row, processor.patience = columns, "ts", "snapshot_rows", "pos", 1000
    processor.schema, processor.rows, processor.seen = None, Held(), Held()
    processor.done = SimpleNamespace(exists=lambda: False, update=lambda value: None)
    processor.handle = SimpleNamespace(registerTimer=lambda due: None)
    out = []
    for batch in (0, 1, 2, 2, 3):
        parts = [part(5000 * batch + 2500 * half, 2500) for half in (0, 1)]
        out.append([d for d in processor.handleInputRows((1,), iter(parts), SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 0))])
    assert [len(o) > 0 for o in out] == [False] * 4 + [True]
    assert sorted(pd.concat(out[-1])["pos"]) == list(range(20_000))
    assert not processor.rows.of and not processor.seen.of
    assert processor.rows.calls + processor.seen.calls < 200
