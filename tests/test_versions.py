"""The store of versions: saves that replace whole parts, writers at once, a killed writer, and readers in between."""

import threading

import pytest

from gazette.operators import store, versions

RUNS = "run_id string, stage string, row_index int"


def rows(spark, *found, schema=RUNS):
    return spark.createDataFrame(list(found), schema)


def held(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_saving_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    assert held(store.saved_runs(spark, path)) == [] and versions.version(spark, path).number == 0
    first = rows(spark, ("r1", "before", 1), ("r1", "before", 2), ("r1", "after", 2), ("r/2 é", "after", 3), (None, "after", 9))
    assert store.save_runs(first, path) == 1
    assert held(store.saved_runs(spark, path).na.fill("")) == held(first.na.fill(""))
    store.save_runs(first.where("run_id = 'r1'"), path)
    assert held(store.saved_runs(spark, path).na.fill("")) == held(first.na.fill(""))
    # A stage that comes in anew replaces the old one; one that is empty now goes if its run is named.
    store.save_runs(rows(spark, ("r1", "after", 7)), path)
    assert held(store.saved_runs(spark, path, ["r1"])) == [("r1", "after", 7), ("r1", "before", 1), ("r1", "before", 2)]
    store.save_runs(rows(spark, ("r1", "after", 8)), path, ["r1"])
    assert held(store.saved_runs(spark, path, ["r1"])) == [("r1", "after", 8)]
    store.save_runs(first.limit(0), path, ["r1"])
    assert held(store.saved_runs(spark, path, ["r1"])) == [] and len(held(store.saved_runs(spark, path))) == 2
    # Of other runs no file is read.
    assert not any("=vr1" in f for f in store.saved_runs(spark, path, ["r/2 é"]).inputFiles()) and store.saved_runs(spark, path, ["r/2 é"]).count() == 1


def test_readers_keep_their_version(spark, tmp_path):
    path = str(tmp_path / "store")
    store.save_runs(rows(spark, ("r1", "after", 1)), path)
    before = store.saved_runs(spark, path)
    store.save_runs(rows(spark, ("r1", "after", 2, "x"), schema=f"{RUNS}, more string"), path)
    store.save_runs(rows(spark, ("r2", "after", 3)), path)
    assert held(before) == [("r1", "after", 1)] and held(versions.read(spark, path, 1)) == held(before)
    assert held(store.saved_runs(spark, path)) == [("r1", "after", 2, "x"), ("r2", "after", 3, None)]
    assert versions.vacuum(spark, path, keep=2, hours=0) == 1 and len(held(store.saved_runs(spark, path))) == 2


def test_two_writers(spark, tmp_path, monkeypatch):
    """Writers at once: one version each, no row lost; with a base, the second one is told."""
    path = str(tmp_path / "store")
    failed = []

    def write(k):
        try:
            store.save_runs(rows(spark, (f"r{k}", "after", k)), path)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and held(store.saved_runs(spark, path)) == [(f"r{k}", "after", k) for k in range(4)] and versions.version(spark, path).number == 4
    versions.save(rows(spark, ("r0", "after", 10)), path, ("run_id", "stage"), base=4)
    with pytest.raises(versions.Conflict):
        versions.save(rows(spark, ("r0", "after", 11)), path, ("run_id", "stage"), base=4)
    # Another writer comes in between reading the newest version and adding the next.
    add, late = versions._add, []

    def slow(spark_, path_, new):
        if not late:
            late.append(True)
            store.save_runs(rows(spark, ("other", "after", 1)), path)
        add(spark_, path_, new)

    monkeypatch.setattr(versions, "_add", slow)
    store.save_runs(rows(spark, ("r0", "after", 12)), path)
    assert {("other", "after", 1), ("r0", "after", 12)} <= set(held(store.saved_runs(spark, path)))


def test_killed_writers(spark, tmp_path, monkeypatch):
    """A writer that dies before its version is there has changed nothing; what it left goes with the next vacuum, not with an early one."""
    path = str(tmp_path / "store")
    store.save_runs(rows(spark, ("r1", "after", 1)), path)

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(versions, "_add", dies)
        with pytest.raises(KeyboardInterrupt):
            store.save_runs(rows(spark, ("r1", "after", 2)), path)
    assert held(store.saved_runs(spark, path)) == [("r1", "after", 1)]
    assert versions.vacuum(spark, path) == 0 and versions.vacuum(spark, path, hours=0) == 1
    assert held(store.saved_runs(spark, path)) == [("r1", "after", 1)] and store.save_runs(rows(spark, ("r1", "after", 3)), path) == 2


def test_whole_tables(spark, tmp_path):
    """A small table without parts (a registry, say) is replaced as a whole, by an empty one too."""
    path = str(tmp_path / "registry")
    for k, frame in enumerate((spark.range(3), spark.range(1), spark.range(0)), 1):
        assert versions.save(frame, path) == k and versions.read(spark, path).count() == frame.count()
    assert versions.read(spark, path, 1).count() == 3
