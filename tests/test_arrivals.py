"""Articles that come in increments: as one run over all, reading the touched parts only."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazette.operators import arrivals, dedup, versions

SCHEMA = "pos long, platform string, title string, published_at string, source_site string, article_url string, summary string, matched_brands array<string>"


def made(count=160):
    rng = np.random.default_rng(6)
    titles = ["Fees go up for all sellers", "Fees go up for all sellers - Daily News", "Market opens in Milan today", "short", "", "Refund rules change again in spring"]
    out = []
    for i in range(count):
        url = rng.choice(["", "", f"https://a.example/{rng.integers(12)}?utm_source={rng.integers(3)}"])
        out.append((i, str(rng.choice(["Shop", "Other", ""])), str(rng.choice(titles)), str(rng.choice(["2024-01-02", "2024-01-03", ""])), str(rng.choice(["x", "y", ""])), str(url), "s" * int(rng.integers(0, 9)), [str(b) for b in rng.choice(["P", "Q"], rng.integers(0, 3))]))
    return out


def seen(df):
    return sorted((tuple(map(str, r)) for r in df.select("pos", *(c.split()[0] for c in SCHEMA.split(", ")[1:]), "group_size").collect()))


@pytest.mark.parametrize("order", ["mixed"])
def test_increments_equal_one_run(spark, tmp_path, order, monkeypatch):
    monkeypatch.setattr(arrivals, "KEY_PARTS", 8)
    rows = made()
    every = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "store")
    parts = [rows[:60], rows[60:120], rows[120:]] if order == "by place" else [rows[k::3] for k in (2, 0, 1)]
    for k, part in enumerate(parts, 1):
        assert arrivals.add(spark.createDataFrame(part, SCHEMA), path) == k
        so_far = spark.createDataFrame(sorted(r for p in parts[:k] for r in p), SCHEMA)
        assert seen(arrivals.result(spark, path, every)) == seen(dedup.initial_dedupe(so_far))
    assert arrivals.add(every.limit(0), path) == 4 and seen(arrivals.result(spark, path, every)) == seen(dedup.initial_dedupe(every))


def test_only_touched_parts_are_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    old = [(i, "Shop", f"Story number {i} of the day", f"2024-01-{1 + i % 20:02d}", "x", "", "s", []) for i in range(200)]
    arrivals.add(spark.createDataFrame(old, SCHEMA), path)
    files, read = [], versions.read

    def noted(*args, **kwargs):
        df = read(*args, **kwargs)
        files.extend(df.inputFiles())
        return df

    monkeypatch.setattr(arrivals.versions, "read", noted)
    number = versions.version(spark, path).parts
    arrivals.add(spark.createDataFrame([(500, "Shop", "Story number 7 of the day", "2024-01-08", "y", "", "ss", []), (501, "Shop", "Quite another story", "2024-01-25", "y", "", "", [])], SCHEMA), path)
    days = {f.split("_part1=v")[1][:10] for f in files if "_part0=vgroups" in f or "_part0=vfinal" in f}
    assert days == {"2024-01-08"} and len({f.split("_part1=")[1].split("/")[0] for f in files if "_part0=vmembers" in f}) <= 2
    after = versions.version(spark, path).parts
    changed = {k for k in number if after.get(k) != number[k]}
    assert changed and all(k[1].startswith("2024-01-08") for k in changed)
    monkeypatch.undo()
    got = arrivals.result(spark, path).where("pos in (7, 501)").select("pos", "group_size", "source_site").collect()
    assert sorted(map(tuple, got)) == [(7, 2, "x | y"), (501, 1, "y")]


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "store"), made(40)
    arrivals.add(spark.createDataFrame(rows[:20], SCHEMA), path)
    save = versions.save

    def late(*args, **kwargs):
        monkeypatch.setattr(arrivals.versions, "save", save)
        arrivals.add(spark.createDataFrame(rows[20:30], SCHEMA), path)
        return save(*args, **kwargs)

    monkeypatch.setattr(arrivals.versions, "save", late)
    with pytest.raises(versions.Conflict):
        arrivals.add(spark.createDataFrame(rows[30:], SCHEMA), path)
    arrivals.add(spark.createDataFrame(rows[30:], SCHEMA), path)
    every = spark.createDataFrame(rows, SCHEMA)
    assert seen(arrivals.result(spark, path, every)) == seen(dedup.initial_dedupe(every).where(F.lit(True)))
