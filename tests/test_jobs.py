"""Jobs: one step against the formulas by hand, a stored log, and a stream with a restart in between."""

import datetime

from pyspark.sql import functions as F

from gazette.operators import jobs
from gazette.streaming import jobs as stream

PLAN = jobs.Plan((("crawl_site", 100), ("promo_search", 50), ("translation", 20), ("finalize_output", 10), ("done", 5)))
UPDATES = "job string, ts timestamp, seq long, stage string, total_sites long, completed_sites long, active_sites long, message string"


def test_what_is_left_of_a_stage():
    left = lambda *a: jobs.stage_remaining(*a)
    assert left("crawl_site", 30, 100, 10, 5, 0, (0, 0)) == round(70 * 0.6 + min(30 / 5 * 5, 50 * 1.25) * 0.4)
    assert left("crawl_site", 30, 100, 10, 5, 2, (0, 0)) == round((70 * 0.6 + 30 * 0.4) * 0.92)
    assert left("crawl_site", 30, 100, 10, 10, 0, (0, 0)) == 0 and left("crawl_site", 0, 100, 10, 0, 0, (0, 0)) == 100
    assert left("promo_search", 10, 50, 0, 0, 0, (2, 8)) == round(40 * 0.3 + min(10 / 2 * 6, 50 * (6 / 8) * 1.1) * 0.7)
    assert left("translation", 40, 20, 0, 0, 0, (4, 4)) == 1 and left("translation", 5, 20, 0, 0, 0, (5, 4)) == 15
    assert left("finalize_output", 30, 10, 0, 0, 0, (0, 0)) == 1 and left("other", 0, 1, 0, 0, 0, (0, 0)) == 1
    assert jobs.counts("site 3 / 12 and 4/5") == (3, 12) and jobs.counts(None) == (0, 0)


def test_countdown_and_percent():
    """A countdown runs with time, rises by three seconds at most, and only with news; the percentage never falls."""
    timings = {}
    job, a = jobs.advance(None, (0, 1, "crawl_site", 10, 0, 0, None), PLAN, timings)
    assert a == ("update", 1, "crawl_site", 0, 100, 180, 2, False, "crawl_site||0||10||0||0")
    job, b = jobs.advance(job, (10_000_000, 2, "crawl_site", 10, 0, 0, ""), PLAN, timings)
    assert b[5] == 170 and b[8] == a[8]
    job, c = jobs.advance(job, (20_000_000, 3, None, 10, 1, 0, ""), PLAN, timings)
    assert c[5] == min(c[4] + 80, 160 + 3) and c[2] == "crawl_site"
    job, d = jobs.advance(job, (50_400_000, 4, "translation", 0, 0, 0, "1/4"), PLAN, timings)
    assert timings == {"crawl_site": 50} and d[3] == 0 and d[6] > c[6]
    job, e = jobs.advance(job, (51_000_000, 5, "crawl_site", 10, 0, 0, ""), PLAN, timings)
    assert e[6] == d[6] and e[5] <= d[5] + 3
    _, f = jobs.advance(job, (10**12, 6, "elsewhere", 0, 0, 0, ""), PLAN, timings)
    assert f[4] == 1 and f[6] == 99 and f[7]


def log():
    at = datetime.datetime(2024, 1, 1)
    stages = ["crawl_site", "crawl_site", "promo_search", None, "translation", "finalize_output"]
    return [(f"j{j}", at + datetime.timedelta(seconds=37 * k * (j + 1) + (k * k) % 11), 10 * k + j, stages[k % 6], 10, k % 11, k % 2, f"{k % 7}/7" if k % 3 else None) for j in range(5) for k in range(24)]


def plain(rows):
    out = []
    for name in {r[0] for r in rows}:
        job = None
        for r in sorted((r for r in rows if r[0] == name), key=lambda r: (r[1], r[2])):
            job, shown = jobs.advance(job, (int(r[1].replace(tzinfo=datetime.UTC).timestamp()) * 10**6, *r[2:]), PLAN, {})
            out.append((name, *shown))
    return sorted(out, key=str)


def test_stored_log(spark):
    df = spark.createDataFrame([*log(), (None, None, 1, None, None, None, None, None)], UPDATES).withColumn("at", F.unix_micros("ts"))
    assert sorted(map(tuple, jobs.status(df, PLAN).collect()), key=str) == plain(log())
    assert jobs.status(df.limit(0), PLAN).count() == 0


def test_stream_with_a_restart(spark, tmp_path):
    """Two runs over two halves of a log are one run over all; silent jobs are told of once, and forgotten."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.STORE)
    rows = sorted(log(), key=lambda r: r[1])
    half = rows[len(rows) // 2][1]

    def run(some, number):
        spark.createDataFrame(some, UPDATES).coalesce(1).write.parquet(f"{tmp_path}/in/{number}")
        updates = spark.readStream.schema(UPDATES).parquet(f"{tmp_path}/in/*")
        found = stream.status(updates, PLAN, stall=600, forget=7200, late="0 seconds")
        found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=str)

    try:
        first = run([r for r in rows if r[1] < half], 1)
        assert 0 < len([r for r in first if r[1] == "update"]) < len(rows)
        second = run([r for r in rows if r[1] >= half], 2)
        assert [r for r in second if r[1] == "update"] == plain(rows)
        end = rows[-1][1]
        third = run([("other", end + datetime.timedelta(hours=h), h, "crawl_site", 1, 0, 0, "") for h in (1, 5)], 3)
        assert {r[0] for r in third if r[1] == "expired"} >= {f"j{j}" for j in range(5)}
        one = next(r for r in third if r[:2] == ("j4", "expired"))
        timings, job = {}, None
        for r in sorted((r for r in rows if r[0] == "j4"), key=lambda r: r[1:3]):
            job, _ = jobs.advance(job, (int(r[1].replace(tzinfo=datetime.UTC).timestamp()) * 10**6, *r[2:]), PLAN, timings)
        spent = (job.at - job.stage_started) // 10**6
        timings[job.stage] = timings.get(job.stage, 0) + spent
        assert one[9] == "||".join(f"{k}={v}" for k, v in sorted(timings.items()) if v)
        assert all(sum(1 for r in third if r[:2] == (f"j{j}", "expired")) == 1 for j in range(5))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


