"""Tables in the folder that driver and executors share, and connected components over them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset and Spark runs in one process, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gazette-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh(columns: list[str], name: str) -> str:
    """A column name that none of ``columns`` has in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Folders that ``table`` wrote and nothing has deleted, in order.
_written: list[str] = []


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes a DataFrame as Parquet to the shared folder and reads it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(*frames: DataFrame | None) -> None:
    """Deletes tables that ``table`` wrote, once nothing reads them any more."""
    for df in frames:
        if df is None:
            continue
        names = {f.rsplit("/", 2)[1] for f in df.inputFiles()}
        for folder in [w for w in _written if w.rsplit("/", 1)[1] in names]:
            _delete(df.sparkSession, folder)
            _written.remove(folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end every table written within: for work whose result has been written elsewhere by then."""
    before = len(_written)
    try:
        yield
    finally:
        for folder in _written[before:]:
            _delete(spark, folder)
        del _written[before:]


#: Edges (16 bytes each, counted before) that one task may join; beyond it rounds of stars do, with the same result.
FEW_EDGES = 500_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges of a task."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = top(a), top(b)
            above[max(a, b)] = min(a, b)
    nodes = [x for x in above if top(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "component"])


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph of longs ``a``, ``b``, without the components' smallest nodes.

    Each node's component is the smallest node that it reaches. A few edges are joined by one task; many by alternating large and
    small stars until nothing moves: every round writes one table to the shared folder; a hub is met by a minimum with map-side
    combining and a join that Spark may split, never by gathering its neighbours.
    """
    edges = table(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    if edges.count() <= FEW_EDGES:
        found = table(edges.coalesce(1).mapInArrow(_joined, "node long, component long"), "components")
        drop(edges)
        return found
    mark = _mark(edges)
    for _ in range(rounds):
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("m")).select("hub", F.least("hub", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("hub")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = table(large, "edges")
        low = large.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("m"))
        small = large.join(low, F.col("a") == F.col("hub")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = table(small.where("a <> b").distinct(), "edges")
        drop(edges, large)
        edges, before = new, mark
        mark = _mark(edges)
        if mark == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
