"""Report tables and files: briefing columns, summary order, CSV, JSON, partitioned and text outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms, text


def summary_order(rows: DataFrame, label: str, ts: str) -> DataFrame:
    """Adds rank columns and sorts: industry first, then the fixed platform order, newest first."""
    place = F.array_position(F.array(*map(F.lit, terms.PLATFORM_ORDER)), F.col(label))
    return rows.withColumn("industry", F.when(F.col(label).isin("EU行业", "行业"), 0).otherwise(1)).withColumn("place", F.when(place == 0, len(terms.PLATFORM_ORDER)).otherwise(place - 1).cast("int")).orderBy("industry", "place", F.desc_nulls_last(ts), "pos")


def header_union(*frames: DataFrame) -> DataFrame:
    """Tables as one whose columns are all of theirs, in the order in which they first come."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """One header for all rows; list columns are joined by `` | ``."""
    flat = df.select(*(F.array_join(c, " | ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes))
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _joined(df: DataFrame, line: Column, ending: str, path: str, head: bytes, tail: bytes, cut: int = 0) -> None:
    """One file of all rows as text: tasks write them in parts, which the file system's streams then put behind one another in the
    driver's JVM, a buffer at a time. ``cut`` bytes at the end of the last row go; without rows there is no head and no tail.
    """
    import uuid

    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    parts = f"{path}.{uuid.uuid4().hex}"
    df.select(line.alias("value")).write.option("lineSep", ending).text(parts)
    folder, target = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(conf)
    found = sorted((s.getPath().getName(), s.getLen(), s.getPath()) for s in system.listStatus(folder) if s.getPath().getName().startswith("part-") and s.getLen())
    out = system.create(target, True)
    out.write(head if found else b"")
    for i, (_, size, part) in enumerate(found):
        stream = system.open(part)
        if i == len(found) - 1 and cut:
            stream = jvm.org.apache.commons.io.input.BoundedInputStream(stream, size - cut)
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
        stream.close()
    out.write(tail if found else b"")
    out.close()
    system.delete(folder, True)


def write_bom_csv(df: DataFrame, path: str) -> None:
    """One CSV file that begins with a byte order mark, for a spreadsheet: a header and every value in quotes, lists joined by `` | ``.

    Rows keep the order of the table's partitions. An empty table gives an empty file.
    """
    text_of = lambda c, t: F.array_join(c, " | ", "None") if t.startswith("array") else F.col(c).cast("string")
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(text_of(c, t), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c, t in df.dtypes]
    head = ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    _joined(df, F.concat_ws(",", *quoted), "\r\n", path, b"\xef\xbb\xbf" + f"{head}\r\n".encode(), b"")


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, one file a task."""
    df.write.mode("overwrite").json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """One file with an array of all rows, indented, as a report hands it on; rows keep the order of the table's partitions."""
    import json

    @F.pandas_udf("string")
    def indented(rows):
        return rows.map(lambda r: "\n".join("  " + x for x in json.dumps(json.loads(r), ensure_ascii=False, indent=2).split("\n")))

    if df.isEmpty():
        _joined(df.sparkSession.createDataFrame([("[]",)], "value string"), F.col("value"), "\n", path, b"", b"")
        return
    _joined(df, indented(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})), ",\n", path, b"[\n", b"\n]\n", cut=2)


def write_grouped(df: DataFrame, path: str, *keys: str) -> None:
    """One folder for each value of the keys, named by its slug."""
    out = df.withColumns({f"{k}_slug": text.slug(F.col(k)) for k in keys})
    out.write.mode("overwrite").partitionBy(*(f"{k}_slug" for k in keys)).parquet(path)
