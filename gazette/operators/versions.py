"""A stored table as a chain of versions: writers add one each or fail, readers keep the one that they began with.

Rows lie in folders that never change; a version is a small file that names the folders of each part (a run's stage, say) that the
table has then. A writer writes its folders first and then moves its version's file to the next number, which only one can do: it
is as atomic as the file system's move without overwriting. The loser takes the winner's version as its base and tries again. What
a killed writer leaves behind is in no version, and goes with the next ``vacuum``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Key = tuple[str, ...]


class Conflict(Exception):
    """Another writer has added the version that this one wanted to add."""


@dataclass(frozen=True)
class Version:
    """A table at one time: its number (0: nothing yet), schema, and the folder of each part."""

    number: int = 0
    schema: StructType = field(default_factory=StructType)
    parts: dict[Key, str] = field(default_factory=dict)


def _system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, time of the last change in ms) of what lies in a folder."""
    system, at = _system(spark, path)
    return [(s.getPath().getName(), s.getModificationTime()) for s in system.listStatus(at)] if system.exists(at) else []


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(name[:-5]) for name, _ in _names(spark, f"{path}/_versions") if name[:-5].isdigit() and name.endswith(".json"))


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """A version of a table, the newest by default."""
    if number is None:
        number = max(_numbers(spark, path), default=0)
    if not number:
        return Version()
    system, at = _system(spark, f"{path}/_versions/{number:012d}.json")
    stream = system.open(at)
    try:
        held = json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()
    return Version(number, StructType.fromJson(held["schema"]), {tuple(k): folder for k, folder in held["parts"]})


def read(spark: SparkSession, path: str, number: int | None = None, keep: Callable[[Key], bool] | None = None) -> DataFrame:
    """The rows of a version, the newest by default; with ``keep`` of some parts only, and no folder of another one is opened.

    Later versions change nothing in what has been read, until a ``vacuum`` that no longer keeps this one.
    """
    found = version(spark, path, number)
    folders = [f"{path}/{folder}" for key, folder in found.parts.items() if keep is None or keep(key)]
    return spark.read.schema(found.schema).parquet(*folders) if folders else spark.createDataFrame([], found.schema)


def _add(spark: SparkSession, path: str, new: Version) -> None:
    """Puts a version in its place; raises ``Conflict`` where there is one already."""
    folder = f"{path}/_versions"
    system, at = _system(spark, f"{folder}/.{uuid.uuid4().hex}")
    stream = system.create(at, True)
    stream.write(json.dumps({"schema": new.schema.jsonValue(), "parts": [[list(k), folder] for k, folder in sorted(new.parts.items())]}, ensure_ascii=False).encode())
    stream.close()
    files = spark._jvm.org.apache.hadoop.fs
    context = files.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    rename = files.Options.Rename
    options = spark._sc._gateway.new_array(rename, 1)
    options[0] = getattr(rename, "NONE")
    try:
        context.rename(at, files.Path(f"{folder}/{new.number:012d}.json"), options)
    except Exception as e:
        system.delete(at, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"version {new.number} of {path} is another writer's") from e
        raise


def _wider(old: StructType, new: StructType) -> StructType:
    """The new columns, and behind them those that only older folders have."""
    names = {f.name for f in new.fields}
    return StructType([*new.fields, *(f for f in old.fields if f.name not in names)])


def save(rows: DataFrame, path: str, by: tuple[str, ...] = (), replaced: Iterable[Key] = (), base: int | None = None, tries: int = 10) -> int:
    """Adds a version in which the parts that the rows have values for (and those in ``replaced``, though they may be empty now) are
    these rows and all other parts are as before; gives its number. Saving twice changes nothing.

    by: the columns whose values name a part (none: the table is one part). base: the version that this change was made from; if
    another has come since, ``Conflict`` is raised. Without it the change goes on top of whatever is newest. Rows go from the tasks
    to the folders; the driver sees the names of the parts written.
    """
    spark, path = rows.sparkSession, path.rstrip("/")
    folder = f"data/{uuid.uuid4().hex}"
    marks = [f"_part{i}" for i in range(len(by))]
    named = rows.withColumns({m: F.concat(F.lit("v"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for m, c in zip(marks, by, strict=True)})
    # The columns stay in the files as well: a folder is read on its own.
    if marks:
        named.repartition(*by).write.partitionBy(*marks).parquet(f"{path}/{folder}")
    else:
        named.write.parquet(f"{path}/{folder}")
    own: dict[Key, str] = {}
    if marks:
        # Names of the parts, a row each; the folders are named by the values as Spark escapes them.
        escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for key in spark.read.parquet(f"{path}/{folder}").select(*marks).distinct().collect() if _written(spark, f"{path}/{folder}") else ():
            own[tuple(str(v)[1:] for v in key)] = "/".join([folder, *(f"{m}={escape(str(v))}" for m, v in zip(marks, key, strict=True))])
    else:
        own[()] = folder
    for _ in range(tries):
        before = version(spark, path, base)
        kept = {k: f for k, f in before.parts.items() if k not in own and k not in set(map(tuple, replaced))}
        try:
            _add(spark, path, Version(before.number + 1, _wider(before.schema, rows.schema), {**kept, **own}))
            return before.number + 1
        except Conflict:
            if base is not None:
                raise
    raise Conflict(f"{path} is written to all the time")


def _written(spark: SparkSession, path: str) -> bool:
    return any(name.startswith("_part0=") for name, _ in _names(spark, path))


def vacuum(spark: SparkSession, path: str, keep: int = 10, hours: float = 24) -> int:
    """Deletes all versions but the last ``keep``, and folders of rows that none of these names and nobody has changed for some hours
    (a writer may be about to name its own); gives the number of folders deleted."""
    path = path.rstrip("/")
    numbers = _numbers(spark, path)
    for number in numbers[:-keep]:
        system, at = _system(spark, f"{path}/_versions/{number:012d}.json")
        system.delete(at, False)
    named = {folder.split("/")[1] for number in numbers[-keep:] for folder in version(spark, path, number).parts.values()}
    gone = [name for name, changed in _names(spark, f"{path}/data") if name not in named and changed < (time.time() - 3600 * hours) * 1000]
    for name in gone:
        system, at = _system(spark, f"{path}/data/{quote(name)}")
        system.delete(at, True)
    return len(gone)
