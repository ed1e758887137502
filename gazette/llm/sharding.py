"""Minimax contiguous partition of groups into shards, in DataFrame operations.

Rows with equal texts are one group and stay together. Groups are ordered by the digest of their text, and each shard takes a
contiguous run of them. The smallest capacity for which a greedy filling needs no more than the wanted shards is found by
binary search; the cuts of that filling are the shard borders. Law: ``bytes``, sizes as near equal as atomic groups allow.

The driver never holds the groups. Digests are read digit by digit: the sizes of at most ``CHILDREN`` ranges come to the driver, and
of a range in which a border falls those of its parts, and so on; the groups themselves come only from a range that holds no more than
``CHILDREN`` of them. However many groups there are, no fetch brings more rows than that, and at most ``HELD`` are kept at a time.

Cases: a null text has no bytes and falls into one group with the empty ones; size is bytes plus one, so no row weighs
nothing. Fewer groups than shards leave shards empty. An empty table gives no row. Repeated rows are rows of one group, each
with its own slot. Other columns are not read.
"""

from __future__ import annotations

import bisect
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop, table

#: Hexadecimal digits by which a range of digests is parted, and so the rows that one fetch brings at most; rows kept at a time.
DIGITS = 4
CHILDREN = 16**DIGITS
HELD = 8 * CHILDREN
#: Slots' parts of a shard.
CELL_ROWS = 20_000
MAX_CELLS = 4_096


class _Line:
    """Sizes of the ordered groups as a tree over the digits of their digests, with nodes fetched on demand."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.nodes: dict[str, tuple[list[str], list[int], list[int]]] = {}  # prefix -> keys, ends from the node's begin, counts
        self.held, self.most_fetched = 0, 0
        rows = self._sums(groups, DIGITS)
        self.most = max((r["most"] for r in rows), default=0)
        self.root = self._node(rows)
        self.total = self.root[1][-1] if rows else 0

    def _sums(self, rows: DataFrame, digits: int) -> list:
        found = rows.groupBy(F.substring("digest", 1, digits).alias("key")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("size").alias("most")).orderBy("key").collect()
        self.most_fetched = max(self.most_fetched, len(found))
        return found

    @staticmethod
    def _node(rows: list) -> tuple[list[str], list[int], list[int]]:
        return [r["key"] for r in rows], list(accumulate(r["size"] for r in rows)), [r["n"] for r in rows]

    def fetch(self, wanted: dict[str, int]) -> None:
        """Loads the nodes of prefixes (with the number of their groups): whole digests where they are few, else the next digits."""
        wanted = {p: n for p, n in wanted.items() if p not in self.nodes}
        few = {p: n for p, n in wanted.items() if n <= CHILDREN}
        while few:
            part, rows = [], 0
            for p, n in list(few.items()):
                if part and rows + n > CHILDREN:
                    break
                part.append(p)
                rows += few.pop(p)
            self._keep(part, self._sums(self._below(part), 32))
        for p, n in wanted.items():
            if n > CHILDREN:
                self._keep([p], self._sums(self._below([p]), len(p) + DIGITS))

    def _below(self, prefixes: list[str]) -> DataFrame:
        size = len(prefixes[0])
        rows = self.groups.where(F.substring("digest", 1, size).isin(prefixes))
        # The stored number of the first four digits lets files without them be skipped.
        return rows.where(F.col("bucket").isin(sorted({int(p[:4], 16) for p in prefixes}))) if size >= 4 else rows

    def _keep(self, prefixes: list[str], rows: list) -> None:
        while self.nodes and self.held + len(rows) > HELD:
            self.held -= len(self.nodes.pop(next(iter(self.nodes)))[0])
        size = len(prefixes[0])
        for p in prefixes:
            self.nodes[p] = self._node([r for r in rows if r["key"][:size] == p])
        self.held += len(rows)

    def reach(self, start: int, capacity: int) -> tuple[int, str | None]:
        """The last border at or before start + capacity, and the digest of the first group behind it (None: all taken)."""
        limit, base, (keys, ends, counts) = start + capacity, 0, self.root
        while True:
            place = bisect.bisect_right(ends, limit - base)
            if place == len(ends):
                return base + (ends[-1] if ends else 0), None  # only at the root: a node below holds the border
            if len(keys[place]) == 32:
                return base + (ends[place - 1] if place else 0), keys[place]
            if keys[place] not in self.nodes:
                top = len(keys[place]) == DIGITS
                self.fetch({keys[i]: counts[i] for i in ({place - 1, place, place + 1} if top else {place}) if 0 <= i < len(keys)})
                if keys[place] not in self.nodes:
                    self.fetch({keys[place]: counts[place]})
            base += ends[place - 1] if place else 0
            keys, ends, counts = self.nodes[keys[place]]

    def fill(self, capacity: int, shards: int) -> list[str] | None:
        """First digests of all shards but the first, filled greedily; None if more than ``shards`` are needed."""
        at, cuts = 0, []
        for _ in range(shards):
            at, digest = self.reach(at, capacity)
            if digest is None:
                return cuts
            cuts.append(digest)
        return None


def minimax_cuts(groups: DataFrame, shards: int) -> list[str]:
    """Digests at which the shards after the first begin. groups: bucket, digest, size, one row a group at least."""
    line = _Line(groups)
    if not line.total:
        return []
    low = max(-(-line.total // shards), line.most)
    # An even filling shows where the borders will be about; these ranges come in one go.
    keys, ends, counts = line.root
    near = {i + d for k in range(1, shards) for i in [bisect.bisect_right(ends, k * low)] for d in (-2, -1, 0, 1)}
    line.fetch({keys[i]: counts[i] for i in sorted(near) if 0 <= i < len(keys)})
    cuts = line.fill(low, shards)
    if cuts is not None:
        return cuts
    step, high = 1, low
    while cuts is None:
        high, step = min(line.total, low + step), step * 4
        cuts = line.fill(high, shards)
    while low + 1 < high:
        middle = (low + high) // 2
        found = line.fill(middle, shards)
        if found is None:
            low = middle
        else:
            high, cuts = middle, found
    return cuts


def shard(docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard (null under this law)."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("digest"))
    rows = table(rows.withColumn("bucket", F.conv(F.substring("digest", 1, 4), 16, 10).cast("int")), "sizes")
    groups = table(rows.groupBy("bucket", "digest").agg(F.sum("size").alias("size")), "groups")
    cuts = minimax_cuts(groups, shards)
    drop(groups)
    part = F.lit(0)
    for k, digest in enumerate(cuts, 1):
        part = F.when(F.col("digest") >= digest, k).otherwise(part)
    count = rows.count()
    cells = max(1, min(MAX_CELLS, count // (CELL_ROWS * shards) + 1)) * 8
    placed = rows.withColumn("shard", part.cast("int")).withColumn("cell", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(cells)))
    # At most shards * cells rows: where each cell's slots begin.
    sizes = placed.groupBy("shard", "cell").agg(F.count("*").alias("rows"))
    begin = sizes.withColumn("begin", F.sum("rows").over(Window.partitionBy("shard").orderBy("cell")) - F.col("rows")).select("shard", "cell", "begin")
    order = Window.partitionBy("shard", "cell").orderBy("doc_id", "digest")
    slots = placed.withColumn("place", F.row_number().over(order).cast("long") - 1).join(F.broadcast(begin), ["shard", "cell"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("begin") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: all ``documents`` into shards 0 to 7 by bytes."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
