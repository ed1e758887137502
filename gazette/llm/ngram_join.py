"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

The incidence matrix is cut into tiles (a chunk of documents by a range of n-gram fingerprints). A block of columns adds up,
for each class of equal documents, how many of its n-grams some other class holds as well; these counts leave packed by ranges
of classes and are added range by range. A document can only link when at least the threshold's share of its n-grams is met
elsewhere, so all others leave at once, and with them the work. For the rest, the n-grams of the size-derived prefix give
posting lists; a pair whose sizes differ too much is dropped, each remaining pair's overlap is counted on whole sets.

Groups of near copies never become all pairs: each posting list is compared with one pivot, what links is contracted, and
only pairs that still stand in different components are compared afterwards, a long list in tiles of bounded size whose bands of
sizes can meet. No link between different components is lost.

Cases: null and empty texts, and texts without words, have no n-gram and are their own component. A text of fewer words than
the n-gram's width is one n-gram. Rows with equal sets (repeated rows as well) link, whatever their ids: rows are linked, not ids,
so an id with two texts can be in two components. A row with a null id takes part; its component is the smallest id that it
reaches, null if there is none. Tables may be empty; columns other than the two named ones are not read. A very long text is a
chunk of its own.

Classes of equal documents are told apart by 128 bits. N-grams, and the classes within a posting list, have 64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import components, drop, table

#: Entries of the incidence matrix that one column block should hold, and the share (in 256ths) of the fingerprints tiled
#: (bounds hold for any share; a smaller one shuffles less and prunes less).
BLOCK_ENTRIES = 2_000_000
UNIVERSE = 96
#: N-grams of sets that a worker deals out at once, and that one of their blocks should hold.
ENTRIES = 500_000
#: Rows of members that one range of classes should hold, and the ranges there are at least.
RANGE_ROWS = 1_000_000
MIN_RANGES = 64
#: Rows of ids and hashes that may be broadcast (32 bytes each, checked before); beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Rounds of comparing with pivots before all pairs of different components are compared, and rows of a tile's side then.
PIVOT_ROUNDS = 4
TILE_ROWS = 1_000

_MEMBER = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("held", pa.int64()), ("cls", pa.int64()), ("mark", pa.int64())])


def _held(tokens: np.ndarray) -> np.ndarray:
    return np.ones(len(tokens), dtype=bool) if UNIVERSE == 256 else tokens < K.U64(UNIVERSE << 56)


def _members(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch, limit=K.ROW_BYTES):
                tokens, at = K.flat_sets(part, width=width)
                n, held = np.diff(at), np.diff(np.concatenate([[0], np.cumsum(_held(tokens))])[at])
                ids = (pa.array(f(tokens, at), mask=n == 0) for f in (K.set_ids, K.set_marks))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(n), pa.array(held), *ids], schema=_MEMBER)

    return run


def _tiles(blocks: int, width: int):
    """Rows (block, payload). A payload holds, for the classes of a chunk: how many of their n-grams another class of the
    chunk holds too, the n-grams of one class only (low 32 bits), and those of several, once each."""
    schema = pa.schema([("block", pa.int32()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch):
                tokens, at = K.flat_sets(part, width=width)
                ids, rows, n = K.set_ids(tokens, at), np.zeros(part.num_rows, dtype=bool), np.diff(at)
                rows[np.unique(ids, return_index=True)[1]] = True
                rows &= n > 0
                chosen = np.repeat(rows, n) & _held(tokens)
                if not chosen.any():
                    continue
                # Owners of 16 bits are sorted by radix.
                owner = np.repeat((np.cumsum(rows) - 1).astype(np.uint16 if len(rows) <= 1 << 16 else np.int32), n)[chosen]
                ids, tokens = ids[rows], tokens[chosen]
                order = np.argsort(tokens)
                tokens, owner = tokens[order], owner[order]
                new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
                group = np.cumsum(new) - 1
                several = (np.bincount(group) > 1)[group]
                block = ((tokens >> K.U64(32)) * K.U64(256) // K.U64(UNIVERSE) * K.U64(blocks)) >> K.U64(32)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
                out_block, out = [], []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    s, o, low = several[a:b], owner[a:b], (tokens[a:b] & K.U64(0xFFFFFFFF)).astype(np.uint32)
                    counts, met = np.bincount(o[~s], minlength=len(ids)), np.bincount(o[s], minlength=len(ids))
                    own, rest = np.flatnonzero(counts), np.flatnonzero(met)
                    counts, met = counts[own], met[rest]
                    singles = low[~s][np.argsort(o[~s], kind="stable")]
                    head = np.array([len(own), len(rest), len(singles)], dtype=np.uint32)
                    parts = [head, ids[own], counts.astype(np.uint32), ids[rest], met.astype(np.uint32), singles, low[s & new[a:b]]]
                    out_block.append(int(block[a]))
                    out.append(b"".join(x.tobytes() for x in parts))
                yield pa.RecordBatch.from_arrays([pa.array(out_block, pa.int32()), pa.array(out, pa.binary())], schema=schema)

    return run


def _block_counts(tiles: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Classes of one column block, with how many of their n-grams some other class holds too."""
    tokens, owners, classes, sums, shared = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for chunk in tiles.column("payload").chunks:
        for value in chunk:
            raw = value.as_buffer()
            own, rest, single = np.frombuffer(raw, dtype=np.uint32, count=3)
            at = 12
            parts = []
            for kind, count in ((np.int64, own), (np.uint32, own), (np.int64, rest), (np.uint32, rest), (np.uint32, single)):
                parts.append(np.frombuffer(raw, dtype=kind, count=count, offset=at))
                at += int(count) * np.dtype(kind).itemsize
            tokens.append(parts[4])
            owners.append(np.repeat(parts[0], parts[1]))
            classes.append(parts[2])
            sums.append(parts[3].astype(np.int64))
            shared.append(np.frombuffer(raw, dtype=np.uint32, offset=at))
    token, owner, several = np.concatenate(tokens), np.concatenate(owners), np.unique(np.concatenate(shared))
    order = np.argsort(token)
    token, owner = token[order], owner[order]
    if len(token):
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        met = np.repeat(np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first), np.diff(np.append(first, len(token))))
        if len(several):
            met |= several[np.minimum(np.searchsorted(several, token), len(several) - 1)] == token
        classes.append(owner[met])
        sums.append(np.ones(int(met.sum()), dtype=np.int64))
    return _add(np.concatenate(classes), np.concatenate(sums))


def _add(cls: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cls, index = np.unique(cls, return_inverse=True)
    return cls, np.bincount(index, weights=counts, minlength=len(cls)).astype(np.int64)


def _met(ranges: int):
    """Rows (part, payload) of one column block: the counts of each range of classes, packed."""

    def run(tiles: pa.Table) -> pa.Table:
        cls, met = _block_counts(tiles)
        part = ((cls.view(K.U64) >> K.U64(32)) * K.U64(ranges)) >> K.U64(32)
        order = np.argsort(part, kind="stable")
        part, cls, met = part[order], cls[order], met[order].astype(np.uint32)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else np.zeros(1, np.int64)
        rows = [(int(part[a]), cls[a:b].tobytes() + met[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "payload": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _sum_met(packed: pa.Table) -> pa.Table:
    """(cls, met) of one range of classes, over all blocks."""
    raw = [v.as_buffer() for chunk in packed.column("payload").chunks for v in chunk]
    sizes = [len(r) // 12 for r in raw]
    cls = np.concatenate([np.frombuffer(r, dtype=np.int64, count=n) for r, n in zip(raw, sizes, strict=True)])
    met = np.concatenate([np.frombuffer(r, dtype=np.uint32, offset=8 * n) for r, n in zip(raw, sizes, strict=True)])
    cls, met = _add(cls, met)
    return pa.table({"cls": cls, "met": met})


def _sets(width: int):
    """(node, n, tokens) of the wanted classes; a row that shares id and hash with another text is passed over."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch, limit=K.ROW_BYTES):
                tokens, at = K.flat_sets(part, width=width)
                cls, mark = part.column("cls").to_numpy(), part.column("mark").to_numpy()
                wanted = np.flatnonzero((np.diff(at) > 0) & (K.set_ids(tokens, at) == cls) & (K.set_marks(tokens, at) == mark))
                rows = [(int(cls[i]), int(at[i + 1] - at[i]), tokens[at[i] : at[i + 1]].tobytes()) for i in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(schema.types)], schema=schema)

    return run


def _entries(blocks: int):
    """Rows (block, payload): the n-grams of sets, dealt out by range; 20 bytes each with the set's node and size."""
    schema = pa.schema([("block", pa.int32()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(batch.column("n").to_numpy())
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + ENTRIES, side="right")))
                part, at = batch.slice(at, end - at), end
                tokens = np.concatenate([np.frombuffer(v.as_buffer(), dtype=np.int64) for v in part.column("tokens")])
                node, n = part.column("node").to_numpy(), part.column("n").to_numpy()
                order = np.argsort(tokens.view(K.U64))
                tokens, row = tokens[order], np.repeat(np.arange(len(n)), n)[order]
                block = ((tokens.view(K.U64) >> K.U64(32)) * K.U64(blocks)) >> K.U64(32)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
                payload = [_packed(node[row[a:b]], tokens[a:b], n[row[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]].astype(np.int32)), pa.array(payload, pa.binary())], schema=schema)

    return run


def _packed(node: np.ndarray, token: np.ndarray, *counts: np.ndarray) -> bytes:
    return b"".join([node.tobytes(), token.tobytes(), *(c.astype(np.uint32).tobytes() for c in counts)])


def _unpacked(packed: pa.Table, counts: int) -> list[np.ndarray]:
    """node, token and the counts of all payloads of a table."""
    raw = [v.as_buffer() for chunk in packed.column("payload").chunks for v in chunk]
    sizes = [len(r) // (16 + 4 * counts) for r in raw]
    kinds = [(np.int64, 0), (np.int64, 8), *((np.uint32, 16 + 4 * i) for i in range(counts))]
    return [np.concatenate([np.frombuffer(r, dtype=kind, count=m, offset=at * m) for r, m in zip(raw, sizes, strict=True)]) for kind, at in kinds]


def _spread(ranges: int):
    """Rows (part, payload) of one block of n-grams: those of several sets with the number of these, by ranges of nodes."""

    def run(dealt: pa.Table) -> pa.Table:
        node, token, n = _unpacked(dealt, 1)
        order = np.argsort(token)
        node, token, n = node[order], token[order], n[order]
        cuts = np.append(np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])), len(token))
        df = np.repeat(np.diff(cuts), np.diff(cuts))
        part = ((node.view(K.U64) >> K.U64(32)) * K.U64(ranges)) >> K.U64(32)
        order = np.argsort(part, kind="stable")
        order = order[df[order] > 1]
        node, token, n, df, part = (x[order] for x in (node, token, n, df, part))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else np.zeros(1, np.int64)
        rows = [(int(part[a]), _packed(node[a:b], token[a:b], n[a:b], df[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "payload": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _prefixes(percent: int):
    """(node, n, most, token, df): the prefixes of one range of nodes."""

    def run(packed: pa.Table) -> pa.Table:
        node, token, n, df = _unpacked(packed, 2)
        order = np.lexsort((token, df, node))
        node, token, n, df = (x[order].astype(np.int64) for x in (node, token, n, df))
        cuts = np.append(np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])), len(node))
        met = np.repeat(np.diff(cuts), np.diff(cuts))
        pos = np.arange(len(node)) - np.repeat(cuts[:-1], np.diff(cuts))
        keep = pos < met - (n * percent + 99) // 100 + 1
        most = (met - pos) * (100 + percent) // percent - n
        return pa.table({"node": node[keep], "n": n[keep], "most": most[keep], "token": token[keep], "df": df[keep]})

    return run


def _overlaps(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("overlap", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n = [], [], []
            for i, j, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("tokens_a"), batch.column("tokens_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=K.U64), np.frombuffer(y.as_buffer(), dtype=K.U64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                same = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                if 100 * same >= percent * (len(x) + len(y) - same):
                    a.append(i)
                    b.append(j)
                    n.append(same)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], schema=schema)

    return run


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 80, width: int = 5, prune: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id of each row: documents link when 100 * intersection >= percent * union of their n-grams."""
    return linked_rows(docs, id_column, text_column, percent, width, prune).select("doc_id", "n_shingles", "component_id")


def linked_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 80, width: int = 5, prune: bool = True) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), n_shingles, component_id and component of each row.

    component: one number for all rows of a component, null for rows without an n-gram. prune: whether the blocked product drops
    documents that cannot reach the bound before anything else; it changes no result.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(F.col(text_column)).alias("h"), F.col(text_column).alias("text"))
    members = table(texts.mapInArrow(_members(width), "doc_id long, h long, n long, held long, cls long, mark long"), "members")
    total, rows = members.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    blocks = max(1, -(-total * UNIVERSE // 256 // BLOCK_ENTRIES))
    ranges = max(MIN_RANGES, -(-rows // RANGE_ROWS))
    # The row that stands for a class: the smallest id, one with an id if there is any.
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("rep")
    classes = members.where("n > 0").groupBy("cls", "mark").agg(rep, F.first("n").alias("n"), F.first("held").alias("held"))

    close = classes
    if prune:
        # At most n - ceil(percent * n / 100) n-grams of a linked class are not in the other one, in all and among those tiled.
        bound = F.expr(f"held - (n - (n * {percent} + 99) div 100)")
        tiles = texts.select("text").mapInArrow(_tiles(blocks, width), "block int, payload binary")
        met = tiles.groupBy("block").applyInArrow(_met(ranges), "part int, payload binary").groupBy("part").applyInArrow(_sum_met, "cls long, met long")
        close = classes.join(met, "cls", "left").where(F.coalesce("met", F.lit(0)) >= bound)
    close = table(close.select(F.col("rep.doc_id").alias("rep_id"), F.col("rep.h").alias("rep_h"), "cls", "mark"), "close")
    asked = close.count()
    wanted = F.broadcast(close) if asked <= BROADCAST_ROWS else close
    own = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("h") == F.col("rep_h")))
    sets = table(own.select("cls", "mark", "text").mapInArrow(_sets(width), "node long, n long, tokens binary"), "sets")
    count, entries = sets.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if count > asked:  # repeated rows
        repeated, sets = sets, table(sets.dropDuplicates(["node"]), "sets")
        drop(repeated)

    # Posting lists of the prefix: a document's n-grams from the rarest on, those that it alone holds first of all; one more than
    # a partner may lack. If this n-gram is the first one that a pair shares, it shares at most what follows on either side, so
    # the partner has ``most`` n-grams at most.
    dealt = sets.select("node", "n", "tokens").mapInArrow(_entries(max(1, -(-entries // ENTRIES))), "block int, payload binary")
    spread = dealt.groupBy("block").applyInArrow(_spread(ranges), "part int, payload binary")
    kept = table(spread.groupBy("part").applyInArrow(_prefixes(percent), "node long, n long, most long, token long, df long"), "prefixes")
    # Of lists with the same classes the first one in that order is enough.
    lists = kept.groupBy("token").agg(F.count("*").alias("k"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sign"), F.min("node").alias("low"), F.first("df").alias("df")).where("k > 1")
    lists = lists.groupBy("k", "sign", "low").agg(F.min(F.struct("df", "token")).alias("first")).select("first.token")
    postings = table(kept.join(lists, "token"), "postings")
    labels = table(_link(postings, sets, percent), "labels")
    drop(close, sets, kept, postings)

    known = members.where("n > 0").groupBy("cls", "mark").agg(F.min("doc_id").alias("low"))
    labels = labels.union(labels.select(F.col("component").alias("node"), "component")).distinct()
    linked = known.join(labels, F.col("cls") == F.col("node")).select("cls", "component", "low")
    low = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    linked = linked.join(low, "component").select("cls", "component", "component_id").distinct()
    named = known.join(linked, "cls", "left").select("cls", "mark", F.coalesce("component", "cls").alias("component"), F.when(F.col("component").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("component_id"))
    out = members.join(named, ["cls", "mark"], "left")
    return out.select("doc_id", F.col("h").alias("text_hash"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "component")


def _link(postings: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the classes that link with another one."""
    size = F.expr(f"x.n * {percent} <= y.n * 100 and y.n * {percent} <= x.n * 100 and y.n <= x.most and x.n <= y.most")
    volume = postings.count()
    # The original of a group of near copies shares the most of its n-grams with the most others: the first pivot of its lists.
    common = table(postings.groupBy("node").agg(F.sum("df").alias("common")), "common")
    links = labels = None
    before = float("inf")
    for turn in range(PIVOT_ROUNDS + 1):
        if labels is None:
            now = postings.join(common, "node").select("token", "node", "n", "most", F.col("node").alias("label"), F.col("common").alias("rank"))
        else:
            now = postings.join(labels, "node", "left").select("token", "node", "n", "most", F.coalesce("component", "node").alias("label"), F.xxhash64("node", F.lit(turn)).alias("rank"))
        now = table(now, "labelled")
        # Of two partners, the larger one's side allows for more than its own size: pairs are those of such a one and any other.
        counts = now.groupBy("token", "label").agg(F.count("*").cast("double").alias("c"), F.count_if(F.expr("most >= n")).cast("double").alias("k"))
        counts = counts.groupBy("token").agg((F.sum("c") * F.sum("k") - F.sum(F.col("c") * F.col("k"))).alias("open"), F.sum("c").alias("c")).where("open > 0")
        left = counts.agg(F.sum("open")).first()[0] or 0
        if left == 0:
            drop(now)
            break
        last = left <= 4 * volume or left > before / 2 or turn == PIVOT_ROUNDS
        before = left
        if last:
            pairs = _tiled_pairs(now, counts.select("token", F.ceil(F.col("c") / TILE_ROWS).cast("int").alias("s")), percent).where("x.label <> y.label").where(size)
        else:
            pivot = now.groupBy("token").agg(F.max(F.struct("rank", "node", "n", "most", "label")).alias("p")).select("token", "p.node", "p.n", "p.most", "p.label")
            pairs = now.alias("x").join(pivot.alias("y"), "token").where("x.node <> y.node and x.label <> y.label").where(size)
        pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        own = sets.select("node", "tokens")
        pairs = pairs.join(own.toDF("a", "tokens_a"), "a").join(own.toDF("b", "tokens_b"), "b")
        found = table(pairs.select("a", "b", "tokens_a", "tokens_b").mapInArrow(_overlaps(percent), "a long, b long, overlap long"), "links")
        drop(now)
        links = found if links is None else links.union(found)
        labels = components(links)
        if last:
            break
    drop(common)
    if labels is None:
        return postings.sparkSession.createDataFrame([], "node long, component long")
    return labels


def _tiled_pairs(now: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """Pairs x, y of rows that share a token. A list of s * TILE_ROWS rows is cut into s * s tiles, each for one band of sizes and
    the bands beside it; sizes of partners differ by less than a band."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.1 / percent))).cast("int")
    rows = now.join(lists, "token").withColumn("at", F.expr("pmod(xxhash64(node), s)")).withColumn("band", F.when(F.col("s") > 1, band).otherwise(0))
    every = F.expr("sequence(0, s - 1)")
    x = rows.where("most >= n").withColumn("i", F.col("at")).withColumn("j", F.explode(every)).alias("x")
    near = F.when(F.col("s") > 1, F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).otherwise(F.array(F.lit(0)))
    y = rows.withColumn("j", F.col("at")).withColumn("i", F.explode(every)).withColumn("band", F.explode(near)).alias("y")
    return x.join(y, ["token", "band", "i", "j"])


def query(spark, sf_dir: str) -> DataFrame:
    """op2: five-word shingles of ``documents``, linked from a Jaccard similarity of 0.8 on."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\t-\r]', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents
), runs AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM words WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY 1),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM runs a JOIN runs b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, seen) AS (SELECT a, a FROM ends UNION SELECT ends.b, reach.seen FROM reach JOIN ends ON ends.a = reach.node),
low AS (SELECT node, min(seen) AS component FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN low ON low.node = d.doc_id
"""
