"""Benchmark decontamination: a size-partitioned MinHash containment search, verified by exact shingle containment.

Items fall into partitions by size (powers of two). Under one hash permutation an item keeps its smallest shingle hashes, as many
as its partition's upper size allows to be missing, and one more: a document that contains the wanted share of the item's
shingles must hold one of them, wherever in the document they stand and however long it is. So the search has no false
negative. Documents that meet a sketch are candidates; for these, the item's shingles in the document are counted as texts.

DataFrame operations only. Documents are streamed through a lookup of the sketches, which are broadcast while they number at
most ``BROADCAST_ROWS`` and joined by a shuffle beyond that; nothing grows with the square of anything.

Items of fewer words than the shingle are one shingle of their own width, looked for among the runs of that width of all documents.

Cases: null and empty texts have no shingle, contain nothing and are in nothing. Rows that share an id are one document; rows without
an id are not searched. Repeated items are one item if they share the id. Very long texts are searched whole. Empty tables give no
row. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import table

#: Rows of sketches or candidates (16 bytes each) that may be broadcast.
BROADCAST_ROWS = 1_000_000
_SPACES = "\t\n\x0b\x0c\r"


def words(text: str) -> Column:
    """Lower-cased words of a text, parted by ASCII white space."""
    flat = F.lower(F.coalesce(F.col(text), F.lit("")))
    flat = F.regexp_replace(flat, "[\\t-\\r]", " ")
    return F.array_remove(F.split(flat, " "), "")


def shingle_rows(df: DataFrame, key: str, widths: list[int]) -> DataFrame:
    """(key, width, shingle hash h, shingle text s) of every run of each of the widths; a text of fewer words has none."""
    w = df.select(F.col(key).alias("key"), words("text").alias("w"))
    runs = None
    for k in widths:
        at = w.where(F.size("w") >= k).select("key", "w", F.explode(F.sequence(F.lit(0), F.size("w") - k)).alias("p"))
        parts = [F.get("w", F.col("p") + j) for j in range(k)]
        rows = at.select("key", F.lit(k).alias("width"), F.xxhash64(*parts).alias("h"), F.concat_ws(" ", *parts).alias("s"))
        runs = rows if runs is None else runs.union(rows)
    return runs


def _fits(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", percent: int = 80, width: int = 5) -> DataFrame:
    """doc_id, item_id, n_shingles (the item's), n_shared, containment: pairs with 100 * n_shared >= percent * n_shingles."""
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).where("doc_id is not null")
    asked = items.select(F.col(item_column).alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null")
    sized = asked.withColumn("k", F.least(F.lit(width), F.size(words("text"))))
    # An item's width is its number of words where these are fewer: at most ``width`` values, most often one.
    widths = sorted(r[0] for r in sized.select("k").where("k > 0").distinct().collect()) or [width]
    own = None
    for k in widths:
        rows = shingle_rows(sized.where(F.col("k") == k), "item_id", [k])
        own = rows if own is None else own.union(rows)
    own = table(own.distinct().withColumnRenamed("key", "item_id"), "items")
    sizes = own.groupBy("item_id").agg(F.count("*").alias("n"))
    upper = F.pow(F.lit(2), F.floor(F.log2("n")) + 1).cast("long") - 1  # of the partition
    sketch = own.join(sizes, "item_id").withColumn("k", upper - F.ceil(upper * percent / 100) + 1)
    sketch = sketch.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("h", "s"))).where("rank <= k").select("item_id", "width", "h").distinct()
    runs = shingle_rows(texts, "doc_id", widths)
    found = table(runs.select("key", "width", "h").join(_fits(sketch), ["width", "h"]).select(F.col("key").alias("doc_id"), "item_id").distinct(), "found")

    candidates = texts.join(_fits(found.select("doc_id").distinct()), "doc_id")
    lookup = own.join(sizes, "item_id").select("item_id", "width", "h", "s", "n")
    met = shingle_rows(candidates, "doc_id", widths).withColumnRenamed("key", "doc_id").join(_fits(lookup), ["width", "h", "s"]).select("doc_id", "item_id", "n", "width", "s").distinct()
    pairs = met.groupBy("doc_id", "item_id", F.col("n").alias("n_shingles")).agg(F.count("*").alias("n_shared")).where(F.col("n_shared") * 100 >= F.col("n_shingles") * percent)
    pairs = pairs.join(found, ["doc_id", "item_id"], "left_semi")
    return pairs.select("doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: items of ``benchmark`` in ``documents``, from a containment of 0.8 of five-word shingles on."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id AS id, 'd' AS kind, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[\t-\r]', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT item_id, 'i', list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[\t-\r]', ' ', 'g'), ' '), lambda x: x <> '') FROM benchmark
), widths AS (SELECT DISTINCT least(5, len(w))::INT AS k FROM words WHERE kind = 'i' AND len(w) > 0
), runs AS (
  SELECT DISTINCT id, kind, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS s
  FROM words, widths WHERE len(w) >= k AND id IS NOT NULL AND (kind = 'd' OR k = least(5, len(w)))
), sizes AS (SELECT id AS item_id, count(*) AS n_shingles FROM runs WHERE kind = 'i' GROUP BY 1)
SELECT d.id AS doc_id, z.item_id, z.n_shingles, count(*) AS n_shared, count(*) / z.n_shingles AS containment
FROM runs d JOIN runs i ON d.s = i.s AND d.k = i.k AND d.kind = 'd' AND i.kind = 'i' JOIN sizes z ON z.item_id = i.id
GROUP BY 1, 2, 3 HAVING count(*) * 100 >= z.n_shingles * 80
"""
