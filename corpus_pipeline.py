"""A corpus pipeline: toxic documents go, recurring lines go, near copies go, contaminated documents go, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
input. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm import bpe, decontamination, line_dedup, ngram_join, toxicity
from gazette.llm.shared import scratch, shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts as toxic go; it is fitted to labelled rows of this stage's input.

    Each row is judged by its whole text, repeated rows alike; null and empty texts get the model's intercept, which is no
    toxic score. Without labelled rows nothing goes. An empty table gives none.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, out="_score").where(F.col("_score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines and sentences that recur across documents go from all but the first one; n_chars follows the text.

    Every line of three words or more meets the template tree, as in op7's query, whatever its length.
    """
    out = line_dedup.dedup_lines(docs.select(*COLUMNS), tree=line_dedup.EVERY_LINE)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest id stays (ties: the smaller hash of the text; then any one).

    Rows are linked, not ids: of rows that share an id each is judged by its own text. Rows with no word (null, empty) are linked
    with nothing and all stay; a row without an id stays if nothing that it is linked with has one. An empty table gives none.
    """
    linked = table(ngram_join.linked_rows(docs).where("component is not null"), "linked")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = linked.groupBy("component").agg(F.count("*").alias("rows"), F.min(order).alias("first")).where("rows > 1").select("component", "first.*").toDF("component", "none", "first_id", "first_hash")
    joined = linked.join(first, "component").withColumn("stays", F.expr("doc_id <=> first_id and text_hash = first_hash"))
    own = docs.select(*COLUMNS).withColumn("own_hash", F.xxhash64("text"))

    def same(rows: DataFrame):
        return own["doc_id"].eqNullSafe(rows["doc_id"]) & (own["own_hash"] == rows["text_hash"])

    gone = joined.where("not stays").select("doc_id", "text_hash").distinct()
    kept = own.join(gone, same(gone), "left_anti")
    repeated = table(joined.where("stays").groupBy("doc_id", "text_hash").count().where("count > 1"), "repeated")
    if repeated.isEmpty():
        return kept.select(*COLUMNS)
    once = kept.join(repeated, kept["doc_id"].eqNullSafe(repeated["doc_id"]) & (kept["own_hash"] == repeated["text_hash"]), "left_semi").dropDuplicates(["doc_id", "own_hash"])
    others = kept.join(repeated, kept["doc_id"].eqNullSafe(repeated["doc_id"]) & (kept["own_hash"] == repeated["text_hash"]), "left_anti")
    return others.union(once).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Rows that share an id are one document and go together; rows without an id, with null or empty text, or of an empty
    benchmark stay. Long texts are searched whole.
    """
    hits = decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(hits, "doc_id", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what stays: one row a row, null texts as empty ones, long texts whole."""
    return bpe.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: Learning, template parsing and tokenizing have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``. What a stage wrote on its way goes when its result stands."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            path = f"{shared_dir(spark)}/stage-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
