"""From raw documents to token ids, in four stages, each written as a table that the next one reads.

1. ``quality``: the line model scores each text; documents below 0.3 go. Null and empty texts are scored as well.
2. ``near_duplicates``: documents linked by a Jaccard similarity of 0.8 over five-word shingles form groups, of which
   one row stays: that of the least id, and of several rows with that id, the one whose text has the least digest.
   Documents without words (null, empty, white space) are in no group and all stay. A document without an id stays if its
   group has no id at all.
3. ``mixture``: sources take their targets' words; a document comes as often as its words are taken, whole, so documents
   of short sources come twice and some not at all. Fractions of a copy become one or none by a running sum over the
   documents of a source, from small to large within a chunk, so a source's copies come to its share whatever their
   sizes. Documents without words hold nothing to take and aren't in the mix.
4. ``tokens``: ids of every text of the mixture, with an end id, and a digest of the text that they decode to.

Columns beyond those of ``documents`` pass through the first three stages, whatever their names. Repeated rows are
documents each (of a group, one stays). An empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm import jaccard, line_crf, mixing, piece_codec
from lamina.llm.common import unused, written


def _digest(*columns: str) -> Column:
    """Of the columns' values together; null differs from the empty string."""
    return F.md5(F.to_json(F.struct(*(F.col(c) for c in columns))))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on labelled documents outside the held-out fold and keeps what scores 0.3 at least."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    crf = line_crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold != 0)
    score = unused(docs, "score")
    return line_crf.score(docs, crf, into=score).filter(F.col(score) >= 0.3).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group."""
    key = unused(docs, "key")
    digest = F.md5(F.coalesce("text", F.lit("")))
    linked = jaccard.link(docs.select("doc_id", "text"), percent=80, words=5, text_key=True).filter("class_id is not null")
    group = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("class_id"))]
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    stay = linked.groupBy(*(g.alias(f"g{i}") for i, g in enumerate(group))).agg(first.alias("one")).select(F.col("one.doc_id").alias("_stay_id"), F.col("one.text_key").alias("_stay_key"))
    worded = F.coalesce(F.col("text").rlike(jaccard.HAS_WORD), F.lit(False))
    keyed = docs.filter(worded).withColumn(key, digest)
    kept = keyed.join(stay, keyed["doc_id"].eqNullSafe(stay["_stay_id"]) & (keyed[key] == stay["_stay_key"]), "left_semi")
    return kept.dropDuplicates(["doc_id", key]).select(*docs.columns).unionByName(docs.filter(~worded))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    key, n, share = unused(docs, "key"), unused(docs, "n"), unused(docs, "share")
    keyed = docs.filter(mixing.words(F.col("text")) > 0).withColumn(key, _digest("doc_id", "source", "text"))
    mixed = mixing.copies(mixing.mix(keyed.select(key, "text", "source"), weights=(5, 2, 1), share=1.5, most=2.0, id_col=key).documents)
    # rows of one key are the same document: they share its copies, the first ones by one more
    shared = mixed.groupBy(F.col("doc_id").alias("_of")).agg(F.sum("copies").alias(share), F.count("*").alias("_rows")).filter(F.col(share) > 0)
    numbered = keyed.withColumn(n, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    joined = numbered.join(shared, numbered[key] == shared["_of"])
    times = (joined[share] / shared["_rows"]).cast("long") + (F.col(n) <= shared[share] % shared["_rows"]).cast("long")
    own = [numbered[c] for c in docs.columns]
    return joined.filter(times > 0).select(*own, F.explode(F.sequence(F.lit(1).cast("long"), times)).alias(n)).drop(n)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``ids``, ``n_tokens`` and ``decoded_sha256`` of each text."""
    both = piece_codec.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"), end=True)
    return both.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("mixing sources to target weights", mixture), ("SentencePiece encoding and decoding", tokens)]

#: Training, hashing and merging have no equivalent in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return docs
