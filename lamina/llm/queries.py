"""One query for each operator of this subpackage, over its whole tables, and the SQL where there is any."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import ann, jaccard, line_crf, mixing, ngram_lm, piece_codec, sharding, syncmers, token_counts, wavelet


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5)


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = piece_codec.round_trip(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), end=True)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir), 16).withColumn("grown_shard", F.lit(None).cast("int"))


def op4_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = wavelet.write_shards(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return wavelet.read_documents(shards).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def op5_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare(_documents(spark, sf_dir))


def op6_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(_documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_documents(spark, sf_dir), weights=(5, 2, 1), share=1.5, most=2.0)
    return mixed.documents.select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(_documents(spark, sf_dir), percent=85, words=4).select("doc_id", "n_shingles", "component_id")


def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = _documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")) % 5
    crf = line_crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold != 0)
    scored = line_crf.score(docs.select("doc_id", "text"), crf)
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


# What SQL can say of operators whose whole result it can't.


def part2_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts decoded from their ids: as they were, but for the piece that stands for a space."""
    return op2_piece_codec(spark, sf_dir).select("doc_id", "decoded_sha256")


def part3_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, and whether a row's shard has as many rows as slots from 0."""
    sharded = op3_sharding(spark, sf_dir)
    slots = sharded.groupBy("shard").agg((F.countDistinct("slot") == F.count("*")).alias("own"), (F.max("slot") + 1 == F.count("*")).alias("gapless"))
    return sharded.join(slots, "shard").select("doc_id", "size", "law", F.col("shard").between(0, 15).alias("known"), "own", "gapless")


def part4_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the documents' runs of ids follow one another without a gap, in the order of their ids."""
    read = op4_wavelet(spark, sf_dir)
    last = read.select((F.col("doc_id") + 1).alias("doc_id"), (F.col("start") + F.col("n_tokens")).alias("ended"))
    return read.join(last, "doc_id", "left").select("doc_id", (F.col("start") == F.coalesce("ended", F.lit(0))).alias("follows"), (F.col("n_tokens") > 0).alias("ends"))


def part5_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited texts."""
    return op5_syncmers(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def part7_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources' sizes and targets, and whether a source's taken words come within a block of its target and no document
    is taken more than twice."""
    taken = op7_mixing(spark, sf_dir).groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max(F.col("taken") > 2 * F.col("size")).alias("beyond"))
    return taken.select("source", "source_size", F.round("target", 4).alias("target"), (F.abs(F.col("taken") - F.col("target")) <= 129).alias("near"), "beyond")


def part8_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, and that no text has more tokens than bytes."""
    return op8_token_counts(spark, sf_dir).select("doc_id", "n_bytes", (F.col("n_tokens") <= F.col("n_bytes")).alias("fewer"))


QUERIES = {
    "op1_ann": op1_ann,
    "op2_piece_codec": op2_piece_codec,
    "op3_sharding": op3_sharding,
    "op4_wavelet": op4_wavelet,
    "op5_syncmers": op5_syncmers,
    "op6_ngram_lm": op6_ngram_lm,
    "op7_mixing": op7_mixing,
    "op8_token_counts": op8_token_counts,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_line_crf": op10_line_crf,
    "part2_round_trip": part2_round_trip,
    "part3_sizes": part3_sizes,
    "part4_lengths": part4_lengths,
    "part5_edits": part5_edits,
    "part7_targets": part7_targets,
    "part8_bytes": part8_bytes,
}
_OP1_SQL = """
with v as (select vec_id, embedding::double[] e from embeddings where list_count(embedding) = len(embedding)
    and list_bool_and(list_transform(embedding, lambda x: isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
n as (select vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda x, y: x + y)) norm from v),
s as (select q.vec_id query_id, c.vec_id, list_reduce(list_transform(list_zip(c.e, q.e), lambda t: t[1] * t[2]), lambda x, y: x + y) / (c.norm * q.norm) score
    from n q join n c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int "rank" from s)
select query_id, "rank", vec_id, score from r where "rank" <= 5
"""

_OP9_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
g as (select distinct doc_id, shingle from (select doc_id, unnest(case when len(ws) >= 4 then list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) shingle from w)),
n as (select doc_id, count(*) n from g group by 1),
i as (select a.doc_id a, b.doc_id b, count(*) i from g a join g b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
e as (select a, b from l union all select b, a from l),
r(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, e.b from r join e on e.a = r.other)
select r.doc_id, coalesce(any_value(n.n), 0)::bigint n_shingles, min(r.other) component_id from r left join n on n.doc_id = r.doc_id group by 1
"""

_PART5_SQL = """
with d as (select doc_id, coalesce(text, '') t from documents),
n as (select doc_id, t, coalesce(lead(t) over (order by doc_id), first_value(t) over (order by doc_id)) follows, length(t) // 4 k from d)
select doc_id, length(t) n_chars, sha256(left(t, length(t) - k) || left(follows, k)) edited_sha256 from n
"""

_PART7_SQL = r"""
with recursive w as (select source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::bigint size from documents group by 1),
s as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end weight from w),
-- shares by weight; whatever is above twice its size stops there, and what is left is shared again
r as (select 0 turn, source, size, weight, false stopped, 1.5 * sum(size) over () * weight / sum(weight) over () share from s
    union all
    select turn + 1, source, size, weight, stopped or share > 2 * size,
        case when stopped or share > 2 * size then 2.0 * size
            else (1.5 * sum(size) over () - sum(case when stopped or share > 2 * size then 2.0 * size else 0 end) over ()) * weight
                / sum(case when stopped or share > 2 * size then 0 else weight end) over () end
    from r where turn < 60)
select source, size source_size, round(share::double, 4) target, true near, false beyond from r where turn = 60
"""

#: The first holds where the graph search finds all true neighbours, as on tables of few vectors.
ORACLE: dict[str, str] = {
    "op1_ann": _OP1_SQL,
    "op9_jaccard_join": _OP9_SQL,
    "part2_round_trip": "select doc_id, sha256(replace(coalesce(text, ''), '▁', ' ')) decoded_sha256 from documents",
    "part3_sizes": "select doc_id, strlen(coalesce(text, '')) + 1 size, 'bytes' law, true known, true own, true gapless from documents",
    "part4_lengths": "select doc_id, true follows, true ends from documents",
    "part5_edits": _PART5_SQL,
    "part7_targets": _PART7_SQL,
    "part8_bytes": "select doc_id, strlen(coalesce(text, '')) n_bytes, true fewer from documents",
}
