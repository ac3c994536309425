"""The registered queries of the corpus operators, with production parameters, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fill_in_middle, jaccard_join, line_dedup, media, mixing, packing, quality_classifier, quality_rules, sentencepiece_backend, toxicity, url_filter, warc, whitening
from .common import crc_fold, read

URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), (1 - F.col("quality")).alias("bad"))
    return url_filter.judged(read(spark, sf_dir, "pages"), labels, URL_RULES)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents"), width=4, percent=85)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, held_out = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), crc_fold(F.col("doc_id"), 5) == 0
    ranker = quality_classifier.fit(docs, labels.filter(~held_out))
    scored = quality_classifier.scored(docs, ranker, mark="score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality_classifier.CUT).cast("int").alias("predicted"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_backend.through_codec(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 1024)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")
    return quality_rules.judged(read(spark, sf_dir, "documents")).select("doc_id", *[f"__rules.{x}" for x in names])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.deduplicated(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "__lines.n_lines", "__lines.n_dropped", F.md5("text").alias("text_md5"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, held_out = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), crc_fold(F.col("doc_id"), 3) == 1
    tagger = toxicity.fit(docs, labels.filter(~held_out))
    rows, score = toxicity.tagged(docs, tagger), F.col("__toxicity.score")
    return rows.select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= 0.7).cast("int").alias("predicted"), F.size("__toxicity.spans").alias("n_spans"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.through_archive(read(spark, sf_dir, "pages"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.through_storage(read(spark, sf_dir, "documents"))
    feature = F.concat_ws(":", "dhash", F.lower(F.hex(F.crc32(F.aggregate("tiles", F.lit(b""), lambda a, b: F.concat(a, b))))))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fim = fill_in_middle.transformed(read(spark, sf_dir, "documents")), F.col("__fim")
    back = fill_in_middle.restored(fim["output"], fim["form"])
    return rows.select("doc_id", "__fim.n", "__fim.form", "__fim.prefix_chars", "__fim.middle_chars", F.sha2(fim["output"].cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, mix = mixing.planned(read(spark, sf_dir, "documents")), F.col("__mix")
    return rows.select("doc_id", mix["size"].alias("size"), mix["source_size"].alias("source_size"), mix["target"].alias("target"), (mix["size"] * mix["copies"]).alias("taken"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_jaccard_join, op3_quality_classifier, op4_sentencepiece, op5_packing, op6_quality_rules, op7_line_dedup, op8_toxicity, op9_warc, op10_media, op11_fill_in_middle, op12_mixing, op13_whitening)}
ORACLE_SQL = {"op7_line_dedup": line_dedup.oracle_sql(), "op9_warc": warc.ORACLE_SQL, "op11_fill_in_middle": fill_in_middle.ORACLE_SQL, "op12_mixing": mixing.ORACLE_SQL}
