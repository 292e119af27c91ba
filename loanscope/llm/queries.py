"""The registered queries ``opN_<name>`` over whole tables, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loanscope.session import table_path

from . import bpe, brown, jaccard, langid, lines, merkle, quality, repair, rindex, tiling, tokenfile, urlfilter, viterbi
from .common import documents, fold_col


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(documents(spark, sf_dir))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(documents(spark, sf_dir), spark.read.parquet(table_path(sf_dir, "benchmark")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.count_tokens(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", fold_col("doc_id", 4) == 2)
    model = langid.train(docs.filter("not held_out"))
    return langid.predict(docs, model, keep=["doc_id", "held_out"])


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rindex.remove_repeats(documents(spark, sf_dir)).drop("spans")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenfile.new_folder(spark)
    tokenfile.write_tokens(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), folder)
    return tokenfile.read_tokens(spark, folder)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest_columns(lines.remove_repeats(documents(spark, sf_dir)))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir), changed=merkle.tampered_leaf()).drop("proof")


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(spark.read.parquet(table_path(sf_dir, "pages")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(repair.turns_of(spark.read.parquet(table_path(sf_dir, "conversations")))))


QUERIES = {f.__name__: f for f in (op1_brown, op2_decontamination, op3_token_counts, op4_language, op5_jaccard,
                                    op6_bpe, op7_quality, op8_suffix_dedup, op9_token_files, op10_line_dedup,
                                    op11_merkle, op12_url_filter, op13_conversation_repair)}
SQL: dict[str, str] = {"op5_jaccard": jaccard.ORACLE, "op10_line_dedup": lines.ORACLE,
                       "op11_merkle": merkle.ORACLE, "op13_conversation_repair": repair.ORACLE}
