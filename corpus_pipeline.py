"""Corpus pipeline over ``documents``: five stages of the text operators, each on all that the one before kept.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``. All but the last return the columns of
``documents``; columns that a caller adds pass through.

* language: documents without a letter or below ``MIN_LANGUAGE_SCORE`` go. The network learns
  from the rows with a language that are not held out, as in its query.
* near_duplicates: documents that share ``NEAR_PERCENT`` % of their ``NEAR_WORDS``-word shingles
  are linked; of each group of linked documents the one with the smallest id stays (of
  repeated rows of it, one).
* repeats: repeated strings of 100 bytes are cut out of the texts; a character cut in two goes
  whole; a text of which no word is left goes. ``n_chars`` follows the text.
* decontaminate: documents that a benchmark item contaminates go.
* encode: ids and decoded texts of what is left, as digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanscope.llm import bpe, jaccard, langid, rindex, tiling
from loanscope.llm.common import documents, fold_col
from loanscope.llm.queries import tokenizer_path
from loanscope.session import materialize, table_path

MIN_LANGUAGE_SCORE = 0.3
#: Near copies share 80 % of their five-word shingles (the thin query op5_jaccard: 85 % of four-word ones).
NEAR_WORDS, NEAR_PERCENT = 5, 80


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of ``docs`` is called so."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs.filter(fold_col("doc_id", 4) != 2))
    lang, score = unused(docs, "__lang", "__score")
    told = langid.predict(docs, model, lang_pred=lang, score=score)
    return told.filter((F.col(lang) != langid.UNDETERMINED) & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard.components(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)
    # One row of each component: the smallest id; sets without shingles are linked with nothing.
    order = Window.partitionBy("root").orderBy(F.col("doc_id").asc_nulls_last(), "h")
    linked = found.filter("root IS NOT NULL AND doc_id <=> component_id").withColumn("r", F.row_number().over(order)).filter("r = 1")
    k, h, k0, h0 = unused(docs, "__k", "__h", "__k0", "__h0")
    keep = linked.select(F.col("k").alias(k), F.col("h").alias(h))
    keys = docs.withColumn(k0, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn(h0, F.xxhash64(F.coalesce("text", F.lit(""))))
    # The join brings one row of each kept document, however often it is repeated.
    once = keys.join(keep, (F.col(k0) == F.col(k)) & (F.col(h0) == F.col(h)), "left_semi").dropDuplicates([k0, h0]).select(*docs.columns)
    empty = docs.filter(F.coalesce(F.col("text"), F.lit("")).rlike("^[\\x20\\x09-\\x0D]*$"))
    return once.union(empty.select(*docs.columns))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    blank = F.col("text").isNull()
    others = [c for c in docs.columns if c != "text"]
    (was,) = unused(docs, "__blank")
    told = rindex.remove_repeats(docs.withColumn(was, blank), with_text=True, keep=[*others, was])
    row = {c: F.col(f"row.c{i}") for i, c in enumerate([*others, was])}
    changed = F.col("n_removed") > 0
    fresh = {"text": F.when(~row[was], F.col("kept"))}
    if "n_chars" in row:
        fresh["n_chars"] = F.when(changed, F.length("kept")).otherwise(row["n_chars"]).cast(docs.schema["n_chars"].dataType)
    columns = [(fresh[c] if c in fresh else row[c]).alias(c) for c in docs.columns]
    return told.filter(~changed | F.col("kept").rlike("[^\\x20\\x09-\\x0D]")).select(*columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tiling.clean_rows(docs, spark.read.parquet(table_path(sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats),
          ("decontaminate", decontaminate), ("encode", encode)]

#: The language stage has no SQL form; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
