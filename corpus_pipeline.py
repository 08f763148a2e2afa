"""Documents to training data: five stages, each one operator of millrace.llm.

Each stage's rows are written as Parquet and read again as the next one's docs. All but the last return the columns of
documents. Rows without a document id are kept like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, lang_id, line_dedup, mixing, pieces, shingles

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if its language is not told at least this well.
LEAST_SCORE = 0.4
#: Of the sets of five-word shingles, from which documents are linked.
SIMILARITY = 0.8
#: Shares go to this power: nearer to 1, fewer documents of frequent kinds are left out.
TEMPER = 0.9
#: Of the words, what the mixture is expected to keep.
SHARE = mixing.SHARE


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: rejects documents without a letter and those of which no language has two fifths of the words; sets lang
    where it was null."""
    common.ship(spark)
    model = lang_id.train(docs, F.lit(True))
    found = lang_id.predict(docs.select(*COLUMNS), model)
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: takes lines that many documents share out of all but one of them; no document goes."""
    common.ship(spark)
    kept = line_dedup.drop_shared_lines(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10's trie self-join of fingerprints, of five-word shingles, and min-wise hashes for what fingerprints miss at
    this similarity; every link is verified by the exact similarity of the sets of shingles. Of each group of linked
    documents, the one with the smallest id stays (one without an id only if none has one). Documents whose text is empty
    once lines have gone are one group. Of rows that repeat id and text, one stays."""
    common.ship(spark)
    return shingles.one_of_each(docs.select(*COLUMNS), words=5, similarity=SIMILARITY)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: samples documents so that sources, languages and topics come to their tempered shares, as far
    as SHARE of all words leaves room: kinds too rare for theirs are kept whole."""
    common.ship(spark)
    return mixing.mix(docs.select(*COLUMNS), temper=TEMPER, share=SHARE).filter("sampled").select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: ids with their end id, the pieces' byte spans in the text, the number of ids, and digests of ids and decoded
    text."""
    import public_tokenizers

    common.ship(spark)
    encoded = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    return encoded.select("doc_id", "ids", "begins", "ends", *pieces.digests())


STAGES = [("language", language), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("sentencepiece", encoding)]

#: The field of language labels is a learned model's, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = common.work_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = common.stage(stage(spark, docs, sf_dir), f"{folder}/{k}-{name}")
    return docs
