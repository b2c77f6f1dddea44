"""A corpus pipeline: language ID, near-dedup, decontamination, secret masking, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, common, decontaminate, langid, minhash, secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is undetermined (null texts and texts without a letter), and those that no learnt language
    explains better than n-grams drawn alike. Where nothing could be learnt, texts with a letter stay."""
    s = langid.Settings()
    model = langid.train(docs, s)
    if not model.languages:
        return docs.select(*COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    out = langid.identify(docs, model, s, keep=COLUMNS)
    return out.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("evidence") > 0)).select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with a number for each row, written so that it stays the same: ids may be null or repeated."""
    common.release(docs.sparkSession)
    return common.cut(docs.select(F.monotonically_increasing_id().alias("row"), *COLUMNS))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group (five-word shingles); rows without an id stay.

    Rows are told apart by their number: different texts under one id both stay, and equal rows count once.
    """
    rows = numbered(docs)
    named = rows.where("doc_id is not null")
    found = common.cut(minhash.near_duplicates(named, minhash.Settings(shingle=5), doc="row").select("row", "n_shingles", "component_id"))
    facts = named.select("row", "doc_id", F.sha2("text", 256).alias("same")).join(found, "row")
    # a text without shingles is near to nothing, but equal to its own copies under the same id
    bare = F.coalesce(F.col("n_shingles"), F.lit(0)) == 0
    group = [F.when(~bare, F.col("component_id")).alias("c"), F.when(bare, F.col("doc_id")).alias("d"), F.when(bare, F.col("same")).alias("t")]
    kept = facts.groupBy(*group).agg(F.min(F.struct("doc_id", "row")).alias("first")).select(F.col("first.row").alias("row"))
    return named.join(kept, "row", "left_semi").select(*COLUMNS).unionByName(rows.where("doc_id is null").select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more lies in windows of benchmark items; each row is judged by itself."""
    rows = numbered(docs)
    flags = decontaminate.decontaminate(rows, common.table(spark, sf_dir, "benchmark"), doc="row")
    return rows.join(flags.where("contaminated").select("row"), "row", "left_anti").select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every span of a secret; n_chars follows where the text changes."""
    s = secrets.Settings()
    out = secrets.scan(docs, secrets.train(docs, s), s, keep=COLUMNS, mask="[SECRET]")
    changed = F.length("spans") > 0
    return out.select("doc_id", F.col("masked").alias("text"), "lang", "source", F.when(changed, F.char_length("masked").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text and decodes it again."""
    return bpe.encode(docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("bpe", bpe_stage),
]

#: SQL cannot express language ID, sketches or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet in the shared folder and read again by the next."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = common.scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
