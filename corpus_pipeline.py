"""A training corpus from documents: language, near duplicates, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written and read back as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsubo.llm import langid, mixing, ngrams, packing, pii
from tsubo.llm.common import stored, table
from tsubo.llm.queries import tokenizer_path
from tsubo.session import apply_settings, ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_LANGUAGE_SCORE = 0.4
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80

# the stages are no SQL: a trained model and a tokenizer decide; tests compare with brute force
ORACLE_SQL = None


def _ready(spark: SparkSession) -> None:
    ship_package(spark)
    apply_settings(spark)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets lang to the predicted language; documents without letters or without a clear language go."""
    _ready(spark)
    judged = langid.predict(docs, langid.fit(docs), keep=COLUMNS)
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(
        "doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: the one with the smallest id. Null ids stay.

    Rows that repeat an id and its text are one document, of which the row with the smallest lang, source and n_chars
    stays; rows that repeat an id with different texts all stay with it.
    """
    _ready(spark)
    groups = ngrams.similar_documents(docs.select("doc_id", "text"), SHINGLE_WORDS, SIMILAR_PERCENT)
    stay = groups.where("doc_id = component_id").select("doc_id").distinct()
    docs = docs.select(*COLUMNS)
    kept = docs.join(stay, "doc_id", "left_semi").groupBy("doc_id", F.sha2("text", 256).alias("_digest")).agg(
        F.min(F.struct("lang", "source", "n_chars", "text")).alias("_row")).select("doc_id", "_row.*").select(*COLUMNS)
    return kept.unionByName(docs.where("doc_id IS NULL"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    _ready(spark)
    found = pii.find(docs, pii.fitted(docs), keep=COLUMNS, with_text=True)
    text = F.when(F.col("text").isNotNull(), F.col("redacted"))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("bigint").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it; one without words comes once at most."""
    _ready(spark)
    taken = mixing.mix(docs, carry=("text", "lang", "n_chars")).where("times > 0").withColumn(
        "times", F.when(F.col("size") == 0, F.lit(1).cast("int")).otherwise(F.col("times").cast("int")))
    return taken.withColumn("_again", F.explode(F.sequence(F.lit(1), "times"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document row with their place in a training sequence."""
    _ready(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
