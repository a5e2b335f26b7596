"""The corpus pipeline: five stages over ``documents``, each one of the operators of ``tsfolds.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  Nulls, empty texts and repeated rows are handled as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsfolds.llm import minhash, packing, pii, quality, repeats, text
from tsfolds.session import cut


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of documents among ``docs``, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    own = docs.columns
    return quality.classify(docs, quality.fit(docs, labels)).where("predicted = 1").select(*own)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, similarity 0.8): the one of the least doc_id, a
    row without doc_id only where no row of the group has one.  Rows are told apart by doc_id and text; of
    rows that agree in both, one stays.  Texts go through the join compressed."""
    key = ["_id", "_node"]
    keyed = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_node": F.shiftright(F.xxhash64("doc_id", "text"), 1)})
    found = minhash.near_duplicates(keyed.select(F.col("_node").alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias("_node"), "component_id").distinct()
    rows = keyed.select(F.col("doc_id").isNull().alias("nameless"), *key).distinct().join(found, "_node")
    one = rows.groupBy("component_id").agg(F.min(F.struct("nameless", *key)).alias("one")).select("one._id", "one._node")
    packed = keyed.transform(text.arrow, text.packed, text.with_type(keyed.schema, "text", "binary"))
    # equal rows meet inside a task first, however many there are
    kept = packed.dropDuplicates(key).join(one, key, "left_semi").select(*docs.columns)
    return kept.transform(text.arrow, text.unpacked, docs.schema)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages; a text that loses none stays as it is."""
    changed = repeats.remove_repeats(docs)
    kept = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return _with_text(changed, kept, docs.columns)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which personal data is replaced by its kind in brackets."""
    return _with_text(pii.mask(docs, pii.fit(docs)), F.col("text"), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences of 1024 ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(packing.VOCABULARY))


def _with_text(df: DataFrame, new, columns: list[str]) -> DataFrame:
    df = df.withColumn("text", new)
    if "n_chars" in columns:
        df = df.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType))
    return df.select(*columns)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_near_duplicates),
    ("repeats", without_repeats),
    ("pii", without_pii),
    ("packing", packed),
]

ORACLE_SQL = None  # trained models and tokenizers are beyond SQL; tests/llm holds brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
