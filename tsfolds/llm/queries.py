"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsfolds.llm.licences import scan_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_minhash_dedup(spark, sf_dir):
    from tsfolds.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


@query
def op2_embedding_dedup(spark, sf_dir):
    from tsfolds.llm.vectors import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


@query
def op3_multiset_fingerprint(spark, sf_dir):
    from tsfolds.llm.fingerprints import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


@query
def op4_licence_digest(spark, sf_dir):
    from tsfolds.llm.licences import scan

    return scan(table(spark, sf_dir, "documents"))


SQL["op4_licence_digest"] = scan_sql()


@query
def op5_pii_crf(spark, sf_dir):
    from tsfolds.llm import pii

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("pii", lambda s: (s["kind"] == kind) & s["base"])).cast("long").alias(f"n_{kind}")
    base = joined(F.filter("pii", lambda s: s["base"]))
    return pii.find(docs, pii.fit(docs)).select("doc_id", *map(count, pii.KINDS), F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


@query
def op6_quality_crf(spark, sf_dir):
    from tsfolds.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fitted = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, fitted).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op7_substring_dedup(spark, sf_dir):
    from tsfolds.llm.repeats import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query
def op8_sentencepiece(spark, sf_dir):
    import public_tokenizers

    from tsfolds.llm import pieces

    vocabulary = pieces.read_vocabulary(public_tokenizers.path(pieces.VOCABULARY))
    ids = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    # texts are compared by their digests: Arrow batches for the decoder hold the ids only
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    out = pieces.decode(ids.select("doc_id", digest(F.coalesce("text", F.lit(""))).alias("given"), "ids"), vocabulary)
    joined = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    same = (digest(F.col("decoded")) == F.col("given")).alias("round_trip")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), same)


@query
def op9_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    from tsfolds.llm.packing import VOCABULARY, pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


@query
def op10_host_paths(spark, sf_dir):
    from tsfolds.llm.html import main_text

    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op11_spelling_variants(spark, sf_dir):
    from tsfolds.llm import spelling

    return spelling.variants(spelling.words(table(spark, sf_dir, "documents"), typo_every=97))


@query
def op12_language_cnn(spark, sf_dir):
    from tsfolds.llm import langnet
    from tsfolds.llm.quality import held_out

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langnet.predict(docs.select("doc_id", "text"), langnet.fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op13_conversation_repair(spark, sf_dir):
    from tsfolds.llm import dialogue
    from tsfolds.session import cut

    rows = dialogue.damage(table(spark, sf_dir, "conversations"))
    plans = cut(dialogue.audits(rows))
    sha = dialogue.digests(dialogue.repair(rows, plans)).withColumnRenamed("conv_id", "_id")
    out = plans.join(sha, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha256", empty).alias("repaired_sha256"))
