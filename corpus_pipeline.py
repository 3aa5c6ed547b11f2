"""A cleaning pipeline over documents, stage by stage, with the operators of textloom.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontam, langid, packing, pii, simhash
from textloom.llm.common import materialize, table

#: A document whose best language contains less of its n-grams than this is in none of the learned languages.
LEAST_KNOWN = 0.15
#: A language of fewer labelled documents than ENOUGH_DOCS, or a text of fewer letters than ENOUGH_LETTERS, is too thin to judge by.
ENOUGH_DOCS, ENOUGH_LETTERS = 100, 100


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and texts in none of the learned languages, go.

    Where no language is labelled, or none has an n-gram of its own (a handful of documents), nothing can be said, and
    only texts without a letter go.  Nothing is held out from learning here, and no text goes whose label or best
    candidate is a language of few documents, or that is short.
    """
    filters = langid.learn_filters(docs, F.lit(True), thin=ENOUGH_DOCS)
    judged = [r.lang for r in docs.where(F.col("lang").isNotNull()).groupBy("lang").count().where(F.col("count") >= ENOUGH_DOCS).collect()]
    columns = [F.col(c).alias(f"own_{i}") for i, c in enumerate(docs.columns)]
    told = langid.identify(docs, filters, "doc_id", "text", *columns)
    if filters.slots.any():
        label, text = (F.col(f"own_{docs.columns.index(c)}") for c in ("lang", "text"))
        thin = ~F.col("lang_pred").isin(judged) | F.coalesce(~label.isin(judged), F.lit(False))
        kept = told.where((F.col("lang_pred") != "und") & ((F.col("known") >= LEAST_KNOWN) | thin | (F.length(F.regexp_replace(text, r"\P{L}+", "")) < ENOUGH_LETTERS)))
    else:
        kept = told.where(F.col(f"own_{docs.columns.index('text')}").rlike(r"\p{L}"))
    return kept.select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: the one of smallest id (of equal ids, the first by text and source).

    Rows are told apart by their group, not by their id: ids may be repeated or null.
    """
    own = [F.col(c).alias(f"own_{i}") for i, c in enumerate(docs.columns)]
    rows = simhash.grouped_rows(docs, "doc_id", "text", 4, 4, *own)
    first = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    by = sorted(range(len(docs.columns)), key=lambda i: (["text", "source"].index(docs.columns[i]) if docs.columns[i] in ("text", "source") else 2, i))
    kept = first.groupBy("root").agg(F.min(F.struct(*[f"own_{i}" for i in by])).alias("row"))
    return kept.select(*[F.col(f"row.own_{i}").alias(c) for i, c in enumerate(docs.columns)])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule holds against the benchmark go.

    The rule looks at the text alone, so rows meet their verdict by their text: ids may be repeated or null.
    """
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    hits = decontam.decontaminate(docs.select(key.alias("key"), "text"), table(spark, sf_dir, "benchmark"), "key")
    found = hits.where("contaminated").select(F.col("doc_id").alias("hit_key")).distinct()
    return docs.join(found, key == F.col("hit_key"), "left_anti")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes [EMAIL], [IP], [CARD] or [PHONE]; every document stays."""
    columns = [F.col(c).alias(f"own_{i}") for i, c in enumerate(docs.columns) if c != "text"]
    found = pii.find_personal_data(docs, pii.learn_tagger(docs), "doc_id", "text", *columns)
    out = {c: F.col(f"own_{i}") for i, c in enumerate(docs.columns)} | {"text": F.col("redacted")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length("redacted").cast(docs.schema["n_chars"].dataType)
    return found.select(*[out[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens; one row a piece."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("personal_data", redact), ("packing", pack)]

#: Tokenizers, XXH64 and trained models have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
