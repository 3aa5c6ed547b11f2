"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, archive, bands, ctw, decontam, langid, linecrf, packing, pii, resampling, simhash, sstable, toxicity
from .common import crc_mod, materialize, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_sorted_string_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = sstable.token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return ids.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_mod("doc_id", 4) == 2
    model = toxicity.learn_toxicity(docs, labels, ~held_out)
    scored = toxicity.toxicity(docs, model, "doc_id", "text", held_out.alias("held_out"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.withColumn("items_sha256", F.sha2(F.concat_ws(",", "items"), 256)).drop("items")


OP3_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
bi as (select item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) as i from b where len(w) > 0),
bw as (select distinct item_id, w[i:i + 12] as win from bi),
lens as (select distinct len(win) as n from bw),
di as (select doc_id, w, n, unnest(range(1, greatest(0, len(w) - n + 1) + 1)) as i from d, lens),
hit as (
  select di.doc_id, di.i, di.n, bw.item_id
  from di join bw on di.w[di.i:di.i + di.n - 1] = bw.win),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by 1),
its as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join pos using (doc_id) left join its using (doc_id)
"""


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 3) == 1
    filters = langid.learn_filters(docs, ~held_out)
    return langid.identify(docs, filters, "doc_id", "text", held_out.alias("held_out")).select("doc_id", "held_out", "lang_pred", "score")


def op7_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ctw.score_documents(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2)
    return scored.withColumn("held_out", ~F.col("trained")).drop("trained")


def op8_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_mod("doc_id", 5) == 0
    model = linecrf.learn_quality(docs, labels, ~held_out)
    scored = linecrf.line_quality(docs, model, "doc_id", "text", held_out.alias("held_out"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find_personal_data(docs, pii.learn_tagger(docs)).drop("redacted")


def op10_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.compression_bands(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    aligned = alignment.align(table(spark, sf_dir, "documents"), first, second)
    sha = F.when(F.col("n_groups") == 0, "").otherwise(F.sha2("groups", 256))
    links, _ = materialize(aligned.withColumn("groups_sha256", sha).drop("groups"), "links")
    width = len(alignment.encoder(second).bytes.size)
    scored = alignment.score_links(links, alignment.pair_counts(links, width))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = archive.write_archive(table(spark, sf_dir, "pages"))
    found = archive.captures(archive.read_archive(spark, written))
    return found.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP13_SQL = """
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, strlen(body) as payload_bytes, sha1(body) as payload_digest, max(page_id) over (partition by body) as last from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> last then last end as refers_to
from d
"""


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_sorted_string_table, op2_toxicity, op3_decontamination, op4_packing, op5_simhash, op6_language_id, op7_context_tree, op8_line_crf, op9_personal_data, op10_compression_bands, op11_token_alignment, op12_importance_resampling, op13_web_archive)
}

#: Tokenizers, XXH64, crc32, zstandard and trained models have no SQL in DuckDB; those queries are tested against brute force.
SQL: dict[str, str] = {"op3_decontamination": OP3_SQL, "op13_web_archive": OP13_SQL}
