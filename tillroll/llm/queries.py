"""Registered queries of the corpus operators."""

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from tillroll.llm import (
    additive_model,
    collocations,
    decontamination,
    license_scan,
    ordinal_toxicity,
    passages,
    ranked_search,
    retrieval_packing,
    rule_ledger,
    shingle_join,
    simhash,
    warc,
)
from tillroll.llm.common import table
from tillroll.llm.oracles import oracle_sql
from tillroll.llm.token_counts import token_counts
from tillroll.sources.scratch import scratch_path

__all__ = ["oracle_sql", "queries"]

TOKEN_LIMIT = 4096


def op1_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts(docs, model, TOKEN_LIMIT).select("doc_id", "counted.*")


def op2_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    _, found = passages.repeated_passages(docs)
    return found.select(
        "doc_id",
        F.col("start").alias("start_word"),
        F.col("end").alias("end_word"),
        "first_doc_id",
        F.col("first_start").alias("first_start_word"),
        F.col("first_end").alias("first_end_word"),
        F.col("common").alias("common_words"),
    )


def op3_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    path = scratch_path(spark, "warc")
    warc.write_warc(pages, path, row_id="page_id", uri="url", payload="html")
    return warc.read_warc(spark, path, payloads=False).select(
        F.col("row_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("kind").alias("record_type"),
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op4_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = rule_ledger.with_ledger(docs)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return ledger.select(
        "doc_id",
        *[f"measures.{name}" for name in names],
        rule_ledger.rejected("base").alias("base_failed"),
        (~rule_ledger.rejected("v2")).alias("kept"),
        F.col("failed").alias("failed_rules"),
    )


def op7_decontamination(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    documents, hits = decontamination.contamination(docs, items)
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce(F.array_join("items", ","), F.lit(""))
    return (
        documents.select("key", "doc_id", "n_words")
        .join(hits, "key", "left")
        .select(
            "doc_id",
            "n_words",
            n_hit.alias("n_hit"),
            F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
            F.sha2(ids, 256).alias("items_sha256"),
            (n_hit > 0).alias("contaminated"),
        )
    )


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = ordinal_toxicity.fit_toxicity(docs, labels)
    graded = ordinal_toxicity.with_grades(docs, model)
    return graded.select("doc_id", "toxicity.*")


def op5_license_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_scan.with_licenses(docs).select("doc_id", F.explode("licenses").alias("found"))
    return found.select("doc_id", "found.*")


def op6_retrieval_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return retrieval_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def held_out(doc_id="doc_id"):
    """True for the fifth of the documents no label is learned from (null counts as '')."""
    as_text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(as_text.cast("binary")) % 5 == 0


def op9_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~held_out())
    model = additive_model.fit_quality(docs, labels)
    return additive_model.with_quality(docs, model).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op10_shingle_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shingle_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


def op11_simhash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select(
        "doc_id", simhash.hex_digits("fingerprint").alias("fingerprint"), "component_id"
    )


def op12_ranked_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return ranked_search.ranked(docs, items, limit=20)


def op13_collocations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    return collocations.collocations(docs)


def queries():
    return {
        "op1_token_counts": op1_token_counts,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_warc": op3_warc,
        "op4_quality_rules": op4_quality_rules,
        "op5_license_scan": op5_license_scan,
        "op6_retrieval_packing": op6_retrieval_packing,
        "op7_decontamination": op7_decontamination,
        "op8_toxicity": op8_toxicity,
        "op9_quality": op9_quality,
        "op10_shingle_join": op10_shingle_join,
        "op11_simhash": op11_simhash,
        "op12_ranked_search": op12_ranked_search,
        "op13_collocations": op13_collocations,
        "pipeline": corpus_pipeline.run,
    }
