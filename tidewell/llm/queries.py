"""One query for each operator of this subpackage, over its whole table, and the SQL where there is any."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.llm import alignment, decontaminate, exact_dedup, language, mixing, near_dedup, outside_sql, pii, quality, substring_dedup, token_frames, url_filter, warc


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark, sf_dir):
    return near_dedup.find_near_duplicates(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark, sf_dir):
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op3_warc(spark, sf_dir):
    return warc.archive(_table(spark, sf_dir, "pages"))


def op4_quality(spark, sf_dir):
    out = quality.score_quality(_table(spark, sf_dir, "documents"))
    return out.select(*(F.round(c, 6).alias(c) if c.startswith("limit_") else c for c in out.columns))


def op5_mix(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "source", "mix_copy", "mix_copies", F.round("mix_rate", 6).alias("mix_rate"), "mix_key")


def op6_personal_data(spark, sf_dir):
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op7_language(spark, sf_dir):
    return language.identify_languages(_table(spark, sf_dir, "documents"))


def op8_token_frames(spark, sf_dir):
    import public_tokenizers

    return token_frames.token_output(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_decontaminate(spark, sf_dir):
    return decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("hits", "items")


def op10_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark, sf_dir):
    return exact_dedup.find_copies(_table(spark, sf_dir, "documents"))


def op12_alignment(spark, sf_dir):
    import public_tokenizers

    return alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f for f in (
        op1_near_dedup, op2_url_filter, op3_warc, op4_quality, op5_mix, op6_personal_data, op7_language, op8_token_frames,
        op9_decontaminate, op10_substring_dedup, op11_exact_dedup, op12_alignment
    )
}

#: SQL where SQL can express a query; the others are tested against brute force, exact round trips or held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": outside_sql.NEAR_DEDUP,
    "op3_warc": outside_sql.WARC,
    "op4_quality": outside_sql.quality_sql(),
    "op5_mix": mixing.mix_sql(),
    "op9_decontaminate": outside_sql.DECONTAMINATE,
    "op10_substring_dedup": outside_sql.SUBSTRINGS,
    "op11_exact_dedup": outside_sql.EXACT,
}
