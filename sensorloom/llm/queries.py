"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from . import decontaminate, html, lmscore, mixing, neardup, quality, substrings, tokenstore, toxicity, vectors
from .common import read



def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


QUERIES = {
    "op1_tokenstore": lambda spark, sf: tokenstore.report(read(spark, sf, "documents"), vocabulary()),
    "op2_html": lambda spark, sf: html.report(read(spark, sf, "pages")),
    "op3_vectors": lambda spark, sf: vectors.report(read(spark, sf, "embeddings")),
    "op4_lmscore": lambda spark, sf: lmscore.report(read(spark, sf, "documents")),
    "op5_quality": lambda spark, sf: quality.report(read(spark, sf, "documents"), read(spark, sf, "labels")),
    "op6_neardup": lambda spark, sf: neardup.report(read(spark, sf, "documents")),
    "op7_toxicity": lambda spark, sf: toxicity.report(read(spark, sf, "documents"), read(spark, sf, "labels")),
    "op8_substrings": lambda spark, sf: substrings.report(read(spark, sf, "documents")),
    "op9_decontaminate": lambda spark, sf: decontaminate.report(read(spark, sf, "documents"), read(spark, sf, "benchmark")),
    "op10_mixing": lambda spark, sf: mixing.report(read(spark, sf, "documents")),
}
ORACLE_SQL = {
    "op8_substrings": substrings.ORACLE_SQL,
    "op9_decontaminate": decontaminate.ORACLE_SQL,
}
