"""The query and SQL of each corpus operator."""

from __future__ import annotations

from . import ann, embedding_dedup, fim, hard_negatives, html_extract, language_id, line_dedup, mixing, near_dedup, packing, substring_dedup, token_files, url_filter
from .common import table


def op1_html_extract(spark, sf_dir):
    return html_extract.digest(table(spark, sf_dir, "pages"))


def op2_mixing(spark, sf_dir):
    return mixing.digest(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark, sf_dir):
    return near_dedup.digest(table(spark, sf_dir, "documents"))


def op4_url_filter(spark, sf_dir):
    return url_filter.digest(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark, sf_dir):
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op6_packing(spark, sf_dir):
    return packing.digest(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark, sf_dir):
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op8_language_id(spark, sf_dir):
    return language_id.digest(table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.digest(table(spark, sf_dir, "embeddings"))


def op10_ann(spark, sf_dir):
    return ann.digest(table(spark, sf_dir, "embeddings"))


def op11_fill_in_middle(spark, sf_dir):
    return fim.digest(table(spark, sf_dir, "documents"))


def op12_token_files(spark, sf_dir):
    return token_files.digest(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark, sf_dir):
    return hard_negatives.digest(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_mixing": op2_mixing,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_line_dedup": op5_line_dedup,
    "op6_packing": op6_packing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_language_id": op8_language_id,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_ann": op10_ann,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_token_files": op12_token_files,
    "op13_hard_negatives": op13_hard_negatives,
}
#: op1, op6, op8, op12: a model or a tokenizer; op2: the order of a hash that DuckDB lacks; op10: an approximate index.
ORACLES = {
    "op3_minhash_near_dedup": near_dedup.ORACLE,
    "op4_url_filter": url_filter.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op7_substring_dedup": substring_dedup.ORACLE,
    "op9_embedding_near_dedup": embedding_dedup.ORACLE,
    "op11_fill_in_middle": fim.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
