"""The registered queries of this package, each over its whole tables."""

from __future__ import annotations

from revlumen.llm import chunk_dedup, filter_audit, fuzzy_lines, hilbert, language, minhash, mixing, neighbours, phrase_index
from revlumen.llm import ranked_search, secret_ledger, token_store, url_filter
from revlumen.llm.common import read_table


def op1_secret_ledger(spark, folder):
    return secret_ledger.documents_query(spark, read_table(spark, folder, "documents"))


def op2_token_store(spark, folder):
    return token_store.documents_query(read_table(spark, folder, "documents"))


def op3_content_chunks(spark, folder):
    return chunk_dedup.documents_query(read_table(spark, folder, "documents"))


def op4_hilbert_shards(spark, folder):
    return hilbert.documents_query(read_table(spark, folder, "documents"))


def op5_circulant_minhash(spark, folder):
    return minhash.documents_query(read_table(spark, folder, "documents"))


def op6_language(spark, folder):
    return language.documents_query(read_table(spark, folder, "documents"))


def op7_budget_mix(spark, folder):
    return mixing.documents_query(read_table(spark, folder, "documents"))


def op8_one_bit_codes(spark, folder):
    return neighbours.embeddings_query(read_table(spark, folder, "embeddings"))


def op9_fuzzy_lines(spark, folder):
    return fuzzy_lines.documents_query(read_table(spark, folder, "documents"))


def op10_phrase_index(spark, folder):
    return phrase_index.documents_query(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op11_url_models(spark, folder):
    return url_filter.pages_query(read_table(spark, folder, "pages"))


def op12_filter_audit(spark, folder):
    return filter_audit.documents_query(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op13_ranked_search(spark, folder):
    return ranked_search.documents_query(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


QUERIES = {
    "op1_secret_ledger": op1_secret_ledger,
    "op2_token_store": op2_token_store,
    "op3_content_chunks": op3_content_chunks,
    "op4_hilbert_shards": op4_hilbert_shards,
    "op5_circulant_minhash": op5_circulant_minhash,
    "op6_language": op6_language,
    "op7_budget_mix": op7_budget_mix,
    "op8_one_bit_codes": op8_one_bit_codes,
    "op9_fuzzy_lines": op9_fuzzy_lines,
    "op10_phrase_index": op10_phrase_index,
    "op11_url_models": op11_url_models,
    "op12_filter_audit": op12_filter_audit,
    "op13_ranked_search": op13_ranked_search,
}
