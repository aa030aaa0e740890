"""Registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import op01_quality, op02_language, op03_fertility, op04_embeddings, op05_toxicity, op06_minhash, op07_packing, op08_hosts, op09_secrets, op10_mixture, op11_decontaminate, op12_middle, op13_phrases

QUERIES = {
    "op1_quality_ftrl": op01_quality.op1_quality_ftrl,
    "op2_language_mixture": op02_language.op2_language_mixture,
    "op3_tokenizer_fertility": op03_fertility.op3_tokenizer_fertility,
    "op4_pca_tiles": op04_embeddings.op4_pca_tiles,
    "op5_toxicity_neighbours": op05_toxicity.op5_toxicity_neighbours,
    "op6_minhash_bayes": op06_minhash.op6_minhash_bayes,
    "op7_hilbert_packing": op07_packing.op7_hilbert_packing,
    "op8_host_reputation": op08_hosts.op8_host_reputation,
    "op9_secret_ownership": op09_secrets.op9_secret_ownership,
    "op10_mixture": op10_mixture.op10_mixture,
    "op11_broadcast_decontamination": op11_decontaminate.op11_broadcast_decontamination,
    "op12_duckdb_middle": op12_middle.op12_duckdb_middle,
    "op13_trie_collocations": op13_phrases.op13_trie_collocations,
}

ORACLE_SQL = {
    "op4_pca_tiles": op04_embeddings.SQL,
    "op6_minhash_bayes": op06_minhash.SQL,
    "op8_host_reputation": op08_hosts.SQL,
    "op9_secret_ownership": op09_secrets.SQL,
    "op11_broadcast_decontamination": op11_decontaminate.SQL,
    "op12_duckdb_middle": op12_middle.SQL,
    "op13_trie_collocations": op13_phrases.SQL,
}
