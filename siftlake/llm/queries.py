"""Queries and oracle SQL of this subpackage, as __spark_entry__.py registers them."""

from __future__ import annotations

from . import chat, exact, idfile, langid, leaks, near, phrases, shards, tokens, toxic, turns, warc

QUERIES = {
    "op1_language": langid.op1_language,
    "op2_bpe": tokens.op2_bpe,
    "op3_minhash": near.op3_minhash,
    "op4_exact_dedup": exact.op4_exact_dedup,
    "op5_toxicity": toxic.op5_toxicity,
    "op6_token_ids": idfile.op6_token_ids,
    "op7_token_counts": tokens.op7_token_counts,
    "op8_preference": chat.op8_preference,
    "op9_decontamination": leaks.op9_decontamination,
    "op10_shards": shards.op10_shards,
    "op11_warc": warc.op11_warc,
    "op12_phrases": phrases.op12_phrases,
    "op13_turn_trie": turns.op13_turn_trie,
}

ORACLE_SQL = {"op4_exact_dedup": exact.OP4_SQL, "op8_preference": chat.OP8_SQL, "op11_warc": warc.OP11_SQL, "op12_phrases": phrases.OP12_SQL, "op13_turn_trie": turns.OP13_SQL}
