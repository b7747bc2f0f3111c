"""Operators for training data: one module each, with its query and, where SQL can say it, its SQL."""

from fleetpulse.llm import ann, bpe, chat, exact_dedup, langid, mixing, passages, periodic, sharding, simhash, toxicity, warc, whitening

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_mixing_sources": mixing.op2_mixing_sources,
    "op3_sharding": sharding.op3_sharding,
    "op4_language_id": langid.op4_language_id,
    "op5_bpe": bpe.op5_bpe,
    "op6_warc": warc.op6_warc,
    "op7_chat_formatting": chat.op7_chat_formatting,
    "op8_simhash": simhash.op8_simhash,
    "op10_passages": passages.op10_passages,
    "op9_nearest_neighbours": ann.op9_nearest_neighbours,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_whitening": whitening.op12_whitening,
    "op13_toxicity": toxicity.op13_toxicity,
}

SQL = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op2_mixing_sources": mixing.SQL,
    "op6_warc": warc.SQL,
    "op7_chat_formatting": chat.SQL,
}
