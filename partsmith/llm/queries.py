"""The training-data operators' queries and their SQL."""

from __future__ import annotations

from . import bpe, brown_lm, chat, collocations, embedding_dedup, exact_dedup, mixing, periodic, secrets, simhash, toxicity, url_filter, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_mixing": mixing.op2_mixing,
    "op3_brown_lm": brown_lm.op3_brown_lm,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_simhash": simhash.op5_simhash,
    "op6_warc": warc.op6_warc,
    "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
    "op8_secrets": secrets.op8_secrets,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_chat": chat.op11_chat,
    "op12_collocations": collocations.op12_collocations,
    "op13_periodic": periodic.op13_periodic,
}

ORACLE_SQL = {
    "op2_mixing": mixing.OP2_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
    "op12_collocations": collocations.OP12_SQL,
}
