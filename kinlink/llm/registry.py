"""The queries of this package and their SQL."""

from __future__ import annotations

from . import chat, collocations, decontamination, licenses, neighbours, packing, passages, quality, secret_scan, simhash, spelling, token_counts, toxicity

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_neighbours": neighbours.op2_neighbours,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_simhash": simhash.op5_simhash,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_chat_format": chat.op7_chat_format,
    "op8_repeated_passages": passages.op8_repeated_passages,
    "op9_quality": quality.op9_quality,
    "op10_pack_sequences": packing.op10_pack_sequences,
    "op11_spelling": spelling.op11_spelling,
    "op12_secret_scan": secret_scan.op12_secret_scan,
    "op13_collocations": collocations.op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": decontamination.OP3_SQL,
    "op7_chat_format": chat.OP7_SQL,
    "op8_repeated_passages": passages.OP8_SQL,
    "op11_spelling": spelling.OP11_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
