"""The queries of this subpackage, one for each operator, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from ruleloom.llm import bpe, chat, decontam, html, langid, linededup, nearcopies, pii, vectors, wavelet

QUERIES = {
    "op1_vector_links": vectors.op1_vector_links,
    "op2_langid": langid.op2_langid,
    "op3_decontaminate": decontam.op3_decontaminate,
    "op4_html_text": html.op4_html_text,
    "op5_bpe": bpe.op5_bpe,
    "op6_line_dedup": linededup.op6_line_dedup,
    "op7_near_copies": nearcopies.op7_near_copies,
    "op8_chat_format": chat.op8_chat_format,
    "op9_token_file": wavelet.op9_token_file,
    "op10_pii": pii.op10_pii,
}

ORACLE_SQL: dict[str, str] = {
    "op1_vector_links": vectors.ORACLE,
    "op3_decontaminate": decontam.ORACLE,
    "op6_line_dedup": linededup.ORACLE,
    "op7_near_copies": nearcopies.ORACLE,
    "op8_chat_format": chat.ORACLE,
}
