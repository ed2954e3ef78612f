"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from . import audio, chat_format, decontaminate, html_text, lang_id, line_dedup, mixing, ppm, secret_scan, simhash

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_simhash": simhash.op2_simhash,
    "op3_audio_features": audio.op3_audio_features,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_ppm_score": ppm.op5_ppm_score,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_html_text": html_text.op7_html_text,
    "op8_lang_id": lang_id.op8_lang_id,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_secret_scan": secret_scan.op10_secret_scan,
}

ORACLES = {
    "op1_mix_sources": mixing.ORACLE,
    "op6_chat_format": chat_format.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
    "op10_secret_scan": secret_scan.ORACLE,
}
