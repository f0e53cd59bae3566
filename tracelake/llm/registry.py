"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import exact_dedup, html_text, mixing, ngram_join, phrases, pieces_bpe, ppm, quality, repeats, resample, secrets, setsketch, tokens

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_secret_scans": secrets.op2_secret_scans,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_ppm_scores": ppm.op6_ppm_scores,
    "op7_html_text": html_text.op7_html_text,
    "op8_sentencepiece": pieces_bpe.op8_sentencepiece,
    "op9_token_counts": tokens.op9_token_counts,
    "op10_repeated_passages": repeats.op10_repeated_passages,
    "op11_phrases": phrases.op11_phrases,
    "op12_resample": resample.op12_resample,
    "op13_setsketch": setsketch.op13_setsketch,
}

#: DuckDB SQL of those that SQL can express.
ORACLE_SQL = {
    "op1_quality_rules": quality.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op4_ngram_join": ngram_join.ORACLE,
    "op5_mix_sources": mixing.ORACLE,
    "op10_repeated_passages": repeats.ORACLE,
    "op11_phrases": phrases.ORACLE,
    "op12_resample": resample.ORACLE,
    "op13_setsketch": setsketch.ORACLE,
}
