"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tidewater.llm import ann, bpe, html, lines, merkle, minhash, pack, phrases, quality, secrets, suffixes, tokens, toxicity


def queries() -> dict:
    return {
        "op1_permutation_index": ann.op1_permutation_index,
        "op2_bpe": bpe.op2_bpe,
        "op3_suffix_dedup": suffixes.op3_suffix_dedup,
        "op4_quality": quality.op4_quality,
        "op5_line_dedup": lines.op5_line_dedup,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_secrets": secrets.op7_secrets,
        "op8_minhash": minhash.op8_minhash,
        "op9_token_files": tokens.op9_token_files,
        "op10_pack": pack.op10_pack,
        "op11_html_text": html.op11_html_text,
        "op12_merkle": merkle.op12_merkle,
        "op13_phrases": phrases.op13_phrases,
    }


def oracle_sql() -> dict[str, str]:
    return {"op12_merkle": merkle.OP12_SQL, "op13_phrases": phrases.OP13_SQL}
