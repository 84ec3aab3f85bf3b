"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from orrery.llm import ann, bpe, language, mixing, quality, secrets, simhash, substring, toxicity, warc

QUERIES = {
    "op1_substring": substring.op1,
    "op2_ann": ann.op2,
    "op3_toxicity": toxicity.op3,
    "op4_language": language.op4,
    "op5_bpe": bpe.op5,
    "op6_secrets": secrets.op6,
    "op7_quality": quality.op7,
    "op8_mixing": mixing.op8,
    "op9_warc": warc.op9,
    "op10_simhash": simhash.op10,
}

ORACLES = {
    "op7_quality": quality.OP7_SQL,
    "op8_mixing": mixing.OP8_SQL,
}
