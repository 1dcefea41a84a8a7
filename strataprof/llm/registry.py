"""Queries of this subpackage and their SQL, as ``__spark_entry__`` registers them."""

from strataprof.llm import bloom_lm, bond, byte_bpe, decontaminate, html_text, itq, lang_id, line_dedup, minhash, pii, sharding, spelling, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_toxicity": toxicity.query,
    "op3_itq": itq.query,
    "op4_lang_id": lang_id.query,
    "op5_minhash": minhash.query,
    "op6_html_text": html_text.query,
    "op7_byte_bpe": byte_bpe.query,
    "op8_bloom_lm": bloom_lm.query,
    "op9_line_dedup": line_dedup.query,
    "op10_pii": pii.query,
    "op11_bond": bond.query,
    "op12_spelling": spelling.query,
    "op13_shards": sharding.query,
}

ORACLE_SQL: dict[str, str] = {
    "op3_itq": itq.ORACLE,
    "op5_minhash": minhash.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
    "op10_pii": pii.ORACLE,
    "op11_bond": bond.ORACLE,
    "op12_spelling": spelling.ORACLE,
}
