"""The queries of this package, by registered name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from attesta.llm import ann, audit, crf, langid, lexical, mixing, pieces, ppm, rules, secrets, sharding, simhash, warc

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_sharding": sharding.op2_sharding,
    "op3_secrets": secrets.op3_secrets,
    "op4_simhash": simhash.op4_simhash,
    "op5_ann": ann.op5_ann,
    "op6_quality": crf.op6_quality,
    "op7_rules": rules.op7_rules,
    "op8_langid": langid.op8_langid,
    "op9_warc": warc.op9_warc,
    "op10_mixing": mixing.op10_mixing,
    "op11_lexical_search": lexical.op11_lexical_search,
    "op12_lm_scoring": ppm.op12_lm_scoring,
    "op13_filter_audit": audit.op13_filter_audit,
}
ORACLES = {
    "op9_warc": warc.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_lexical_search": lexical.ORACLE,
    "op13_filter_audit": audit.ORACLE,
}
