"""The queries of the numbered operators and their SQL."""

from __future__ import annotations

from weftgraph.llm import bpe, bytebpe, langid, media, merkle, mixing, mixlm, periodic, quality, rules, secrets, sharding, simhash

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_rules": rules.op2_rules,
    "op3_simhash": simhash.op3_simhash,
    "op4_lm": mixlm.op4_lm,
    "op5_secrets": secrets.op5_secrets,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_shard": sharding.op7_shard,
    "op8_media": media.op8_media,
    "op9_quality": quality.op9_quality,
    "op10_bpe": bpe.op10_bpe,
    "op11_merkle": merkle.op11_merkle,
    "op12_runs": periodic.op12_runs,
    "op13_byte_bpe": bytebpe.op13_byte_bpe,
}
SQL = {"op6_mix_sources": mixing.OP6_SQL, "op11_merkle": merkle.OP11_SQL}
