"""Registered queries opN_<name> and their DuckDB SQL.

Each query applies its operator with production parameters to the whole table
and derives the contract's columns from what the operator returns.
"""

from __future__ import annotations

from ferrule.llm import chat, codes, decontam, hosts, mixing, packing, pii, repeats, simhash, spelling, tokens, toxicity, warc
from ferrule.llm.common import table


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict:
    return {
        "op1_simhash": lambda spark, d: simhash.query(table(spark, d, "documents")),
        "op2_token_counts": lambda spark, d: tokens.query(table(spark, d, "documents"), vocabulary_path()),
        "op3_packing": lambda spark, d: packing.pack(table(spark, d, "documents")),
        "op4_warc": lambda spark, d: warc.query(table(spark, d, "pages")),
        "op5_chat": lambda spark, d: chat.query(spark, table(spark, d, "conversations")),
        "op6_repeats": lambda spark, d: repeats.query(table(spark, d, "documents")),
        "op7_personal_data": lambda spark, d: pii.query(table(spark, d, "documents")),
        "op8_toxicity": lambda spark, d: toxicity.query(table(spark, d, "documents"), table(spark, d, "labels")),
        "op9_host_rules": lambda spark, d: hosts.query(table(spark, d, "documents")),
        "op10_decontamination": lambda spark, d: decontam.overlaps(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op11_mixing": lambda spark, d: mixing.query(table(spark, d, "documents")),
        "op12_spelling": lambda spark, d: spelling.query(table(spark, d, "documents")),
        "op13_vector_codes": lambda spark, d: codes.query(table(spark, d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": warc.ORACLE, "op5_chat": chat.ORACLE, "op9_host_rules": hosts.ORACLE, "op11_mixing": mixing.ORACLE, "op13_vector_codes": codes.ORACLE}
