"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

from importlib import import_module

#: Query name -> module; each module has query(spark, sf_dir) and, where SQL can express it, SQL.
MODULES = {
    "op1_line_dedup": "line_dedup",
    "op2_token_packing": "token_packing",
    "op3_chat_format": "chat_format",
    "op4_decontaminate": "decontaminate",
    "op5_sentencepiece": "sentencepiece",
    "op6_toxicity": "toxicity",
    "op7_language_id": "language_id",
    "op8_embedding_dedup": "embedding_dedup",
    "op9_suffix_dedup": "suffix_dedup",
    "op10_jaccard_join": "jaccard_join",
}


def queries() -> dict:
    return {name: import_module(f"{__name__}.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__name__}.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
