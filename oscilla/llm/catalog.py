"""Queries of the training-data operators and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, fingerprints, langid, licenses, minhash, mixing, prefixtrie, secretscan, sharding, substrings, tokens, variants
from .store import table

#: The vocabulary of op13, among the files of the installed public tokenizers.
TOKENIZER = "word_bpe_49k.json"

Query = Callable[[SparkSession, str], DataFrame]


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def queries() -> dict[str, Query]:
    return {
        "op1_decontamination": lambda s, d: decontaminate.op1_decontamination(table(s, d, "documents"), table(s, d, "benchmark")),
        "op2_mixing": lambda s, d: mixing.op2_mixing(table(s, d, "documents")),
        "op3_near_duplicates": lambda s, d: minhash.op3_near_duplicates(table(s, d, "documents")),
        "op4_license_scan": lambda s, d: licenses.op4_license_scan(table(s, d, "documents")),
        "op5_language_id": lambda s, d: langid.op5_language_id(table(s, d, "documents")),
        "op6_secret_scan": lambda s, d: secretscan.op6_secret_scan(table(s, d, "documents")),
        "op7_suffix_dedup": lambda s, d: substrings.op7_suffix_dedup(table(s, d, "documents")),
        "op8_chat_format": lambda s, d: chat.op8_chat_format(table(s, d, "conversations")),
        "op9_sharding": lambda s, d: sharding.op9_sharding(table(s, d, "documents")),
        "op10_fingerprints": lambda s, d: fingerprints.op10_fingerprints(table(s, d, "documents")),
        "op11_spelling_variants": lambda s, d: variants.op11_spelling_variants(table(s, d, "documents")),
        "op12_prefix_trie": lambda s, d: prefixtrie.op12_prefix_trie(table(s, d, "conversations")),
        "op13_token_counts": lambda s, d: tokens.op13_token_counts(table(s, d, "documents"), _tokenizer()),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontaminate.ORACLE,
        "op2_mixing": mixing.ORACLE,
        "op3_near_duplicates": minhash.ORACLE,
        "op8_chat_format": chat.ORACLE,
        "op9_sharding": sharding.ORACLE,
        "op11_spelling_variants": variants.ORACLE,
        "op12_prefix_trie": prefixtrie.ORACLE,
    }
