"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from obsflow.llm import sql
from obsflow.llm.ann import op7_nearest
from obsflow.llm.chat import op2_chat_format
from obsflow.llm.langid import op5_language_id
from obsflow.llm.merkle import op13_merkle_manifest
from obsflow.llm.mixing import op3_mix_sources
from obsflow.llm.near import op6_jaccard_join
from obsflow.llm.packing import op1_pack
from obsflow.llm.pii import op9_pii
from obsflow.llm.quality import op4_quality_rules, quality_ablations
from obsflow.llm.secrets import op8_secret_scan
from obsflow.llm.substrings import op12_substring_dedup
from obsflow.llm.trie import op11_prefix_trie
from obsflow.llm.warc import op10_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pack,
        op2_chat_format,
        op3_mix_sources,
        op4_quality_rules,
        op5_language_id,
        op6_jaccard_join,
        op7_nearest,
        op8_secret_scan,
        op9_pii,
        op10_warc,
        op11_prefix_trie,
        op12_substring_dedup,
        op13_merkle_manifest,
        quality_ablations,
    )
}

ORACLES: dict[str, str] = {
    "op2_chat_format": sql.CHAT,
    "op3_mix_sources": sql.MIX,
    "op4_quality_rules": sql.QUALITY,
    "op10_warc": sql.WARC,
    "op11_prefix_trie": sql.TRIE,
    "op12_substring_dedup": sql.REPEATS,
    "op13_merkle_manifest": sql.MERKLE,
    "quality_ablations": sql.ABLATIONS,
}
