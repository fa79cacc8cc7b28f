"""The queries of this subpackage and, where DuckDB's SQL can express them, their oracles."""

from __future__ import annotations

from quillspark.llm.block_max import OP11_SQL, op11_block_max
from quillspark.llm.bpe import op7_bpe
from quillspark.llm.chat_format import OP8_SQL, op8_chat_format
from quillspark.llm.decontamination import OP1_SQL, op1_decontamination
from quillspark.llm.language_id import op13_language_id
from quillspark.llm.quality_rules import ABLATIONS_SQL, OP4_SQL, op4_quality_rules, quality_ablations
from quillspark.llm.sharding import OP6_SQL, op6_sharding
from quillspark.llm.simhash import op9_simhash
from quillspark.llm.substring_dedup import OP5_SQL, op5_substring_dedup
from quillspark.llm.suffix_dedup import OP3_SQL, op3_suffix_dedup
from quillspark.llm.token_counts import op10_token_counts
from quillspark.llm.token_shards import op2_token_shards
from quillspark.llm.whitening import MOMENTS_SQL, op12_whitening, whitening_moments

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_token_shards": op2_token_shards,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_sharding": op6_sharding,
    "op7_bpe": op7_bpe,
    "op8_chat_format": op8_chat_format,
    "op9_simhash": op9_simhash,
    "op10_token_counts": op10_token_counts,
    "op11_block_max": op11_block_max,
    "op12_whitening": op12_whitening,
    "op13_language_id": op13_language_id,
    "quality_ablations": quality_ablations,
    "whitening_moments": whitening_moments,
}

ORACLES = {
    "op1_decontamination": OP1_SQL,
    "op3_suffix_dedup": OP3_SQL,
    "op4_quality_rules": OP4_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op6_sharding": OP6_SQL,
    "op8_chat_format": OP8_SQL,
    "op11_block_max": OP11_SQL,
    "quality_ablations": ABLATIONS_SQL,
    "whitening_moments": MOMENTS_SQL,
}
