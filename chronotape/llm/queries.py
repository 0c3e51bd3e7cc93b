"""The registered queries of this package and their SQL."""

from __future__ import annotations

import public_tokenizers

from . import (bpe, chat_format, decontaminate, line_dedup, lm_score, merkle, periodic_runs, sharding, simhash, suffix_dedup,
               token_counts, topk, toxicity)
from .common import read

QUERIES = {
    "op1_line_dedup": lambda s, d: line_dedup.dedup_lines(read(s, d, "documents")),
    "op2_suffix_dedup": lambda s, d: suffix_dedup.find_repeats(read(s, d, "documents")),
    "op3_toxicity": lambda s, d: toxicity.score(read(s, d, "documents"), read(s, d, "labels")),
    "op4_exact_topk": lambda s, d: topk.top_k(read(s, d, "embeddings")),
    "op5_chat_format": chat_format.format_conversations,
    "op6_decontamination": lambda s, d: decontaminate.decontaminate(read(s, d, "documents"), read(s, d, "benchmark")),
    "op7_simhash": lambda s, d: simhash.near_duplicates(read(s, d, "documents")),
    "op8_bpe": lambda s, d: bpe.encode_digests(read(s, d, "documents"), public_tokenizers.path("byte_bpe_50k.json")),
    "op9_sharding": lambda s, d: sharding.shard(read(s, d, "documents")),
    "op10_lm_scoring": lambda s, d: lm_score.score(read(s, d, "documents")),
    "op11_periodic_runs": lambda s, d: periodic_runs.find_runs(read(s, d, "documents"), periodic_runs.planted()),
    "op12_merkle": lambda s, d: merkle.verify(read(s, d, "documents"), merkle.tampered()),
    "op13_token_counts": lambda s, d: token_counts.count_tokens(read(s, d, "documents"),
                                                                public_tokenizers.path("word_bpe_49k.json")),
}

ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op4_exact_topk": topk.ORACLE,
    "op5_chat_format": chat_format.ORACLE,
    "op6_decontamination": decontaminate.ORACLE,
    "op12_merkle": merkle.ORACLE,
}
