"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from ledgerloom.llm import ball_kmeans, multiset_hash, prefix_trie
from ledgerloom.llm.additive_search import op5_additive_search
from ledgerloom.llm.bpe import op3_bpe
from ledgerloom.llm.chat import op9_chat_format
from ledgerloom.llm.mixing import op4_mixing
from ledgerloom.llm.near_dedup import op7_near_dedup
from ledgerloom.llm.quality_rules import op6_quality_rules
from ledgerloom.llm.rule_ensemble import op2_quality
from ledgerloom.llm.secret_scan import op10_secret_scan
from ledgerloom.llm.token_files import op8_token_files
from ledgerloom.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_bpe": op3_bpe,
    "op4_mixing": op4_mixing,
    "op5_additive_search": op5_additive_search,
    "op6_quality_rules": op6_quality_rules,
    "op7_near_dedup": op7_near_dedup,
    "op8_token_files": op8_token_files,
    "op9_chat_format": op9_chat_format,
    "op10_secret_scan": op10_secret_scan,
    "op11_ball_kmeans": ball_kmeans.op11_ball_kmeans,
    "op12_multiset_hash": multiset_hash.op12_multiset_hash,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op11_ball_kmeans": ball_kmeans.sql(),
    "op13_prefix_trie": prefix_trie.sql(),
}
