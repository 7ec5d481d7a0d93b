"""The queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from .fill_middle import OP12_SQL, op12_fill_middle
from .fingerprints import op1_fingerprints
from .jaccard_join import op3_ngram_jaccard_join
from .kneser_ney import op6_language_model
from .license_scan import op4_license_scan
from .mixing import OP7_SQL, op7_mix_sources
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .quality_classifier import op5_quality_classifier
from .quality_rules import OP8_SQL, op8_quality_rules
from .sampled_pieces import op9_sampled_pieces
from .secret_scan import op10_secret_scan
from .sharding import op2_shards
from .substring_dedup import OP13_SQL, op13_substring_dedup

_ALL = (
    op1_fingerprints,
    op2_shards,
    op3_ngram_jaccard_join,
    op4_license_scan,
    op5_quality_classifier,
    op6_language_model,
    op7_mix_sources,
    op8_quality_rules,
    op9_sampled_pieces,
    op10_secret_scan,
    op11_prefix_trie,
    op12_fill_middle,
    op13_substring_dedup,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {"op7_mix_sources": OP7_SQL, "op8_quality_rules": OP8_SQL, "op11_prefix_trie": OP11_SQL, "op12_fill_middle": OP12_SQL, "op13_substring_dedup": OP13_SQL}
