"""The registered queries of this subpackage, with the SQL of those that SQL
can express."""

from __future__ import annotations

from .curriculum import OP10_SQL, op10_mix_sources
from .lexical import OP12_SQL, op12_lexical_search
from .license import op2_license_scan
from .linededup import op1_line_dedup
from .lmscore import op4_lm_scoring
from .pieces import op5_sentencepiece
from .quality import op9_quality_rules
from .sharding import op3_shard
from .simhash import op8_simhash_near_dedup
from .suffixes import op11_suffix_dedup
from .toxicity import op7_toxicity
from .whitening import op13_whitening
from .winnow import op6_winnowing

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_shard": op3_shard,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_winnowing": op6_winnowing,
    "op7_toxicity": op7_toxicity,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_mix_sources": op10_mix_sources,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_lexical_search": op12_lexical_search,
    "op13_whitening": op13_whitening,
}

ORACLE = {"op10_mix_sources": OP10_SQL, "op12_lexical_search": OP12_SQL}
