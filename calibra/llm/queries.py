"""The queries of this subpackage, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from calibra.llm.codes import op13_exponion_codes
from calibra.llm.fingerprints import op10_bottom_k
from calibra.llm.html import op3_wrappers
from calibra.llm.jaccard import op4_grouped_prefix_join
from calibra.llm.language import op5_rank_profiles
from calibra.llm.lines import op9_fuzzy_lines
from calibra.llm.mixing import OP1_SQL, op1_hierarchical_mix
from calibra.llm.neighbours import op6_learned_partitions
from calibra.llm.packing import op8_power_packing
from calibra.llm.repeats import op11_grouped_suffixes
from calibra.llm.scoring import op7_deleted_interpolation
from calibra.llm.tokenfile import op2_token_files
from calibra.llm.whitening import op12_range_finder

QUERIES = {
    "op1_hierarchical_mix": op1_hierarchical_mix,
    "op2_token_files": op2_token_files,
    "op3_wrappers": op3_wrappers,
    "op4_grouped_prefix_join": op4_grouped_prefix_join,
    "op5_rank_profiles": op5_rank_profiles,
    "op6_learned_partitions": op6_learned_partitions,
    "op7_deleted_interpolation": op7_deleted_interpolation,
    "op8_power_packing": op8_power_packing,
    "op9_fuzzy_lines": op9_fuzzy_lines,
    "op10_bottom_k": op10_bottom_k,
    "op11_grouped_suffixes": op11_grouped_suffixes,
    "op12_range_finder": op12_range_finder,
    "op13_exponion_codes": op13_exponion_codes,
}
ORACLE_SQL = {"op1_hierarchical_mix": OP1_SQL}
