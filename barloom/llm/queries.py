"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from barloom.llm.fill_middle import OP12_SQL, op12_fill_in_middle
from barloom.llm.knn import OP10_SQL, op10_exact_top_k
from barloom.llm.language_id import op3_language_id
from barloom.llm.license_scan import OP1_SQL, op1_license_scan
from barloom.llm.line_dedup import OP2_SQL, op2_line_dedup
from barloom.llm.near_dedup import op9_minhash_near_dedup
from barloom.llm.packing import op7_best_fit_packing
from barloom.llm.phrases import OP11_SQL, op11_phrase_collocations
from barloom.llm.pieces import op6_sentencepiece
from barloom.llm.quality_rules import OP4_SQL, op4_quality_rules
from barloom.llm.secret_scan import OP5_SQL, op5_secret_scan
from barloom.llm.sharding import op13_longest_first_sharding
from barloom.llm.toxicity import op8_toxicity


def queries():
    return {
        "op1_license_scan": op1_license_scan,
        "op2_line_dedup": op2_line_dedup,
        "op3_language_id": op3_language_id,
        "op4_quality_rules": op4_quality_rules,
        "op5_secret_scan": op5_secret_scan,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_toxicity": op8_toxicity,
        "op9_minhash_near_dedup": op9_minhash_near_dedup,
        "op10_exact_top_k": op10_exact_top_k,
        "op11_phrase_collocations": op11_phrase_collocations,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_longest_first_sharding": op13_longest_first_sharding,
    }


def oracle_sql():
    return {
        "op1_license_scan": OP1_SQL,
        "op2_line_dedup": OP2_SQL,
        "op4_quality_rules": OP4_SQL,
        "op5_secret_scan": OP5_SQL,
        "op10_exact_top_k": OP10_SQL,
        "op11_phrase_collocations": OP11_SQL,
        "op12_fill_in_middle": OP12_SQL,
    }
