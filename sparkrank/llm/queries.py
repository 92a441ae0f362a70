"""The queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from sparkrank.llm.curriculum import OP13_SQL, op13_curriculum_mix
from sparkrank.llm.decontamination import OP3_SQL, op3_decontamination
from sparkrank.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from sparkrank.llm.language_id import op6_language_id
from sparkrank.llm.late_sessions import OP11_SQL, op11_late_sessions
from sparkrank.llm.packing import op5_best_fit_packing
from sparkrank.llm.paragraph_dedup import op10_paragraph_dedup
from sparkrank.llm.quality_classifier import op9_quality_classifier
from sparkrank.llm.quality_rules import OP4_SQL, op4_quality_rules
from sparkrank.llm.simhash import op7_simhash_neardedup
from sparkrank.llm.suffix_dedup import OP1_SQL, op1_suffix_array_dedup
from sparkrank.llm.token_counts import op8_token_counts
from sparkrank.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_decontamination": op3_decontamination,
    "op4_quality_rules": op4_quality_rules,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_language_id": op6_language_id,
    "op7_simhash_neardedup": op7_simhash_neardedup,
    "op8_token_counts": op8_token_counts,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_paragraph_dedup": op10_paragraph_dedup,
    "op11_late_sessions": op11_late_sessions,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_curriculum_mix": op13_curriculum_mix,
}

SQL = {"op1_suffix_array_dedup": OP1_SQL, "op3_decontamination": OP3_SQL, "op4_quality_rules": OP4_SQL, "op11_late_sessions": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_curriculum_mix": OP13_SQL}
