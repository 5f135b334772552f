"""The corpus queries by name, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from quillmill.llm import url_filters
from quillmill.llm.conversations import op13_conversation_repair
from quillmill.llm.decontaminate import op10_decontaminate
from quillmill.llm.language_id import op9_language_id
from quillmill.llm.lm import op1_lm_scores
from quillmill.llm.near_dups import op8_near_dups
from quillmill.llm.packing import op6_packing
from quillmill.llm.quality_rules import op11_quality_rules
from quillmill.llm.sketches import op3_fingerprints
from quillmill.llm.token_counts import op2_token_counts
from quillmill.llm.token_files import op4_token_files
from quillmill.llm.toxicity import op7_toxicity
from quillmill.llm.whitening import op12_whitening

QUERIES = {
    "op1_lm_scores": op1_lm_scores,
    "op2_token_counts": op2_token_counts,
    "op3_fingerprints": op3_fingerprints,
    "op4_token_files": op4_token_files,
    "op5_url_filters": url_filters.op5_url_filters,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_near_dups": op8_near_dups,
    "op9_language_id": op9_language_id,
    "op10_decontaminate": op10_decontaminate,
    "op11_quality_rules": op11_quality_rules,
    "op12_whitening": op12_whitening,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {"op5_url_filters": url_filters.ORACLE}
