"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from tracelake.llm.decontaminate import op5_benchmark_decontamination
from tracelake.llm.jaccard import op6_ngram_jaccard
from tracelake.llm.packing import op8_packing
from tracelake.llm.pii import op10_pii
from tracelake.llm.quality import OP7_SQL, op7_quality_rules
from tracelake.llm.site_quality import op3_site_quality
from tracelake.llm.suffix_dedup import op9_suffix_dedup
from tracelake.llm.token_counts import op1_token_counts
from tracelake.llm.token_output import op4_token_output
from tracelake.llm.tool_calls import OP2_SQL, op2_tool_calls

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_tool_calls": op2_tool_calls,
    "op3_site_quality": op3_site_quality,
    "op4_token_output": op4_token_output,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_quality_rules": op7_quality_rules,
    "op8_packing": op8_packing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_pii": op10_pii,
}

ORACLE_SQL: dict[str, str] = {"op2_tool_calls": OP2_SQL, "op7_quality_rules": OP7_SQL}
