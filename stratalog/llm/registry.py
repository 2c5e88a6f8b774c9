"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from stratalog.llm.chat import OP1_SQL, op1_chat_formatting
from stratalog.llm.decontam import op6_benchmark_decontamination
from stratalog.llm.langid import op5_language_id
from stratalog.llm.linededup import OP8_SQL, op8_line_dedup
from stratalog.llm.neardup import op9_minhash_near_dedup
from stratalog.llm.packing import op7_packing
from stratalog.llm.quality_classifier import op2_quality_classifier
from stratalog.llm.quality_rules import op10_quality_rules
from stratalog.llm.sharding import op3_sharding
from stratalog.llm.tokens import op4_token_ids

QUERIES = {f.__name__: f for f in (op1_chat_formatting, op2_quality_classifier, op3_sharding, op4_token_ids, op5_language_id, op6_benchmark_decontamination, op7_packing, op8_line_dedup, op9_minhash_near_dedup, op10_quality_rules)}

#: Queries that no SQL here expresses are held against brute force in tests/llm.
ORACLES: dict[str, str] = {"op1_chat_formatting": OP1_SQL, "op8_line_dedup": OP8_SQL}
