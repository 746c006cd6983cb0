"""Queries of this subpackage, and the SQL of those that SQL can express."""

from gridloom.llm.binary import op9_token_files
from gridloom.llm.chat import op1_chat_format
from gridloom.llm.decontaminate import op4_decontamination
from gridloom.llm.licenses import op10_license_scan
from gridloom.llm.packing import op2_packing
from gridloom.llm.quality import op6_quality_classifier
from gridloom.llm.recurrent import op3_lm_scoring
from gridloom.llm.simhash import op5_simhash_neardup
from gridloom.llm.sketches import op8_fingerprints
from gridloom.llm.substrings import op7_substring_dedup

QUERIES = {f.__name__: f for f in (op1_chat_format, op2_packing, op3_lm_scoring, op4_decontamination, op5_simhash_neardup, op6_quality_classifier, op7_substring_dedup, op8_fingerprints, op9_token_files, op10_license_scan)}
ORACLE_SQL: dict[str, str] = {}
