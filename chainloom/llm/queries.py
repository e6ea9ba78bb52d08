"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .alignment import op12_alignment
from .decontaminate import op5_decontaminate
from .html_text import op6_html_text
from .jaccard_join import op9_jaccard_join
from .near_duplicates import op13_near_duplicates
from .oracle import ORACLE_SQL
from .packing import op3_packing
from .pii import op4_pii
from .quality_model import op10_quality_classifier
from .quality_rules import op7_quality_rules
from .substring_dedup import op1_substring_dedup
from .token_files import op2_token_files
from .vector_codes import op11_vector_codes
from .warc import op8_warc

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_files": op2_token_files,
    "op3_packing": op3_packing,
    "op4_pii": op4_pii,
    "op5_decontaminate": op5_decontaminate,
    "op6_html_text": op6_html_text,
    "op7_quality_rules": op7_quality_rules,
    "op8_warc": op8_warc,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_vector_codes": op11_vector_codes,
    "op12_alignment": op12_alignment,
    "op13_near_duplicates": op13_near_duplicates,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
