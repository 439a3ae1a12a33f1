"""The queries of the text operators and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

from .attention_mil import op1
from .decontaminate import op8
from .lexical_search import SQL13, op13
from .license_scan import op3
from .near_duplicates import op10
from .pii_votes import op2
from .quality_trees import op6
from .repeats import op9
from .sentencepiece_rounds import op7
from .url_rules import op5
from .vector_codes import SQL12, op12
from .warc_archives import SQL11, op11
from .word_backoff import op4

QUERIES = {
    "op1_quality_mil": op1,
    "op2_pii": op2,
    "op3_license_scan": op3,
    "op4_language_id": op4,
    "op5_url_rules": op5,
    "op6_quality_rules": op6,
    "op7_sentencepiece": op7,
    "op8_decontamination": op8,
    "op9_suffix_dedup": op9,
    "op10_minhash": op10,
    "op11_warc": op11,
    "op12_vector_codes": op12,
    "op13_lexical_search": op13,
}
ORACLE_SQL: dict[str, str] = {"op11_warc": SQL11, "op12_vector_codes": SQL12, "op13_lexical_search": SQL13}
