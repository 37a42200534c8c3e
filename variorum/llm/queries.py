"""The queries of this subpackage and their SQL, under the names that __spark_entry__.py registers."""

from __future__ import annotations

from .byte_bpe import op2_byte_bpe
from .chat_format import OP7_SQL, op7_chat_format
from .decontamination import op9_decontamination
from .filter_audit import OP12_SQL, op12_filter_audit
from .jaccard_join import op4_jaccard_join
from .license_scan import op5_license_scan
from .quality_classifier import op10_quality_classifier
from .quality_rules import op1_quality_rules
from .substring_dedup import op6_substring_dedup
from .suffix_dedup import op8_suffix_dedup
from .token_alignment import op11_token_alignment
from .top_inner_products import OP13_SQL, op13_top_inner_products
from .url_filter import OP3_SQL, op3_url_filter

# fmt: off
QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_byte_bpe, op3_url_filter, op4_jaccard_join, op5_license_scan,
        op6_substring_dedup, op7_chat_format, op8_suffix_dedup, op9_decontamination, op10_quality_classifier,
        op11_token_alignment, op12_filter_audit, op13_top_inner_products,
    )
}
# fmt: on
ORACLE_SQL = {"op3_url_filter": OP3_SQL, "op7_chat_format": OP7_SQL, "op12_filter_audit": OP12_SQL, "op13_top_inner_products": OP13_SQL}
