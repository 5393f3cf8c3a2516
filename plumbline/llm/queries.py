"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op10_byte_bpe
from .decontam import op3_decontamination
from .katz import op9_katz
from .line_crf import op4_line_crf
from .line_dedup import ORACLE_SQL as LINE_DEDUP_SQL
from .line_dedup import op7_line_dedup
from .near_dedup import op5_near_dedup
from .quality_rules import ORACLE_SQL as QUALITY_RULES_SQL
from .quality_rules import op2_quality_rules
from .secrets import ORACLE_SQL as SECRETS_SQL
from .secrets import op6_secret_scan
from .tokenstore import op1_token_store
from .url_filters import ORACLE_SQL as URL_FILTERS_SQL
from .url_filters import op8_url_filters

QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_quality_rules": op2_quality_rules,
    "op3_decontamination": op3_decontamination,
    "op4_line_crf": op4_line_crf,
    "op5_near_dedup": op5_near_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_line_dedup": op7_line_dedup,
    "op8_url_filters": op8_url_filters,
    "op9_katz": op9_katz,
    "op10_byte_bpe": op10_byte_bpe,
}

ORACLES = {"op2_quality_rules": QUALITY_RULES_SQL, "op6_secret_scan": SECRETS_SQL, "op7_line_dedup": LINE_DEDUP_SQL, "op8_url_filters": URL_FILTERS_SQL}
