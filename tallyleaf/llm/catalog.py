"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .decontaminate import op9_decontaminate
from .filter_audit import SQL as AUDIT_SQL
from .filter_audit import op11_filter_audit
from .merkle_manifest import SQL as MANIFEST_SQL
from .merkle_manifest import op12_merkle_manifest
from .ngram_join import op2_ngram_join
from .ogg import op7_media
from .packing import op5_packing
from .perplexity import op13_quality_rules
from .pii import op1_personal_data
from .secrets import op6_secrets
from .suffix_dedup import op3_suffix_dedup
from .toxicity import op10_toxicity
from .url_filter import SQL as URL_SQL
from .url_filter import op8_url_filter
from .window_dedup import op4_window_dedup

QUERIES = {
    "op1_personal_data": op1_personal_data,
    "op2_ngram_join": op2_ngram_join,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_window_dedup": op4_window_dedup,
    "op5_packing": op5_packing,
    "op6_secrets": op6_secrets,
    "op7_media": op7_media,
    "op8_url_filter": op8_url_filter,
    "op9_decontaminate": op9_decontaminate,
    "op10_toxicity": op10_toxicity,
    "op11_filter_audit": op11_filter_audit,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_quality_rules": op13_quality_rules,
}

ORACLES: dict[str, str] = {"op8_url_filter": URL_SQL, "op11_filter_audit": AUDIT_SQL, "op12_merkle_manifest": MANIFEST_SQL}
