"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import ann, decontam, langid, packing, pii, quality, secrets, simhash, suffix_dedup, url_reputation

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_pii": pii.op2_pii,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_url_filter": url_reputation.op4_url_filter,
    "op5_quality": quality.op5_quality,
    "op6_simhash": simhash.op6_simhash,
    "op7_decontaminate": decontam.op7_decontaminate,
    "op8_nearest": ann.op8_nearest,
    "op9_language": langid.op9_language,
    "op10_secrets": secrets.op10_secrets,
}
ORACLE_SQL = {"op4_url_filter": url_reputation.ORACLE_SQL, "op7_decontaminate": decontam.ORACLE_SQL}
