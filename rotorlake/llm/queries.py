"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, hard_negatives, license_scan, line_dedup, mixing, near_join, quality, secrets_scan, token_files, toxicity, url_filter, warc, whitening

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_mixing": mixing.op4_mixing,
    "op5_warc": warc.op5_warc,
    "op6_token_files": token_files.op6_token_files,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_secret_scan": secrets_scan.op8_secret_scan,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_near_join": near_join.op10_near_join,
    "op11_whitening": whitening.op11_whitening,
    "op12_line_dedup": line_dedup.op12_line_dedup,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLES = {
    "op2_quality_rules": quality.OP2_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op5_warc": warc.OP5_SQL,
    "op9_url_filter": url_filter.OP9_SQL,
    "op12_line_dedup": line_dedup.OP12_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
