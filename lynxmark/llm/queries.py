"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import bpe, licenses, media, mixing, quality, secrets, sharding, simhash, tokenfiles, topk

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_near_duplicates": simhash.op2_near_duplicates,
    "op3_bpe": bpe.op3_bpe,
    "op4_quality": quality.op4_quality,
    "op5_media": media.op5_media,
    "op6_mixing": mixing.op6_mixing,
    "op7_licenses": licenses.op7_licenses,
    "op8_top_k": topk.op8_top_k,
    "op9_token_files": tokenfiles.op9_token_files,
    "op10_secrets": secrets.op10_secrets,
}

ORACLES = {"op6_mixing": mixing.ORACLE, "op8_top_k": topk.ORACLE, "op10_secrets": secrets.oracle()}
