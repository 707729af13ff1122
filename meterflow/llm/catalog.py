"""Queries of this subpackage and their SQL."""

from . import decontaminate, embeddings, licences, neardup, packing, quality, repeats, sharding, toxicity, urlfilter

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_remove_repeats": repeats.op2_remove_repeats,
    "op3_url_filter": urlfilter.op3_url_filter,
    "op4_quality": quality.op4_quality,
    "op5_pack": packing.op5_pack,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_near_dedup": neardup.op7_near_dedup,
    "op8_shard": sharding.op8_shard,
    "op9_licences": licences.op9_licences,
    "op10_embeddings": embeddings.op10_embeddings,
}

ORACLE_SQL = {
    "op1_decontaminate": decontaminate.ORACLE_SQL,
    "op3_url_filter": urlfilter.ORACLE_SQL,
    "op7_near_dedup": neardup.ORACLE_SQL,
    "op9_licences": licences.ORACLE_SQL,
    "op10_embeddings": embeddings.ORACLE_SQL,
}
