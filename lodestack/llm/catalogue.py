"""The queries of this subpackage, with SQL where SQL can express them."""

import corpus_pipeline
from lodestack.llm import op1_tokens, op10_jaccard, op11_importance, op12_infilling, op13_urls, op2_topk, op3_licenses, op4_personal, op5_sharding, op6_decontamination, op7_quality, op8_mixing, op9_warc

_OPS = (op1_tokens, op2_topk, op3_licenses, op4_personal, op5_sharding, op6_decontamination, op7_quality, op8_mixing, op9_warc, op10_jaccard, op11_importance, op12_infilling, op13_urls)


def queries():
    return {op.NAME: op.run for op in _OPS} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    return {op.NAME: op.SQL for op in _OPS if op.SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
