"""The queries of this subpackage and the SQL that DuckDB can check them with."""

from __future__ import annotations

import corpus_pipeline
from skeinmill.llm import (
    ann,
    collocations,
    decontamination,
    embedding_join,
    language_id,
    minhash,
    mixing,
    packing,
    quality,
    secret_scan,
    token_alignment,
    url_reputation,
    warc,
)

_MODULES = {
    "op1_embedding_near_dedup": embedding_join,
    "op2_minhash_near_dedup": minhash,
    "op3_mixing_sources": mixing,
    "op4_url_filter": url_reputation,
    "op5_warc": warc,
    "op6_packing": packing,
    "op7_language_id": language_id,
    "op8_quality_classifier": quality,
    "op9_secret_scan": secret_scan,
    "op10_nearest_neighbours": ann,
    "op11_decontamination": decontamination,
    "op12_token_alignment": token_alignment,
    "op13_collocations": collocations,
}


def queries():
    return {name: module.query for name, module in _MODULES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    found = {name: module.ORACLE for name, module in _MODULES.items() if module.ORACLE}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
