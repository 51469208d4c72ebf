"""Query catalogue of this subpackage: name -> Spark builder, and name -> DuckDB text where SQL can say it."""

from __future__ import annotations

from . import (op1_toxicity, op2_language, op3_mixing, op4_topk, op5_pii, op6_decontaminate, op7_lines, op8_html,
               op9_licenses, op10_near_duplicates, op11_divergence, op12_importance, op13_sharding)
from .common import short_batches


def _short(fn):
    def run(spark, sf_dir):
        short_batches(spark)
        return fn(spark, sf_dir)
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict:
    found = {
        "op1_toxicity": op1_toxicity.op1_toxicity,
        "op2_language_id": op2_language.op2_language_id,
        "op3_mix_sources": op3_mixing.op3_mix_sources,
        "op4_topk": op4_topk.op4_topk,
        "op5_pii": op5_pii.op5_pii,
        "op6_decontaminate": op6_decontaminate.op6_decontaminate,
        "op7_line_dedup": op7_lines.op7_line_dedup,
        "op8_html_text": op8_html.op8_html_text,
        "op9_license_scan": op9_licenses.op9_license_scan,
        "op10_near_duplicates": op10_near_duplicates.op10_near_duplicates,
        "op11_source_divergence": op11_divergence.op11_source_divergence,
        "op12_importance_resample": op12_importance.op12_importance_resample,
        "op13_shard_documents": op13_sharding.op13_shard_documents,
    }
    return {name: _short(fn) for name, fn in found.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_topk": op4_topk.SQL,
        "op6_decontaminate": op6_decontaminate.SQL,
        "op7_line_dedup": op7_lines.SQL,
        "op11_source_divergence": op11_divergence.SQL,
        "op12_importance_resample": op12_importance.SQL,
        "op13_shard_documents": op13_sharding.SQL,
    }
