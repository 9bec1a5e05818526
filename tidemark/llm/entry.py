"""The queries of this package, by name, and their SQL where SQL expresses them."""

from __future__ import annotations

from importlib import import_module

_WHERE = {
    "op1_ngram_jaccard_join": "jaccard_join",
    "op2_token_counts": "token_counts",
    "op3_chat_formatting": "chat",
    "op4_language_id": "language_id",
    "op5_quality_rules": "quality",
    "op6_lm_scoring": "lm",
    "op7_decontamination": "decontamination",
    "op8_toxicity": "toxicity",
    "op9_license_scan": "licenses",
    "op10_packing": "packing",
}


def _query(name: str):
    def run(spark, sf_dir):
        return getattr(import_module(f"{__package__}.{_WHERE[name]}"), name)(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _query(name) for name in _WHERE} | {"pipeline": _pipeline}


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def oracle_sql() -> dict[str, str]:
    from . import sql

    return dict(sql.ORACLE)
