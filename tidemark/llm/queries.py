"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from importlib import import_module

# query -> module of this subpackage that holds the function of the same name
MODULES = {
    "op1_toxicity": "toxicity",
    "op2_url_filter": "urlfilter",
    "op3_quality": "quality",
    "op4_warc": "warc",
    "op5_ngram_jaccard": "jaccard",
    "op6_sharding": "sharding",
    "op7_embedding_neardup": "embeddings",
    "op8_suffix_dedup": "suffixdedup",
    "op9_packing": "packing",
    "op10_decontamination": "decontam",
    "op11_hard_negatives": "hardneg",
    "op12_quality_rules": "rules",
    "op13_source_divergence": "divergence",
}


def _late(module: str, name: str):
    return lambda spark, sf_dir: getattr(import_module(f"tidemark.llm.{module}"), name)(spark, sf_dir)


def queries() -> dict:
    import corpus_pipeline

    return {name: _late(module, name) for name, module in MODULES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from tidemark.llm.divergence import OP13_SQL
    from tidemark.llm.embeddings import OP7_SQL
    from tidemark.llm.hardneg import OP11_SQL
    from tidemark.llm.jaccard import OP5_SQL
    from tidemark.llm.rules import OP12_SQL
    from tidemark.llm.urlfilter import OP2_SQL

    return {
        "op2_url_filter": OP2_SQL,
        "op5_ngram_jaccard": OP5_SQL,
        "op7_embedding_neardup": OP7_SQL,
        "op11_hard_negatives": OP11_SQL,
        "op12_quality_rules": OP12_SQL,
        "op13_source_divergence": OP13_SQL,
    }
