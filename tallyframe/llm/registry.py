"""The queries of this package and their SQL, for the entry module."""

from __future__ import annotations

from tallyframe.llm import ann, bpe, codes, mixing, negatives, passages, pii, pivots, quality, secrets, sharding, simhash, suffixes

MODULES = (mixing, ann, bpe, codes, negatives, passages, pii, pivots, quality, secrets, sharding, simhash, suffixes)


def queries() -> dict:
    import corpus_pipeline

    return {k: f for m in MODULES for k, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    own = {k: s for m in MODULES for k, s in m.SQL.items()}
    return own | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
