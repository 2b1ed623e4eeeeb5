"""Training-data operators: dedup, cleaning, tokens, languages, secrets, mixing, extraction, chat."""

from importlib import import_module

#: One module per operator; each registers its query, and its SQL where SQL can say it.
QUERY_MODULES: list[str] = ["exact_dedup", "mixing", "chat_format", "byte_bpe", "quality_classifier", "near_dedup",
                            "quality_rules", "language_id", "secret_scan", "html_extract", "hard_negatives", "lexical_search",
                            "jaccard_join"]


def load_queries() -> tuple[dict, dict]:
    """All queries of this subpackage and their oracle texts."""
    for name in QUERY_MODULES:
        import_module(f"soundalike.llm.{name}")
    from soundalike.llm.common import ORACLES, QUERIES
    return dict(QUERIES), dict(ORACLES)
