"""The registered queries: each with its DataFrame form and, where SQL can say it, the same in SQL."""
from __future__ import annotations


def load_all() -> tuple[dict, dict]:
    """Import every query module and return (queries, SQL)."""
    from gridcast.plans import features, histories, manifests, sampling, storage, verification, connectors  # noqa: F401
    from gridcast.plans import registry

    return registry.QUERIES, registry.SQL
