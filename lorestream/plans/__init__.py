"""Registered queries; each module adds its own to `queries.QUERIES` and `queries.ORACLE_SQL`."""

from lorestream.plans import queries, contexts, entities, evaluation, evidence, fragments, guarding, ingesting, loading, metadata, observed, office, questions, stateful  # noqa: F401
