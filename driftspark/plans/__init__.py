"""Registered queries of the library's own operators."""

from driftspark.plans import answers, bank, collections, discovery, evidence, facts, profiles, registry, streams, workspace

QUERIES, SQL = registry.QUERIES, registry.SQL

__all__ = ["QUERIES", "SQL", "answers", "bank", "collections", "discovery", "evidence", "facts", "profiles", "streams", "workspace"]
