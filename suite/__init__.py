"""Queries over the given tables with their SQL counterparts."""

from suite import asking, documents, retrieval, sessions, sheets

MODULES = (documents, retrieval, sheets, asking, sessions)
