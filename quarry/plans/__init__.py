"""Registered queries over the test tables."""

from quarry.plans import evaluation, formal, parsing, queries, release, selection, statements, structure  # noqa: F401
