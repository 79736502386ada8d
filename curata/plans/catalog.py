"""Named queries over the given tables, each with its SQL where SQL can express it.

Every query reads its whole tables. Names begin with the number of the operator.
"""

from __future__ import annotations

from curata.plans import corpus, grading, library, numbers, relations

MODULES = (corpus, relations, numbers, grading, library)


def flagship(spark, d):
    """Review status of documents by language: exact copies, detectors and leaked items together."""
    return corpus.flagship(spark, d)


def queries() -> dict:
    return {k: q for m in MODULES for k, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, (_, s) in m.QUERIES.items() if s}
