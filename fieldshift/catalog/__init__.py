"""Registered queries: each operator on the given tables, with its SQL twin.

``QUERIES`` maps a name to ``(spark, sf_dir) -> DataFrame``, ``ORACLES`` to the
SQL that must give the same rows.
"""

from fieldshift.catalog.registry import ORACLES, QUERIES
from fieldshift.catalog import fields, forecasts, pairings, records, spaces, streams, weekly  # noqa: F401,E402

__all__ = ["ORACLES", "QUERIES"]
