"""All registered queries and the SQL statements of their results."""

import importlib

QUERIES, ORACLES = {}, {}
for _area in ("ledger", "evidence", "lifecycle", "similarity", "streams"):
    _module = importlib.import_module(f"chainwitness.catalog.{_area}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
