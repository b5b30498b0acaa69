"""Registered queries of the library's own operators, with equivalent SQL."""

from __future__ import annotations

from . import aggregation, conditional, documents, lookups, packages, recalculation, scalars, sequences, stateful, tables, textual

MODULES = (aggregation, scalars, lookups, conditional, textual, stateful, documents, packages, recalculation, sequences, tables)
QUERIES = {name: f for m in MODULES for name, f in m.REGISTER.queries.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.REGISTER.oracles.items()}
FLAGSHIP = "xl_sumifs_lineitem"
