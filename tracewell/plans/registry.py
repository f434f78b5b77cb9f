"""All queries of the library itself."""

from __future__ import annotations

from tracewell.plans import alerts, fleet, folds, identity, joins, sequences, sources, streams, traffic

MODULES = (traffic, sequences, joins, identity, alerts, streams, sources, fleet, folds)
QUERIES = {k: v for m in MODULES for k, v in m.Q.items()}
ORACLES = {k: v for m in MODULES for k, v in m.S.items()}
