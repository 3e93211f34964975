"""Registered queries of the series engine and their SQL twins."""

from . import audits, bootstraps, models, monitors, panels, plans, points, sequences, streams, taxonomies

MODULES = (points, monitors, panels, models, audits, sequences, streams, plans, bootstraps, taxonomies)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE: dict = {k: v for m in MODULES for k, v in m.ORACLE.items()}
