"""All registered queries of the corpus operators."""

from __future__ import annotations

from . import audits, datapath, extras, matching, selection, statistics
from .registry import QUERIES, SQL

_ = (audits, datapath, extras, matching, statistics)  # imported to register their queries
flagship = selection.flagship


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
