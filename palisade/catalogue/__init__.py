"""Registered queries: every operator applied to the given tables, with the SQL that checks it."""

from palisade.catalogue import registry
from palisade.catalogue import (  # noqa: F401  (imported for registration)
    normalising, parsing, scoping, attributing, merging, changing, platform, correlating, jobbing, notifying, observing, flowing, panelling, streamed,
)


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLES)
