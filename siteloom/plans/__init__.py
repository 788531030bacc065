"""Named queries over the site tables, each with an SQL twin where SQL can say it."""

from siteloom.plans import changes, curation, digests, pages, state, stores, surface  # noqa: F401  (they register their queries)
from siteloom.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
