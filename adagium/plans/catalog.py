"""All registered queries of the corpus operators and the SQL that checks them."""

from adagium.plans import corpus, evaluation, files, knn, rules  # noqa: F401  (they register their queries)
from adagium.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
