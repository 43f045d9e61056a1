"""All queries by name, and their SQL."""

from volumetra.plans import base, grids, pipelines, lengths, networks  # noqa: F401  (they register their queries)
from volumetra.plans.registry import ORACLES, QUERIES  # noqa: F401
