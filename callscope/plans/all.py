"""All queries of the engine's own operators."""

from callscope.operators import assembly, calls, delay, negotiation, paths, problems, relay, report, signalling, streams, taxonomy, usage, verdicts  # noqa: F401  they register their queries
from callscope.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
