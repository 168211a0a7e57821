"""Plans of all registered queries."""

from tracemill.plans import corpora, dialogues, policy, recordings, records, results, steps, streams, traces  # noqa: F401
from tracemill.plans.registry import PLANS, TWINS  # noqa: F401
