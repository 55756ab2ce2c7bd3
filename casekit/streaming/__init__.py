"""Streaming use of the case operators.

The reference has no streaming code (its README only calls real-time alerts
"implementable"), so no streaming-only operator is built. What is offered is
the observation that every row-level casekit projection -- labels, time,
place and interaction features, rule scores -- is stateless and therefore
runs unchanged on a Structured Streaming DataFrame.
"""

from casekit.streaming.cases_stream import case_stream, featurize_stream

__all__ = ["case_stream", "featurize_stream"]
