"""All registered queries."""

from spanlake.plans import annotation_queries, join_queries, sampling_queries, sequence_queries, source_queries, streaming_queries, suppression_queries, text_queries  # noqa: F401
from spanlake.plans.registry import ORACLES, QUERIES  # noqa: F401
