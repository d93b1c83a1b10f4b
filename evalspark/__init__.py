"""evalspark: distributed scoring of model outputs on benchmark tables.

Everything is expressed with the DataFrame API so Catalyst plans it:
column expressions for answer normalisation and signs, hash aggregates
for benchmark metrics, joins for request/response attachment and
Structured Streaming for restartable incremental scoring.
"""

from evalspark.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
