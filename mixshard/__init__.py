"""mixshard: distributed Dirichlet-process-mixture clustering on Spark DataFrames.

Points live in a DataFrame ``(point_id BIGINT, x ARRAY<DOUBLE>, label INT, shard INT)``.
Everything between random draws is plain column arithmetic; the two sequential
samplers (per-shard sweeps, global merge) run as grouped pandas functions over
Spark-partitioned groups whose size is bounded by construction.
"""

from mixshard.params import DPMParams
from mixshard.session import ensure_checkpoint_dir, get_session

__all__ = ["DPMParams", "ensure_checkpoint_dir", "get_session"]
