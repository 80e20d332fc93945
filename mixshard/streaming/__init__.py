"""Streaming use of a fitted model.

The reference is batch only. What carries over to a stream is scoring: new
points are assigned to a fixed fitted model with the same batch operator
(stream-static join against the one-row model, no state). Refitting stays a
batch job.
"""

from mixshard.streaming.assign import assign_stream

__all__ = ["assign_stream"]
