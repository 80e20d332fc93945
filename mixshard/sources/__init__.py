from mixshard.sources.points import (
    assign_shards,
    dense_ids,
    parse_points,
    points_from_table,
    read_text_points,
    shard_count_for,
    standardize,
)

__all__ = [
    "assign_shards",
    "dense_ids",
    "parse_points",
    "points_from_table",
    "read_text_points",
    "shard_count_for",
    "standardize",
]
