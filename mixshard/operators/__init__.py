"""DataFrame operators: scoring, summaries, merges, evaluation, samplers."""
