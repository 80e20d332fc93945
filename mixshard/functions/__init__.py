from mixshard.functions.vectors import (
    fingerprint,
    log_density,
    posterior_mean,
    posterior_var,
    safe_log,
    sqdist,
    vector_mean,
    vector_weighted_mean,
    zero_vector,
)

__all__ = [
    "fingerprint",
    "log_density",
    "posterior_mean",
    "posterior_var",
    "safe_log",
    "sqdist",
    "vector_mean",
    "vector_weighted_mean",
    "zero_vector",
]
