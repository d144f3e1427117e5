from . import (
    candidates,
    correlate,
    evaluate,
    features,
    lut,
    metrics,
    modelling,
    ordered,
    policy,
    profile,
    quantiles,
    replay,
    sampling,
)

__all__ = [
    "candidates", "correlate", "evaluate", "features", "lut", "metrics", "modelling", "ordered", "policy",
    "profile", "quantiles", "replay", "sampling",
]
