from . import decision_flow, feature_flow, log_flow

__all__ = ["decision_flow", "feature_flow", "log_flow"]
