from . import feedback, metrics, state

__all__ = ["feedback", "metrics", "state"]
