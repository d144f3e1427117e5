from .registry import oracles, registered

__all__ = ["oracles", "registered"]
