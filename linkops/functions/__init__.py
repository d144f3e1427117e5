from . import expr, radio

__all__ = ["expr", "radio"]
