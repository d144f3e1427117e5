from . import logs, luts, sinks, slots

__all__ = ["logs", "luts", "sinks", "slots"]
