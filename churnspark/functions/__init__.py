from . import bins, numeric

__all__ = ["bins", "numeric"]
