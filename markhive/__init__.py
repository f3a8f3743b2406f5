"""markhive: clean and compare large collections of bookmarks with Spark."""

from .options import CompareOptions, KeyOptions

__all__ = ["CompareOptions", "KeyOptions"]
__version__ = "0.1.0"
