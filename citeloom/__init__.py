"""citeloom: evidence analytics over large text collections, as PySpark DataFrame operators."""

__version__ = "0.1.0"
