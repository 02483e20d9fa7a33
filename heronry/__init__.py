"""heronry: table operators for bulk archive reconciliation on PySpark."""

__version__ = "0.1.0"
