"""ledgerlens: analytical views, slice mining and governed reporting queries on Spark."""

__version__ = "0.1.0"
