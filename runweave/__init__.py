"""Run-length vectors and keyed collections of them as Spark plans."""

__version__ = "0.1.0"
