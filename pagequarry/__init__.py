"""pagequarry: a PySpark engine for page-layout evaluation, gating and corpus preparation."""

__version__ = "0.1.0"
