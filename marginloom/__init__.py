"""Margin-constrained population synthesis and audited statistical releases on Spark."""

__version__ = "0.1.0"
