"""tallyforge: a Spark-first engine for causal analysis of sequential decision logs."""

__version__ = "0.1.0"
