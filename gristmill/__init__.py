"""gristmill: corpus-quality and leakage-safe dataset operators on PySpark."""
