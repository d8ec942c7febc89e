"""rankmill: retrieval, evaluation and text-data analytics as lazy Spark DataFrame operators."""

__version__ = "0.1.0"
