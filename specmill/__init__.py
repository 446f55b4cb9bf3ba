"""specmill: a Spark-first engine that audits collections of technical specifications."""

__version__ = "0.1.0"
