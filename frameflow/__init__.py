"""frameflow: a Spark-first engine for stacks of scientific frames and the tables around them."""

__version__ = "0.1.0"
