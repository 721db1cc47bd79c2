"""Trade complexity and link prediction as Spark DataFrame operators."""

__version__ = "0.1.0"
