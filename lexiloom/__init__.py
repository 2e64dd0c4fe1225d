"""Text analytics and training-data preparation as lazy Spark DataFrame plans."""

__version__ = "0.1.0"
