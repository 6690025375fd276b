"""Decision analytics and corpus preparation as PySpark plans."""

__version__ = "0.1.0"
