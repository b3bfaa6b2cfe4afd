"""Record linkage and longitudinal panels on PySpark."""

__version__ = "0.1.0"
