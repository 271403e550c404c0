"""gigmesh: record linkage and listing analytics for event data on Spark."""

__version__ = "0.1.0"
