"""firnspark: grounding-point analytics over ordered along-track series, on Spark."""

__version__ = "0.1.0"
