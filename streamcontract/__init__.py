"""Contract-governed event data on Spark: streams, schema registry, JSON-Schema validation and string contracts."""

__version__ = "0.1.0"
