"""parlance: natural-language understanding and text processing as Spark DataFrame transformations."""

__version__ = "0.1.0"
