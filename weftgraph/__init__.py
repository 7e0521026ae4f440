"""Graph analytics and message passing as plain Spark plans."""

__version__ = "0.1.0"
