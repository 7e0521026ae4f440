"""Operators for preparing training text. Nothing else in weftgraph imports this subpackage."""
