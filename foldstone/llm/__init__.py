"""Operators for preparing training text and for large key sets. Nothing outside this subpackage imports it."""
