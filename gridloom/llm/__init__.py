"""Operators on the texts of a training corpus. Nothing else of the library imports this subpackage."""
