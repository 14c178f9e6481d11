"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it; deleting the folder leaves the rest
of the library working.  Each module documents what it does with null columns,
empty and very long texts, repeated rows, empty tables and extra columns.
"""
