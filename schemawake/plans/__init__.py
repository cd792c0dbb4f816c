"""Registered queries: the operators bound to the driver tables, and the SQL they are checked with."""
