"""Registered queries over the supplied tables, one module a section of the operator inventory."""
