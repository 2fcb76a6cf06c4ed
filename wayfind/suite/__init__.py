"""Queries over the driver's tables: one for each operator, with its SQL."""
