"""Registered queries: each operator applied to the driver's tables, with its SQL twin."""
