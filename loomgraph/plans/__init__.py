"""Registered queries: operators bound to the driver tables, each with its SQL twin."""
