"""Registered queries bound to the supplied tables, with their check SQL."""
