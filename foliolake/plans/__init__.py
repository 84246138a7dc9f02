"""Registered queries: operators bound to the tables of a directory, each with equivalent SQL."""
