"""Operators bound to the test tables, and the SQL that checks them."""
