"""Whole plans: SQL templates and the driver's queries."""
