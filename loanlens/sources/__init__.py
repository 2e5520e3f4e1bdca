"""Loan tables, their schemas and the report sinks."""
