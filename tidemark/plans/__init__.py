"""Registered queries: each pairs a DataFrame builder with the SQL that must give the same rows."""
