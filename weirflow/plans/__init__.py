"""Registered queries: each pairs a DataFrame plan with the SQL it must agree with."""
