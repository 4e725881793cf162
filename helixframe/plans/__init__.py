"""Queries over whole tables, and the SQL that states their results."""
