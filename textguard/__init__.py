"""Screening of untrusted text as Spark DataFrame operations."""
