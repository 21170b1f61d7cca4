"""Part of the screening engine."""
