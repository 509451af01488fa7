"""Align messy per-entity, per-year tables into one audited long table, on Spark."""
