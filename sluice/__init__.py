"""Sluice: bulk record ingestion as plain Spark jobs.

Files, JSON batches and OCR word tables become validated, de-duplicated user,
product and category records; records become jobs; jobs upsert the stored
tables.  Every step is a DataFrame transform.
"""
