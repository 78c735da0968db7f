"""Incremental ingestion of filings."""
