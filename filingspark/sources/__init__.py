"""Connectors: filings in files, folders, zip and tar archives, HTTP; CSV tables; sinks."""
