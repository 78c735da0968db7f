"""Filings analytics on Spark: XBRL and inline XBRL documents to fact tables, and queries over them."""
