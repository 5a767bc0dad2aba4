"""Readers and writers of documents, works, filings and gold sets."""
