"""Folders of texts, books, takes and sidecars as tables, and JSON documents written and read with quarantine."""
