"""Stored forms: the manifest, the write-ahead log and a data source that reads logs."""
