"""Structured Streaming into a table, and keyed latest values over a stream."""
