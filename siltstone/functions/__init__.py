"""Scalar codecs: bytes, log records, Bloom filters, sizes."""
