"""Errors the engine raises."""

from __future__ import annotations


class SiltError(Exception):
    """Base of all."""


class InvalidArgumentError(SiltError, ValueError):
    """An argument of a wrong type or value."""


class ClosedError(SiltError):
    """Use of a closed table, snapshot or log."""


class ConflictError(SiltError):
    """Another writer committed the same manifest version first."""


class CorruptionError(SiltError):
    """Stored bytes that cannot be right; ``offset`` is where, if known."""

    def __init__(self, message: str, offset: int | None = None):
        super().__init__(message if offset is None else f"{message} (offset {offset})")
        self.offset = offset


class TruncatedRecordError(CorruptionError):
    """A record ends too early or has an impossible field."""


class ChecksumMismatchError(CorruptionError):
    """A record's checksum differs from the stored one."""

    def __init__(self, expected: int, actual: int, offset: int | None = None):
        super().__init__(f"checksum {actual:#010x}, stored {expected:#010x}", offset)
        self.expected, self.actual = expected, actual
