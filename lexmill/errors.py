"""One exception for each kind of failure that callers can tell apart, raised before any job starts where possible."""

from __future__ import annotations

from enum import Enum


class EngineError(Exception):
    """Base of all; ``reason`` tells the cases of one kind apart."""

    Reason: type[Enum] | None = None

    def __init__(self, message: str, reason: Enum | None = None):
        super().__init__(message if reason is None else f"{reason.name}: {message}")
        self.reason = reason


class DocumentAlreadyExists(EngineError):
    pass


class DocumentNotFound(EngineError):
    pass


class BulkMutationError(EngineError):
    Reason = Enum("BulkMutationReason", "DUPLICATE_ID TOO_LARGE")


class EngineRejected(EngineError):
    Reason = Enum("RejectedReason", "QUEUE_FULL CLOSED")


class IndexLifecycleError(EngineError):
    Reason = Enum("IndexReason", "ALREADY_EXISTS BUILD_IN_PROGRESS CANCELLED")


class InvalidArgument(EngineError, ValueError):
    pass


class InvalidState(EngineError, RuntimeError):
    pass


class ScoreError(EngineError, ArithmeticError):
    """A score that isn't finite, or negative."""


class UnsupportedAnalyzer(EngineError):
    """Highlighting needs an analyzer that knows offsets."""


class SearchCursorError(EngineError):
    Reason = Enum("CursorReason", "UNSUPPORTED_CURSOR DIFFERENT_ENGINE DIFFERENT_REQUEST STALE_SNAPSHOT")


class SchemaError(EngineError, ValueError):
    pass


class DurabilityError(EngineError):
    Reason = Enum(
        "DurabilityReason",
        "STORAGE_IN_USE UNSUPPORTED_FORMAT SCHEMA_MISMATCH CORRUPT_LOG CORRUPT_CHECKPOINT CORRUPT_MANIFEST MISSING_FILE "
        "TARGET_EXISTS INCOMPATIBLE_HISTORY DUPLICATE_KEY PLAN_MISMATCH WRITE_FAILED CLOSED",
    )


class ReplicaReadError(EngineError):
    Reason = Enum("ReplicaReason", "INVALID_TOKEN UNSUPPORTED_TOKEN_VERSION INCOMPATIBLE_HISTORY PROGRESS_NOT_REACHED VIEW_NOT_ACTIVE")
