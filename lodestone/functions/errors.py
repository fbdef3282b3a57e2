"""Errors of the engine: a code and its name, raised while a plan is built wherever possible."""

from __future__ import annotations

# Error codes and their names.
CODES = {
    "BadValue": 2,
    "UnknownError": 8,
    "FailedToParse": 9,
    "TypeMismatch": 14,
    "IllegalOperation": 20,
    "NamespaceNotFound": 26,
    "IndexNotFound": 27,
    "CursorNotFound": 43,
    "NamespaceExists": 48,
    "MaxTimeMSExpired": 50,
    "CommandNotFound": 59,
    "ImmutableField": 66,
    "InvalidOptions": 72,
    "InvalidNamespace": 73,
    "ChangeStreamHistoryLost": 286,
    "DuplicateKey": 11000,
    "UnrecognizedPipelineStage": 40324,
}


class EngineError(Exception):
    """A query that cannot be run: ``name`` is one of ``CODES``."""

    def __init__(self, name: str, message: str, **details):
        super().__init__(f"{name} ({CODES[name]}): {message}")
        self.name, self.code, self.details = name, CODES[name], details


def bad_value(message: str) -> EngineError:
    return EngineError("BadValue", message)
