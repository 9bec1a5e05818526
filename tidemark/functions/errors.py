"""Errors of the engine. Bad arguments are plain ValueErrors."""


class EngineError(Exception):
    """Anything the engine refuses or fails at."""


class DataContractError(EngineError):
    """Data that break the panel contract."""


class NotFittedError(EngineError):
    """A transform or model used before it was fitted."""
