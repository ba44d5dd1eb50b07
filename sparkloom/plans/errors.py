"""Errors raised before planning."""


class ParameterError(ValueError):
    """A parameter is missing, unknown or out of range."""
