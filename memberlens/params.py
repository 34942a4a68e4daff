"""Argument checks, run before any Spark job starts."""

from __future__ import annotations


class InvalidParameter(ValueError):
    """An argument is outside what a report accepts."""


def optional_text(name: str, value: str | None) -> str | None:
    if value is None:
        return None
    return required_text(name, value)


def required_text(name: str, value: str) -> str:
    if not isinstance(value, str) or not value:
        raise InvalidParameter(f"{name} must be a non-empty string")
    return value


def bounded_int(name: str, value: int, low: int, high: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise InvalidParameter(f"{name} must be a whole number from {low} to {high}")
    return value


def one_of(name: str, value: str, allowed: tuple[str, ...]) -> str:
    if value not in allowed:
        raise InvalidParameter(f"{name} must be one of {', '.join(allowed)}")
    return value


def positive_ids(name: str, values) -> list[int]:
    checked = list(values)
    for value in checked:
        if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
            raise InvalidParameter(f"{name} must hold positive whole numbers only")
    return checked
