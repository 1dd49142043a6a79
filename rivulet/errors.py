"""Status codes and the exceptions that stand for them; a buffer of log lines."""

from __future__ import annotations

import logging

#: Codes of a module's outcome.
OK, GENERIC, BAD_ARGUMENT, NO_MEMORY, UNSUPPORTED, NOT_FOUND, TIMED_OUT = 0, -1, -2, -3, -4, -5, -40


class StatusError(RuntimeError):
    code = GENERIC


class BadArgument(StatusError):
    code = BAD_ARGUMENT


class NoMemory(StatusError):
    code = NO_MEMORY


class Unsupported(StatusError):
    code = UNSUPPORTED


class NotFound(StatusError):
    code = NOT_FOUND


class TimedOut(StatusError):
    code = TIMED_OUT


def raise_for(code: int, message: str = "") -> None:
    """Nothing for 0, else the code's exception."""
    if code == OK:
        return
    kinds = {c.code: c for c in (BadArgument, NoMemory, Unsupported, NotFound, TimedOut)}
    raise kinds.get(code, StatusError)(message or f"status {code}")


class LogBuffer(logging.Handler):
    """Keeps the lines of a logger from a level on."""

    def __init__(self, name: str = "rivulet", level: int = logging.INFO):
        super().__init__(level)
        self.lines: list[str] = []
        self.logger = logging.getLogger(name)
        self.logger.addHandler(self)

    def emit(self, record: logging.LogRecord) -> None:
        self.lines.append(self.format(record))

    def detach(self) -> list[str]:
        self.logger.removeHandler(self)
        return self.lines
