"""One JSON object per log line, with the run and the document that a line belongs to."""

from __future__ import annotations

import json
import logging
import sys
import time
from contextlib import contextmanager
from contextvars import ContextVar

_context: ContextVar[dict] = ContextVar("context", default={})  # noqa: B039  never changed in place
_OWN = frozenset(logging.makeLogRecord({}).__dict__) | {"message", "asctime"}


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        out = {"timestamp": time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(record.created)) + f".{int(record.msecs):03d}Z", "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        out |= _context.get() | {k: v for k, v in record.__dict__.items() if k not in _OWN}
        if record.exc_info:
            out["exception"] = self.formatException(record.exc_info)
        return json.dumps(out, default=str, ensure_ascii=False)


@contextmanager
def context(**fields: object):
    """Puts fields such as run_id on every line logged inside."""
    token = _context.set(_context.get() | fields)
    try:
        yield
    finally:
        _context.reset(token)


def logger(name: str = "docmill", level: str = "INFO", stream=None) -> logging.Logger:
    """The named logger with one JSON handler, however often it is asked for."""
    out = logging.getLogger(name)
    out.setLevel(level)
    out.propagate = False
    handler = logging.StreamHandler(stream or sys.stderr)
    handler.setFormatter(JsonFormatter())
    out.handlers = [handler]
    return out
