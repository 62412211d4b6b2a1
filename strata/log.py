"""Logging on the driver."""

from __future__ import annotations

import logging
import logging.config
import os


def get_logger(name: str) -> logging.Logger:
    return logging.getLogger(f"strata.{name}")


def setup_logging(level: str | None = None) -> None:
    """Lines of the package's loggers on standard error, from $STRATA_LOG_LEVEL or INFO up; a second call only changes the level."""
    chosen = (level or os.environ.get("STRATA_LOG_LEVEL", "")).upper() or "INFO"
    logging.config.dictConfig(
        {
            "version": 1,
            "disable_existing_loggers": False,
            "formatters": {"line": {"format": "{levelname:.1s} {asctime} {name} | {message}", "style": "{", "datefmt": "%H:%M:%S"}},
            "handlers": {"stderr": {"class": "logging.StreamHandler", "formatter": "line"}},
            "loggers": {"strata": {"handlers": ["stderr"], "level": chosen, "propagate": False}},
        }
    )
