"""Logging presets over the standard library."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass


@dataclass(frozen=True)
class LogConfig:
    level: str = "INFO"
    json: bool = False
    file: str | None = None

    @classmethod
    def development(cls) -> LogConfig:
        return cls("DEBUG")

    @classmethod
    def production(cls) -> LogConfig:
        return cls("INFO", json=True)


def init_logging(config: LogConfig = LogConfig()) -> logging.Logger:
    logger = logging.getLogger("vecrel")
    for handler in list(logger.handlers):
        logger.removeHandler(handler)
    handler = logging.FileHandler(config.file) if config.file else logging.StreamHandler()
    form = '{"time": "%(asctime)s", "level": "%(levelname)s", "message": "%(message)s"}' if config.json else "%(asctime)s %(levelname)s %(message)s"
    handler.setFormatter(logging.Formatter(form))
    logger.addHandler(handler)
    logger.setLevel(config.level)
    return logger


def init_from_env() -> logging.Logger:
    return init_logging(LogConfig(os.environ.get("LOG_LEVEL", "INFO").upper(), os.environ.get("LOG_FORMAT") == "json", os.environ.get("LOG_FILE")))
