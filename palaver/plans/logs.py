"""The library's log: a file that rotates, and the console."""

from __future__ import annotations

import logging.config
import os

#: Bytes of a log file, and how many older ones are kept.
FILE_BYTES, OLDER_FILES = 5 * 1024 * 1024, 5
LINE = "{asctime} {levelname:<8} {name}: {message}"


def to_file(path: str, level: str = "INFO") -> logging.Logger:
    """Send the library's messages on this machine to a file and the console.

    Another call sets both up anew, so messages go to the last file that was named, once.
    """
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    logging.config.dictConfig(
        {
            "version": 1,
            "disable_existing_loggers": False,
            "formatters": {"line": {"format": LINE, "style": "{"}},
            "handlers": {
                "console": {"class": "logging.StreamHandler", "formatter": "line"},
                "file": {"class": "logging.handlers.RotatingFileHandler", "formatter": "line", "filename": path, "maxBytes": FILE_BYTES, "backupCount": OLDER_FILES, "encoding": "utf-8"},
            },
            "loggers": {"palaver": {"level": level, "handlers": ["console", "file"]}},
        }
    )
    return logging.getLogger("palaver")
