"""Settings that change results, with their defaults; the environment is never read."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field, fields

from tessella.operators.diagnostics import Thresholds


@dataclass(frozen=True)
class Config:
    fhir_version: str = "4.0.1"
    fhir_packages: str = ""
    mappings_folder: str | None = None
    mappings_extension: str = ".map"
    thresholds: Thresholds = field(default_factory=Thresholds)
    refresh_seconds: float | None = None

    def __post_init__(self):
        for f in fields(Thresholds):
            level = getattr(self.thresholds, f.name)
            if not isinstance(level, int) or level < 0:
                raise ValueError(f"{f.name} must be a non-negative integer")
        if not self.fhir_version:
            raise ValueError("fhir_version must not be empty")

    @property
    def stateless(self) -> bool:
        """No source of saved mappings is set."""
        return not self.mappings_folder or self.mappings_folder.strip().lower() in ("", "n/a")


def log_level(value: object) -> int | None:
    """A logging level for a name or alias (fixed values); anything else gives None."""
    names = {
        "silent": logging.CRITICAL + 10, "none": logging.CRITICAL + 10, "off": logging.CRITICAL + 10, "debug": logging.DEBUG,
        "info": logging.INFO, "warn": logging.WARNING, "warning": logging.WARNING, "error": logging.ERROR, "err": logging.ERROR,
    }
    return names.get(value.strip().lower()) if isinstance(value, str) else None
