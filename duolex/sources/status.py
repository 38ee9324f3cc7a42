"""Liveness and readiness of a job, as plain data."""

from __future__ import annotations

from ..options import Settings


def live() -> dict:
    return {"status": "ok"}


def ready(settings: Settings, loaded: bool) -> dict:
    return {"status": "ready", "model": settings.model, "model_loaded": loaded, "load_mode": "eager" if settings.eager_load else "lazy"}
