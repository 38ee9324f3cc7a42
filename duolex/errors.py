"""What can go wrong with a request, and how it is told to whoever asked."""

from __future__ import annotations


class ModelError(RuntimeError):
    """The embedder or its model can't be used."""

    status, code = 503, "alignment_model_unavailable"


class ProcessingError(RuntimeError):
    """The request can't be served with the settings, or a pair can't be aligned."""

    status, code = 500, "alignment_failed"


def told(error: BaseException) -> tuple[int, str]:
    """(status, code) of an error. One that a Python worker raised comes wrapped, with its class in the text."""
    for kind in (ModelError, ProcessingError):
        if isinstance(error, kind) or f"{kind.__name__}:" in str(error):
            return kind.status, kind.code
    return ProcessingError.status, ProcessingError.code
