"""Suppression of endpoints: while VIGIL_STRUCTURAL_ONLY is 1, nothing that tells a result can be planned."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable


class EndpointsSuppressed(RuntimeError):
    """An endpoint was asked for in a structural run."""


def endpoint(work: Callable) -> Callable:
    @functools.wraps(work)
    def run(*args, **named):
        if os.environ.get("VIGIL_STRUCTURAL_ONLY") == "1":
            raise EndpointsSuppressed(work.__name__)
        return work(*args, **named)

    return run
