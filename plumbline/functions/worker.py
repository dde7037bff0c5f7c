"""What a Python worker keeps between the tasks it runs."""

from __future__ import annotations

import sys
from collections.abc import Callable, Hashable
from typing import Any


def kept(key: Hashable, make: Callable[[], Any], most: int = 64) -> Any:
    """`make()`, built once per worker and key; at most `most` keys are held.

    The package travels with each task by value, its own globals included, so
    they start anew there. The interpreter's `sys` module does not.
    """
    store = sys.__dict__.setdefault("_plumbline_kept", {})
    if key not in store:
        if len(store) >= most:
            store.clear()
        store[key] = make()
    return store[key]
