"""The engine's helpers for tables in the folder that driver and executors share, under the name that operators know."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa

from voxframe.shared import SETTING, clear, publish, remove, scratch, shared_root

__all__ = ["SETTING", "clear", "kept", "publish", "remove", "scratch", "shared_root"]

_KEPT: dict = {}


def kept(owner: Any, make: Callable[[], Any]) -> Any:
    """What this Python worker keeps for the owner's tasks, made when first asked for. Workers outlive stages, so only the last
    owner's is kept: what another has left is let go, with the memory that Arrow holds for it."""
    if owner not in _KEPT:
        _KEPT.clear()
        pa.default_memory_pool().release_unused()
        _KEPT[owner] = make()
    return _KEPT[owner]
