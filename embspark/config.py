"""Store configuration and status codes."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum


class Status(IntEnum):
    OK = 0
    AGAIN = 1
    FLUSH_NEEDED = 2
    IO = 3
    OOM = 4
    NOT_FOUND = 5
    CORRUPT = 6
    FULL = 7
    INVALID = 8
    BUSY = 9
    DIM_MISMATCH = 10


@dataclass(frozen=True)
class StoreConfig:
    """``dims`` may be empty if ``auto_create`` is set; ``pending_limit`` is in rows, ``page_size`` in bytes; ``batch_limit`` rows a put at most (0: any)."""

    dims: tuple[int, ...] = ()
    auto_create: bool = False
    page_size: int = 4096
    pending_limit: int = 1_000_000
    buckets: int = 8
    mode: str = "rw"
    full_every: int = 10
    batch_limit: int = 0

    def __post_init__(self):
        if any(d <= 0 for d in self.dims) or (not self.dims and not self.auto_create):
            raise ValueError("give dims, all above 0, or auto_create")
        if self.mode not in ("r", "rw"):
            raise ValueError("mode is r or rw")
