"""Per-Python-worker caches for models (generators, external scorers), and work on an
Arrow batch by bounded slices.

A model is built once per worker process and reused for every batch.  The
cache slot is a random id given to each factory object on the driver and
kept for that object's lifetime, so two factories never share a slot (unlike
``id()``, which Python reuses after garbage collection).
"""

from __future__ import annotations

import uuid
import weakref

_SLOTS: "weakref.WeakKeyDictionary" = weakref.WeakKeyDictionary()


def worker_slot(factory) -> str:
    """A stable, unique cache key for ``factory`` (driver side)."""
    try:
        slot = _SLOTS.get(factory)
        if slot is None:
            slot = _SLOTS[factory] = uuid.uuid4().hex
        return slot
    except TypeError:  # not weak-referenceable: a fresh slot per use
        return uuid.uuid4().hex


def runs(column, sizes, limit: int):
    """Slices of an Arrow array whose ``sizes`` add up to at most ``limit``, or one larger element."""
    start, size = 0, 0
    for i, n in enumerate(sizes):
        if i > start and size + n > limit:
            yield column.slice(start, i - start)
            start, size = i, 0
        size += int(n)
    if start < len(column):
        yield column.slice(start)
