"""Memory of Python workers: a worker lives on after a task, and what the task has freed is given back to the system."""

from __future__ import annotations

import contextlib
import ctypes
import functools

import pyarrow as pa


@functools.cache
def _trim():
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        return ctypes.CDLL(None).malloc_trim
    return None


def give_back() -> None:
    """Returns freed memory of Arrow's pool and of the C heap to the system."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def tidied(run):
    """A function of mapInArrow that gives back at its end; by then run's own variables are gone."""

    def own(batches):
        yield from run(batches)
        give_back()

    return own
