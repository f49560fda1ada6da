"""What the operators of this subpackage share: the shared folder, cutting lineage, words, components.

Everything that leaves a task goes through Spark's own writers into the folder that the session names in
``spark.checkpoint.dir`` (shared by driver and executors), so a lost executor costs a recomputation of its tasks only.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.lineage import materialize, new_path, release, shared_dir, ship
from graphloom.operators.algorithms import components

__all__ = ["ascii_lower", "components", "materialize", "new_path", "per_bucket", "release", "shared_dir", "ship", "takes_over", "unused", "word_count"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def word_count(col: Column) -> Column:
    """Number of words as bigint; null counts 0."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("bigint")


def per_bucket(rows: int, size: int = 20_000) -> int:
    """Buckets that hold about `size` rows each."""
    return max(1, -(-rows // size))


#: What operators keep in a Python worker between tasks: the operator's name and a function that forgets it.
_KEPT: dict[str, Callable[[], object]] = {}


def takes_over(name: str, forget: Callable[[], object] = bool) -> None:
    """A task of operator `name` begins in this Python worker. Spark uses its workers again for every operator, so what others have kept in it is forgotten and its memory given back."""
    others = [k for k in _KEPT if k != name]
    for k in others:
        _KEPT.pop(k)()
    _KEPT[name] = forget
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # glibc only
            ctypes.CDLL(None).malloc_trim(0)


def unused(taken: list[str], name: str) -> str:
    """name, or else name with as many underscores before it as keep it apart from the columns in `taken` (Spark's names don't tell cases apart)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name
