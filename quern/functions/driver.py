"""Functions of the driver process: values, ids, waits, environment."""

from __future__ import annotations

import base64
import hashlib
import itertools
import os
import pickle
import platform
import sys
import threading
import uuid
from collections.abc import Iterator

_process = uuid.uuid4().hex[:12]
_numbers = itertools.count(1)
_lock = threading.Lock()


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def python_version() -> str:
    return platform.python_version()


def debugging() -> bool:
    return os.environ.get("PYTHON_DEBUG", "").lower() == "quern"


def loaded_packages() -> list[str]:
    """Top-level modules that this process has imported, without the standard library."""
    names = {m.partition(".")[0] for m in list(sys.modules)}
    return sorted(n for n in names if not n.startswith("_") and n not in sys.stdlib_module_names)


def message_id() -> str:
    """A new number for each message of this process, as text."""
    with _lock:
        return str(next(_numbers))


def dedup_id() -> str:
    """A message's id that no other process gives out."""
    return f"{_process}-{message_id()}"


def to_contents(value: object) -> str:
    return base64.b64encode(pickle.dumps(value)).decode()


def from_contents(contents: str) -> object:
    """The value behind ``to_contents``. Only for text that this engine wrote: unpickling runs code."""
    return pickle.loads(base64.b64decode(contents))


def waits(first: int = 5, most: int = 80) -> Iterator[int]:
    """5, 10, 20, 40, 80, 80, ... seconds."""
    t = first
    while True:
        yield t
        t = min(t * 2, most)
