"""Model files by name and digest, in a folder that caches them."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

from millrace.model import CorruptStore, MillraceError


def _digest(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def resolve(folder: str, files: dict[str, str], fetch: Callable[[str], bytes] | None = None) -> dict[str, str]:
    """Paths of the files (name to SHA-256) in the folder, on the machine that calls it.

    A file that is there must have its digest. One that is missing is fetched,
    checked, and put in place in one step; without fetch it is an error.
    """
    os.makedirs(folder, exist_ok=True)
    out = {}
    for name, digest in files.items():
        if os.path.basename(name) != name or name.startswith("."):
            raise MillraceError(f"{name!r} is no file name")
        path = os.path.join(folder, name)
        if os.path.exists(path):
            if _digest(path) != digest:
                raise CorruptStore(f"{name} differs from its digest")
        else:
            if fetch is None:
                raise MillraceError(f"{name} is not in {folder}")
            body = fetch(name)
            if hashlib.sha256(body).hexdigest() != digest:
                raise CorruptStore(f"{name} came with another digest")
            with open(f"{path}.part", "wb") as f:
                f.write(body)
            os.replace(f"{path}.part", path)
        out[name] = path
    return out
