"""Overpass responses over HTTP with retries and a cache of files."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from collections.abc import Callable, Iterable
from pathlib import Path

ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 5, 5.0, 120.0


def fill(template: str, **values) -> str:
    """``template`` with each {name} of ``values`` replaced; other braces stay."""
    for name, value in values.items():
        template = template.replace("{" + name + "}", str(value))
    return template


def union(parts: Iterable[str], timeout: int = 180, out: str = "out body geom;") -> str:
    """One Overpass query over several selections."""
    return f"[out:json][timeout:{timeout}];({''.join(p.rstrip(';') + ';' for p in parts)});{out}"


def _post(url: str, query: str, timeout: float) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, data=query.encode(), method="POST"), timeout=timeout) as answer:  # noqa: S310
        return answer.read()


def fetch(
    query: str, url: str, cache_dir: str, use_cache: bool = True, timeout: float = 180, post: Callable[[str, str, float], bytes] = _post, wait: Callable[[float], None] = time.sleep
) -> Path:
    """The file that holds the response to ``query``; a cached one of the same text is taken unless ``use_cache`` is off.

    Five attempts with waits that double from 5 to 120 seconds; the last failure is raised. Text that is no JSON is a
    failure and is never cached.
    """
    path = Path(cache_dir) / f"{hashlib.sha256(query.encode()).hexdigest()[:16]}.json"
    if use_cache and path.exists():
        return path
    for attempt in range(ATTEMPTS):
        try:
            body = post(url, query, timeout)
            json.loads(body)
            break
        except (OSError, ValueError):
            if attempt == ATTEMPTS - 1:
                raise
            wait(min(LONGEST_WAIT, FIRST_WAIT * 2**attempt))
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_suffix(".part")
    part.write_bytes(body)
    part.replace(path)
    return path
