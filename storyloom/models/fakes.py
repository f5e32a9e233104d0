"""Deterministic stand-ins for models, for tests and dry runs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Any


class Scripted:
    """Gives the outputs of a script one after another, and keeps what it was asked."""

    def __init__(self, outputs: list[Any]):
        self.outputs, self.asked = list(outputs), []

    def __call__(self, prompt: Any) -> Any:
        self.asked.append(prompt)
        out = self.outputs.pop(0)
        if isinstance(out, Exception):
            raise out
        return out


def hashed_vector(size: int = 16) -> Callable[[str], list[float]]:
    """A vector of numbers within -1 and 1 that depends on the text alone."""

    def call(text: str) -> list[float]:
        data = b"".join(hashlib.sha256(f"{k}:{text}".encode()).digest() for k in range(-(-size // 32)))
        return [x / 127.5 - 1 for x in data[:size]]

    return call


def paragraph_segmenter() -> Callable[[dict], dict]:
    """Scenes at blank lines: what a segmenter would give for a prompt with ``chunk`` and ``final``."""

    def call(prompt: dict) -> dict:
        parts = [p for p in prompt["chunk"].split("\n\n") if p.strip()]
        scenes = [{"end_text": p.strip()[-20:], "location": "", "time": "", "characters": [], "boundary_type": "narrative"} for p in parts]
        return {"scenes": scenes, "has_more": not prompt["final"], "summary": f"{len(parts)} scenes"}

    return call
