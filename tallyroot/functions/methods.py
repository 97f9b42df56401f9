"""The small language of search methods, and presets."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Method:
    """stage1, then maybe a reranker over `depth` candidates with an optional token tier."""

    stage1: str
    rerank: str | None = None
    depth: int | None = None
    tier: int | None = None


STAGES = ("vector", "bm25", "fulltext", "hybrid", "maxsim")
RERANKERS = ("maxsim", "crossenc")
_form = re.compile(r"^(?P<a>[a-z0-9]+)(?:\s*(?:→|->)\s*(?P<b>[a-z]+)@(?P<n>\d+)(?::t(?P<t>\d+))?)?$")


def parse_method(text: str) -> Method:
    """`hybrid`, `vector→maxsim@200`, `bm25->maxsim@200:t15`; anything else is an error."""
    m = _form.match(text.strip())
    if not m or m["a"] not in STAGES or (m["b"] and m["b"] not in RERANKERS) or (m["n"] and int(m["n"]) < 1):
        raise ValueError(f"no such method: {text!r}")
    return Method(m["a"], m["b"], int(m["n"]) if m["n"] else None, int(m["t"]) if m["t"] else None)


def with_preset(preset: dict, given: dict) -> dict:
    """A preset's settings under the request's own; nulls of the request do not override."""
    return {**preset, **{k: v for k, v in given.items() if v is not None}}
