"""Cutting a record so that its prompt fits a model's context: the chunks that are most like the task stay."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from lumora.functions.text import CHARS

#: Characters that a record needs at the least; a task that leaves less is an error.
LEAST = 64
JOINT = "..."


def tokens(chars: int) -> int:
    """As count_tokens() has it."""
    return chars // CHARS + 1


def room(budget: int, *parts: str) -> int:
    """Characters that a prompt of at most so many tokens has besides these parts."""
    left = CHARS * budget - 1 - sum(map(len, parts))
    if left < LEAST:
        raise ValueError(f"{budget} tokens leave {left} characters for a record; {LEAST} are needed")
    return left


def _dumped(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def escaped(text: str, times: int) -> str:
    """The text as it stands in JSON that is itself a string of JSON, and so on."""
    for _ in range(times):
        text = _dumped(text)[1:-1]
    return text


def _leaves(value, new: dict | None = None, path: tuple = ()) -> tuple[dict, object]:
    """The texts of a record at any depth by their paths, and the record with `new` ones, or empty ones, in their place."""
    if isinstance(value, str):
        return {path: value}, (new or {}).get(path, "")
    if not isinstance(value, dict | list):
        return {}, value
    found, made = {}, {} if isinstance(value, dict) else [None] * len(value)
    for k, x in value.items() if isinstance(value, dict) else enumerate(value):
        own, made[k] = _leaves(x, new, (*path, k))
        found |= own
    return found, made


@dataclass
class Fitter:
    """fit(record, limit): the JSON record with its texts cut to at most `limit` characters; one within it stays as it is.

    Each text is cut in chunks, a 32nd of the record or a tenth of the room long (half of that where there are
    sides). `embed` gives vectors of texts; a field's chunks are ranked by their cosine to the task's vector,
    or by position without it. Fields take turns, best chunks first, until one does not fit, and a field is its
    chunks in their first order, joined by dots. The best chunk is cut itself if it alone is too
    long. Texts within lists and objects are fields too; if the rest leaves no room for them, a value that is no
    text counts as its JSON text.
    `sides` are groups of fields that share the room evenly, as the two records of a pair do. `wraps` says how
    often the record will be escaped; lengths are those of the final text.
    """

    task: str
    embed: Callable[[list[str]], list[list[float]]] | None = None
    sides: tuple[tuple[str, ...], ...] = ()
    wraps: int = 0
    batch: int = 64
    _task_vector: np.ndarray | None = None

    def fit(self, record: str, limit: int) -> str:
        if len(escaped(record, self.wraps)) <= limit:
            return record
        value = json.loads(record)
        texts, bare = _leaves(value)
        size = lambda x: len(escaped(_dumped(x), self.wraps))
        if size(bare) > limit - LEAST // 2 and isinstance(value, dict):
            value = {k: x if isinstance(x, str) or x is None else _dumped(x) for k, x in value.items()}
            texts, bare = _leaves(value)
        free = limit - size(bare)
        if free < 0:
            raise ValueError(f"a record without its texts takes {size(bare)} of {limit} characters")
        sides = [[k for k in texts if k and k[0] in side] for side in self.sides] or [list(texts)]
        sides[-1] += [k for k in texts if not any(k in side for side in sides)]
        chars = CHARS * max(1, min(tokens(len(record)) // 32, tokens(limit) // 10) // len(sides))
        kept = {}
        for side in sides:
            kept |= self._chosen({k: texts[k] for k in side}, free // len(sides), chars)
        return _dumped(_leaves(value, kept)[1])

    def _chosen(self, texts: dict[str, str], free: int, chars: int) -> dict[str, str]:
        cost = lambda x: len(escaped(x, self.wraps + 1))
        if sum(map(cost, texts.values())) <= free:
            return texts
        pieces = [(k, i, x[at : at + chars]) for k, x in texts.items() for i, at in enumerate(range(0, len(x), chars))]
        place = {k: j for j, k in enumerate(texts)}
        turns = []
        for k in texts:
            own = [(i, x) for f, i, x in pieces if f == k]
            likeness = self._likeness([x for _, x in own])
            turns += [(rank, place[k], k, *own[at]) for rank, at in enumerate(np.argsort(-likeness, kind="stable").tolist())]
        chosen: dict[str, list] = {k: [] for k in texts}
        for n, (_, _, k, i, x) in enumerate(sorted(turns)):
            need = cost(x) + (len(JOINT) if chosen[k] else 0)
            if need > free:
                if n:
                    break
                while cost(x) > free:  # the best chunk alone is too long
                    x = x[: max(0, len(x) - max(1, (cost(x) - free) // 12))]
                need = cost(x)
            chosen[k].append((i, x))
            free -= need
        return {k: JOINT.join(x for _, x in sorted(own)) for k, own in chosen.items()}

    def _likeness(self, chunks: list[str]) -> np.ndarray:
        if self.embed is None or not chunks:
            return np.zeros(len(chunks))
        if self._task_vector is None:
            self._task_vector = np.array(self.embed([self.task])[0], dtype=np.float64)
        x = np.array([v for at in range(0, len(chunks), self.batch) for v in self.embed(chunks[at : at + self.batch])], dtype=np.float64)
        norms = np.linalg.norm(x, axis=1) * np.linalg.norm(self._task_vector)
        return np.divide(x @ self._task_vector, norms, out=np.zeros(len(x)), where=norms > 0)
