"""Suffix order of one byte string by two-stage sorting, to the depth that a span asks for."""

from __future__ import annotations

import numpy as np


def eight_bytes(text: np.ndarray, beyond: int) -> np.ndarray:
    """The 8 bytes from every position on as one number, most significant first; zeros lie beyond the end."""
    padded = np.zeros(len(text) + beyond + 8, np.uint8)
    padded[: len(text)] = text
    return np.ndarray(len(text) + beyond, ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)


def rising(text: np.ndarray) -> np.ndarray:
    """Whether the suffix at each position is smaller than its successor. The last one is not: what follows it is empty."""
    after = np.r_[text[1:].astype(np.int16), -1]
    differs = np.flatnonzero(text.astype(np.int16) != after)
    decides = differs[np.searchsorted(differs, np.arange(len(text)))]
    return text[decides] < after[decides]


def _direct(keys: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` in the order of the suffixes there, compared by ``depth`` bytes, 8 at a time; groups that are settled drop out."""
    order = np.argsort(keys[at], kind="stable")
    at = at[order]
    new = np.r_[True, keys[at[1:]] != keys[at[:-1]]] if len(at) else np.zeros(0, bool)
    place, group = _open(np.arange(len(at)), np.cumsum(new))
    for d in range(8, depth, 8):
        if not len(place):
            break
        key = keys[at[place] + d]
        differs = np.r_[False, (group[1:] == group[:-1]) & (key[1:] != key[:-1])]
        if differs.any():
            mixed = np.zeros(group[-1] + 1, bool)
            mixed[group[differs]] = True
            some = np.flatnonzero(mixed[group])
            order = some[np.lexsort((key[some], group[some]))]
            moved, moved_key = at[place[order]], key[order]
            at[place[some]] = moved
            key[some] = moved_key
            new = np.r_[True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])]
            place, group = _open(place, np.cumsum(new))
    return at


def _open(place: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose group has two members or more, groups numbered anew."""
    if not len(group):
        return place, group
    many = np.bincount(group)[group] > 1
    place, group = place[many], group[many]
    return place, np.cumsum(np.r_[0, group[1:] != group[:-1]]) if len(group) else group


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int, keys: np.ndarray) -> np.ndarray:
    """The positions that are ``wanted``, in the order of their suffixes; those alike in ``depth`` bytes are neighbours.

    Directly sorted are only suffixes smaller than their successors, and of these only the wanted ones and those from which wanted
    ones follow. Every other suffix is placed by a scan over the buckets of first bytes: its successor comes earlier in the order,
    and the scan hands each entry's predecessor to the end of that predecessor's bucket.
    """
    n = len(text)
    rises, here = rising(text), np.arange(n)
    rise_at = np.append(np.flatnonzero(rises), n)
    until = rise_at[np.searchsorted(rise_at, here)]
    last_wanted = np.maximum.accumulate(np.where(wanted, here, -1))
    needed = (last_wanted >= 0) & (until[last_wanted] >= here)
    falls = needed & ~rises
    direct = _direct(keys, np.flatnonzero(needed & rises), depth)
    edges = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and falls[n - 1]:
        waiting[text[n - 1]].append(np.array([n - 1]))
    out = []

    def before(entries: np.ndarray) -> np.ndarray:
        previous = entries[entries > 0] - 1
        return previous[falls[previous]]

    for byte in range(256):
        level = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        found = []
        # Predecessors with the same first byte follow in the same bucket, level by level.
        while len(level):
            found.append(level)
            previous = before(level)
            level = previous[text[previous] == byte]
        found.append(direct[edges[byte] : edges[byte + 1]])
        entries = np.concatenate(found)
        out.append(entries)
        previous = before(entries)
        first = text[previous]
        previous, first = previous[first > byte], first[first > byte]
        order = np.argsort(first, kind="stable")
        previous, first = previous[order], first[order]
        cut = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]) if len(first) else []
        for lo, hi in zip(cut, [*cut[1:], len(first)]):
            waiting[first[lo]].append(previous[lo:hi])
        waiting[byte] = []
    entries = np.concatenate(out)
    return entries[wanted[entries]]


def common_prefixes(order: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """Bytes, at most ``depth``, that each entry of the order has in common with the one before it (the first: none)."""
    out = np.zeros(len(order), np.int64)
    alike = np.arange(1, len(order))
    for d in range(0, depth, 8):
        differing = keys[order[alike] + d] ^ keys[order[alike - 1] + d]
        left = np.zeros(len(alike), np.int64)
        for byte in range(1, 8):
            left += differing >> np.uint64(64 - 8 * byte) == 0
        same = differing == 0
        out[alike] = np.minimum(d + np.where(same, 8, left), depth)
        alike = alike[same]
    return out
