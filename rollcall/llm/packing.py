"""Hierarchical multi-length packing of tokenised documents.

Each document (its ids and an end id) is cut into full windows of the longest tier; the rest goes to the
smallest tier that holds it. Each tier packs its pieces, longest first, into the fullest window with room.
Gaps of long windows are then filled from shorter tiers, the last ids of a gap by cutting a shorter piece.
What still leaves a gap waits for the next pool; at a task's end it is cut into windows of powers of two, so
nothing is padded. Step groups hold windows of one tier, and step_ids ids each; what windows a task has left at its
end fill groups together, the longest first, so that only its last group may hold less.

A task packs the documents of its own partition in pools of POOL_IDS ids: no shuffle, bounded memory, and
the same result when a lost task runs again. sequence_id is the partition's number times 2^32 plus a count.

Edge cases: a null or empty text is the end id alone; repeated rows are packed each for itself; an empty
table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import encoded, loaded
from .common import map_rows, texts

TIERS = (512, 1024, 2048, 4096)
POOL_IDS = 2_000_000
STEP_IDS = 32_768
END_ID = 2
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, step_group long"

#: A piece: (document, first id, ids). A document: [doc_id, its ids as bytes].
Piece = tuple[list, int, int]


def tier_of(length: int, tiers=TIERS) -> int:
    return tiers[bisect.bisect_left(tiers, length)]


def pack(pieces: list[Piece], tiers=TIERS, last: bool = True) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Windows (length, pieces) that are full, and the pieces that wait (none if last)."""
    done: list[tuple[int, list[Piece]]] = []
    routed: dict[int, list[Piece]] = {t: [] for t in tiers}
    longest = tiers[-1]
    for doc, start, length in pieces:
        while length > longest:
            done.append((longest, [(doc, start, longest)]))
            start, length = start + longest, length - longest
        routed[tier_of(length, tiers)].append((doc, start, length))
    for own in routed.values():
        own.sort(key=lambda p: p[2])
    wait: list[Piece] = []
    for t in reversed(tiers):
        # Longest first, each into the window with the least room that holds it.
        windows: list[list[Piece]] = []
        room: list[tuple[int, int]] = []
        for p in reversed(routed[t]):
            k = bisect.bisect_left(room, (p[2], -1))
            if k < len(room):
                free, w = room.pop(k)
                windows[w].append(p)
            else:
                free, w = t, len(windows)
                windows.append([p])
            bisect.insort(room, (free - p[2], w))
        routed[t] = []
        shorter = [s for s in reversed(tiers) if s < t]
        for free, w in room:
            for s in shorter:
                own = routed[s]
                while free and own:
                    k = bisect.bisect_right(own, free, key=lambda p: p[2])
                    if k:  # the longest that fits
                        p = own.pop(k - 1)
                    else:  # cut the shortest
                        doc, start, length = own.pop(0)
                        p = (doc, start, free)
                        bisect.insort(own, (doc, start + free, length - free), key=lambda p: p[2])
                    windows[w].append(p)
                    free -= p[2]
                if not free:
                    break
            if free:
                wait += windows[w]
            else:
                done.append((t, windows[w]))
    if last:
        full, wait = _cut(wait, longest)
        done += full
    return done, wait


def _cut(pieces: list[Piece], longest: int) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Windows of powers of two, cut from pieces laid end to end."""
    left = sum(p[2] for p in pieces)
    done, queue = [], pieces[::-1]
    while left:
        size = min(longest, 1 << (left.bit_length() - 1))
        left -= size
        window, free = [], size
        while free:
            doc, start, length = queue.pop()
            took = min(free, length)
            window.append((doc, start, took))
            if took < length:
                queue.append((doc, start + took, length - took))
            free -= took
        done.append((size, window))
    return done, []


def packed(docs: DataFrame, vocabulary: str, tiers=TIERS, pool_ids: int = POOL_IDS, step_ids: int = STEP_IDS) -> DataFrame:
    """A row for each piece of each document; see the module's text."""

    def run(rows):
        base = TaskContext.get().partitionId() << 32
        made, groups = 0, 0
        end = np.array([END_ID], "<u4").tobytes()
        waiting: dict[int, list[list[Piece]]] = {}

        def group_of(windows):
            nonlocal made, groups
            for size, window in windows:
                at = 0
                for (doc_id, ids), start, length in window:
                    yield doc_id, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), len(ids) // 4, base + made, at, size, base + groups
                    at += length
                made += 1
            groups += 1

        def rows_of(windows):
            for size, window in windows:
                own = waiting.setdefault(size, [])
                own.append(window)
                if len(own) * size >= step_ids:
                    yield from group_of((size, w) for w in waiting.pop(size))

        def last_groups():
            held, ids = [], 0
            for size in sorted(waiting, reverse=True):
                for window in waiting[size]:
                    held.append((size, window))
                    ids += size
                    if ids >= step_ids:
                        yield from group_of(held)
                        held, ids = [], 0
            if held:
                yield from group_of(held)

        pool, size = [], 0
        for doc_id, ids in encoded(rows, loaded(vocabulary)):
            pool.append(([doc_id, ids + end], 0, len(ids) // 4 + 1))
            size += pool[-1][2]
            if size >= pool_ids:
                windows, pool = pack(pool, tiers, last=False)
                size = sum(p[2] for p in pool)
                yield from rows_of(windows)
                # Pieces that wait hold their documents; so many of them are laid end to end at once.
                if size >= pool_ids // 2:
                    windows, pool = _cut(pool, tiers[-1])
                    size = 0
                    yield from rows_of(windows)
        windows, _ = pack(pool, tiers)
        yield from rows_of(windows)
        yield from last_groups()

    return map_rows(texts(docs), run, SCHEMA)
