"""Hierarchical multi-length packing of token streams.

Every document (its ids, then the end id) is routed by length to the smallest
of several context-size tiers that holds it; whole windows of the largest tier
are cut off first. Each tier is packed into full windows: the gap behind a
long document is filled best-fit from the shorter tiers, and only when nothing
fits whole is one document cut, its rest being routed anew. Windows of a tier
are handed out to step groups of equal token counts, so optimiser steps are
balanced whatever the mix of tiers.

Packing is local to a task: no shuffle, a bounded pool of waiting documents,
and the same rows again if a lost task is repeated. Sequence ids carry the
task's partition number in their upper bits. What is left at a task's end goes
into the largest windows, then into windows that are powers of two, and at
most one window a task is padded.

Defined results: null or empty texts are one token (the end id); repeated rows
are packed separately; null keys stay null; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessella.llm.base import small_batches, strings
from tessella.llm.bpe import WordEncoder, WordTable

TIERS = (512, 1024, 2048, 4096)
#: Sequences that a tier's pool waits for before it is packed.
POOL_WINDOWS = 24


class Packer:
    """Packs (key, ids) streams; rows come out as (key, start, ids, doc_tokens, sequence, offset, tier, step_group)."""

    def __init__(self, tiers: Sequence[int] = TIERS, first_id: int = 0, step_tokens: int = 1 << 16):
        self.tiers = sorted(tiers)
        self.top = self.tiers[-1]
        self.pools: list[list] = [[] for _ in self.tiers]
        self.waiting = [0] * len(self.tiers)
        self.next_id, self.first_id, self.serial = first_id, first_id, 0
        self.step_tokens = step_tokens
        self.groups = {t: [0, 0] for t in self.tiers}  # tokens so far, group number
        self.next_group = first_id
        self.rows: list[tuple] = []

    def add(self, key, ids: bytes, start: int = 0, total: int | None = None) -> None:
        total = len(ids) // 4 if total is None else total
        at = 0
        while len(ids) // 4 - at >= self.top:
            self._emit(self.top, [(key, start + at, ids[at * 4 : (at + self.top) * 4], total)])
            at += self.top
        if at * 4 < len(ids):
            self._pool(key, start + at, ids[at * 4 :], total)
        for i, tier in enumerate(self.tiers):
            if self.waiting[i] >= POOL_WINDOWS * tier:
                self._pack(i, POOL_WINDOWS // 2)

    def _tier(self, n: int) -> int:
        return next(i for i, t in enumerate(self.tiers) if n <= t)

    def _pool(self, key, start: int, ids: bytes, total: int) -> None:
        n = len(ids) // 4
        i = self._tier(n)
        self.serial += 1
        insort(self.pools[i], (n, self.serial, key, start, ids, total), key=lambda x: x[:2])
        self.waiting[i] += n

    def _take(self, i: int, at: int) -> tuple:
        piece = self.pools[i].pop(at)
        self.waiting[i] -= piece[0]
        return piece

    def _fill(self, tier: int, gap: int, pieces: list) -> int:
        """Fill a window's gap from this tier and the shorter ones; returns what stays open."""
        while gap:
            for i in range(tier, -1, -1):
                if at := bisect_right(self.pools[i], gap, key=lambda x: x[0]):
                    n, _, *rest = self._take(i, at - 1)
                    pieces.append(tuple(rest))
                    gap -= n
                    break
            else:
                i = next((i for i in range(tier + 1) if self.pools[i]), None)
                if i is None:
                    return gap
                _, _, key, start, ids, total = self._take(i, 0)
                pieces.append((key, start, ids[: gap * 4], total))
                self._pool(key, start + gap, ids[gap * 4 :], total)
                gap = 0
        return 0

    def _pack(self, i: int, windows: int) -> None:
        for _ in range(windows):
            if sum(self.waiting[: i + 1]) < self.tiers[i] or not self.pools[i]:
                return
            n, _, *rest = self._take(i, -1)
            pieces = [tuple(rest)]
            self._fill(i, self.tiers[i] - n, pieces)
            self._emit(self.tiers[i], pieces)

    def _emit(self, window: int, pieces: list[tuple]) -> None:
        # Windows below the smallest tier only come from a task's end and share that tier's groups.
        state = self.groups[window if window in self.groups else self.tiers[0]]
        if state[0] == 0:
            state[1], self.next_group = self.next_group, self.next_group + 1
        offset = 0
        for key, start, ids, total in pieces:
            self.rows.append((key, start, ids, total, self.next_id, offset, window, state[1]))
            offset += len(ids) // 4
        self.next_id += 1
        state[0] = 0 if state[0] + window >= self.step_tokens else state[0] + window

    def finish(self) -> None:
        last = len(self.tiers) - 1
        while left := sum(self.waiting):
            window = self.top if left >= self.top else next((t for t in reversed(self.tiers) if t <= left), None)
            pieces: list[tuple] = []
            self._fill(last, min(window or left, left), pieces)
            self._emit(window or self.top, pieces)


def pack(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = 2, tiers: Sequence[int] = TIERS, step_tokens: int = 1 << 16, task_words: int = 400_000
) -> DataFrame:
    """One row per piece: its ids, where it starts in its document, and its place in a sequence."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    names = [key, "start", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(WordEncoder(path), task_words)
        packer = Packer(tiers, TaskContext.get().partitionId() << 36, step_tokens)

        def out(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            rows, packer.rows = packer.rows, []
            for i in range(0, len(rows), 2000):
                columns = list(zip(*rows[i : i + 2000], strict=True))
                types = [kind, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(key).type
            for k, value in zip(batch.column(key).to_pylist(), strings(batch, text), strict=True):
                packer.add(k, table.encode(value) + end)
            if len(packer.rows) >= 2000:
                yield from out(kind)
        packer.finish()
        yield from out(kind)

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, start long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long")
