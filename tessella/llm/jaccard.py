"""N-gram Jaccard join by PartEnum signatures.

Two documents link when the Jaccard similarity of their sets of word shingles
is at least ``num / 100``. Linked sets of sizes a <= b differ in at most
(a + b)(100 - num) / (100 + num) shingles, so (PartEnum):

* sizes are cut into bands, and each band has an *instance* for pairs whose
  smaller set lies in it, with the largest difference K that such a pair has;
* an instance partitions the shingle domain into n1 parts (each again into n2
  cells). At least n1 - K // (k2 + 1) parts differ in at most k2 shingles, and
  then some n2 - k2 of their cells are equal. A *signature* is the projection
  of the set on such a subset of cells: linked sets share one.

A projection that is empty, or holds only shingles that are frequent in the
corpus (by counts over all documents), says little and would gather unrelated
documents. A set with fewer such parts than the guaranteed number of equal
parts need not emit these projections: one of its equal parts is informative.
Other sets ('hard' ones) are covered among themselves by the rarest shingles
of their prefix of size - ceil(num/100 * size) + 1, of which linked sets share
one. So no link is lost, and no signature is dropped for being common.

Linked sets do not share one signature only, but at least as many as there are
parts sure to be equal, less those not emitted. That number (``need``) goes
with every set, so pairs that meet by chance in a few signatures fall out
before anything is compared; this loses no link.

Shuffle and skew: equal sets are one node (copies are never compared), named
by 64 bits of their fingerprint that are made unique over the table. Each task
sorts its signatures and sends compressed runs per range of signatures, where
pairs of small buckets (up to ``SMALL`` members) are counted. Members of large
buckets are never expanded into pairs: they go on as rows and meet ``HUBS``
hubs of their bucket. Of the pairs that sizes and sketches let through, every
node first tests its least neighbour only; what lies in one component then
needs no more tests, and the other pairs are tested once. Large buckets whose
members still lie in several components are compared across these; members of
a bucket's most frequent component meet those of others only, so a bucket of
copies of one text and few others costs what the others do. A signature very
frequent within a task's chunk is sent once, its members as rows dealt out by
member, so no range gathers a hot one. Verification is exact, on the whole
sets, after the size bound and a parity sketch of 1,024 bits, whose distance
never exceeds the true one.

Defined results: null texts, empty texts and texts without words have the
empty set, link with nothing and are components of their own; with fewer than
``k`` words the whole sequence is one shingle; equal texts share a component;
repeated rows give a row each; a null key is carried along, and does not count
as the smallest. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tessella.llm.base import drop, free, map_batches, sized, small_batches, written
from tessella.llm.components import components, composed, roots
from tessella.llm.shingles import Shingler, fingerprint, mix

#: Counters of the shingle histogram (2**COUNTER_BITS), sent in slices; each task's counts stop at 255.
COUNTER_BITS, SLICES = 24, 16
COUNTERS = 1 << COUNTER_BITS
#: Band limits grow by this factor.
BAND = 1.5
#: Signatures of a task's chunk, and about as many a range.
CHUNK_ROWS, RANGE_ROWS = 1_500_000, 1_500_000
#: Ranges besides, so that small inputs are spread too.
LEAST_RANGES = 16
SKETCH_WORDS = 16
SKETCH = tuple(f"s{i}_" for i in range(SKETCH_WORDS))
#: Members of a large bucket that all its members are compared with.
HUBS = 2
#: Buckets of a member that go with each of its rows where large buckets are compared: all of them would grow with their square.
FIRST = 16
#: The bitmap of wanted keys has so many bits a key, and 2**27 at most; it only spares work.
KEY_BITS, MOST_BITS = 16, 27
#: Members of a bucket whose pairs are counted at once; members within a chunk from which a signature counts as hot.
SMALL, HOT = 48, 64
#: Parts beyond the largest difference, as a share of it: they make shared signatures many, and informative.
SLACK = 0.4


@cache
def bands(upto: int) -> list[int]:
    """Lower limits of the size bands, past ``upto``."""
    out = [1]
    while out[-1] <= upto:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * BAND)))
    return out


class Instance:
    """Parameters of one band: sizes served, parts, cells and subsets."""

    def __init__(self, index: int, low: int, high: int, num: int):
        """low..high: sizes of the smaller set of a pair."""
        self.index = index
        self.top = high * 100 // num
        self.k = (high + self.top) * (100 - num) // (100 + num)
        if self.k == 0:
            self.n1, self.n2, self.k2 = 1, 1, 0
        elif self.k <= 3:
            self.n1, self.n2, self.k2 = 1, {1: 3, 2: 5, 3: 6}[self.k], self.k
        elif self.k < 12:
            self.n1, self.n2, self.k2 = self.k // 2 + 2, 3, 1
        else:
            self.n1, self.n2, self.k2 = self.k + 1 + math.ceil(SLACK * self.k), 1, 0
        self.equal = self.n1 - self.k // (self.k2 + 1)
        self.subsets = np.array(list(combinations(range(self.n2), self.n2 - self.k2)))
        tags = np.arange(self.n1 * len(self.subsets), dtype=np.uint64) + np.uint64(1)
        self.tags = mix(tags, index * 2 + 1).reshape(self.n1, len(self.subsets))


@cache
def instance(index: int, num: int) -> Instance:
    limits = bands(1 << 10)
    while len(limits) < index + 2:
        limits = bands(limits[-1] * 4)
    return Instance(index, limits[index], limits[index + 1] - 1, num)


def instances(size: int, num: int) -> list[Instance]:
    """The instances that a set of this size takes part in."""
    limits = bands(max(1 << 10, size * 2))
    own = int(np.searchsorted(limits, size, side="right")) - 1
    out = []
    for i in range(own, -1, -1):
        one = instance(i, num)
        if one.top < size:
            break
        out.append(one)
    return out


def counter(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def signatures(s: np.ndarray, counts: np.ndarray, limit: int, num: int) -> tuple[np.ndarray, int]:
    """The signatures of a non-empty set (sorted distinct hashes), and how many of them a linked set shares at least.

    counts: corpus counts by counter, of which those over ``limit`` are frequent.
    A third of the signatures that are sure to be shared may be left out, and
    those are the ones whose rarest shingle is the commonest: two linked sets
    that leave out (need - 1) // 3 each still share (need + 2) // 3.
    """
    seen = counts[counter(s)]
    common = seen > limit
    spread = mix(s, 3) >> np.uint64(32)
    out, grade, need = [], [], 1 << 15
    for one in instances(len(s), num):
        total = one.n1 * one.n2
        cell = (spread * np.uint64(total) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(total, np.uint64)
        np.add.at(sums, cell, mix(s, 5))
        rarest = np.full(total, 256, np.int64)
        np.minimum.at(rarest, cell, seen.astype(np.int64))
        rare = rarest <= limit
        if one.n2 == 1:
            values, informative = mix(mix(sums, 7) + one.tags[:, 0], 9), rare
            dull = total - int(rare.sum())
            grade.append(rarest[informative])
        else:
            sums, rare = sums.reshape(one.n1, one.n2), rare.reshape(one.n1, one.n2)
            informative = rare[:, one.subsets].any(2)
            weight = mix(np.arange(one.n2, dtype=np.uint64), 7) | np.uint64(1)
            values = mix((sums[:, one.subsets] * weight[one.subsets]).sum(2, dtype=np.uint64) + one.tags, 9)
            dull = int((~informative).any(1).sum())
            grade.append(rarest.reshape(one.n1, one.n2)[:, one.subsets].min(2)[informative])
        out.append(values[informative])
        need = min(need, one.equal - dull)
    if need < 1:
        out.append(mix(s[np.lexsort((s, seen))][: len(s) - -(-num * len(s) // 100) + 1], 11))
        return np.unique(np.concatenate(out)), 1
    leave = (need - 1) // 3
    for i, one in enumerate(out):  # each instance by itself, as a pair may have only one in common
        if leave and len(one) > leave:
            out[i] = one[np.lexsort((one, grade[i]))[: len(one) - leave]]
    return np.unique(np.concatenate(out)), (need + 2) // 3


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the counts in 1,024 cells."""
    odd = np.bincount((mix(s, 13) >> np.uint64(54)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def step(shingles: int) -> int:
    """Counts are kept in these steps, so that three times the mean stays well below 255 at any size."""
    return max(1, shingles // COUNTERS // 32)


def unpacked(counts: dict[int, bytes]) -> np.ndarray:
    """The corpus counts by counter; a slice that no task sent has none."""
    none = bytes(COUNTERS // SLICES)
    return np.frombuffer(b"".join(zlib.decompress(counts[i]) if i in counts else none for i in range(SLICES)), np.uint8)


def words(ids: list[bytes]) -> np.ndarray:
    """Fingerprints of 16 bytes as rows of two 64-bit words."""
    return np.frombuffer(b"".join(ids), "<i8").reshape(-1, 2)


def profiles(docs: DataFrame, key: str, text: str, k: int) -> tuple[DataFrame, dict[int, bytes], int, frozenset[int]]:
    """One pass over the texts: the written table (key, n, nid) of all rows, the corpus counts in ``step``s up to 255 (compressed, by slice), the number of shingles, and the clashing words.

    nid names the set: the first word of its fingerprint, or the second where
    several sets have the first in common (about n * n / 2**65 of n sets).
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts = Shingler(k), np.zeros(COUNTERS, np.int32)
        schema = None
        for batch in batches:
            schema = schema or pa.schema([(key, batch.schema.field(key).type), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("slice", pa.int32()), ("part", pa.binary())])
            n, ids = [], []
            for value in batch.column(text).to_pylist():
                s = shingler.of(value)
                np.add.at(counts, counter(s), 1)
                n.append(len(s))
                ids.append(fingerprint(s) if len(s) else bytes(16))
            empty = np.array(n) == 0
            both = words(ids)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(n, pa.int64()), pa.array(both[:, 0], mask=empty), pa.array(both[:, 1], mask=empty), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], schema=schema)
        if counts.any():
            parts = [zlib.compress(x.tobytes(), 1) for x in np.split(np.minimum(counts, 255).astype(np.uint8), SLICES)]
            longs = pa.nulls(SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, schema.field(0).type), longs, longs, longs, pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    def total(part: pa.Table) -> pa.Table:
        sums = np.zeros(COUNTERS // SLICES, np.int64)
        for x in part.column("part").to_pylist():
            sums += np.frombuffer(zlib.decompress(x), np.uint8)
        graded = np.minimum(sums // step(shingles), 255).astype(np.uint8)
        return pa.table({"slice": pa.array([part.column("slice")[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(graded.tobytes(), 1)], pa.binary())})

    longs = [StructField(x, LongType()) for x in ("n", "hi", "lo")]
    both = written(docs.select(key, text).mapInArrow(run, StructType([kind, *longs, *StructType.fromDDL("slice int, part binary").fields])), "profiles")
    rows = both.where("slice is null")
    shingles = int(rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    counts = {r.slice: bytes(r.counts) for r in both.where("slice is not null").select("slice", "part").groupBy("slice").applyInArrow(total, "slice int, counts binary").collect()}
    named = rows.where("n > 0")
    clashes = frozenset(r.hi for r in named.groupBy("hi").agg(F.min("lo").alias("a"), F.max("lo").alias("b")).where("a <> b").select("hi").collect())
    nid = F.when(F.col("hi").isin(sorted(clashes)), F.col("lo")).otherwise(F.col("hi")) if clashes else F.col("hi")
    if clashes and not named.groupBy(nid.alias("nid")).agg(F.min("hi").alias("a"), F.max("hi").alias("b"), F.min("lo").alias("c"), F.max("lo").alias("d")).where("a <> b or c <> d").isEmpty():
        raise RuntimeError("different sets with equal names")
    return rows.select(key, "n", nid.alias("nid")), counts, shingles, clashes


def name(print16: bytes, clashes: frozenset[int]) -> int:
    """The nid of the set with this fingerprint."""
    hi, lo = words([print16])[0].tolist()
    return lo if hi in clashes else hi


def _pack(sig: np.ndarray, who: np.ndarray, nids: np.ndarray, needs: np.ndarray) -> bytes:
    """Signatures (ascending) as differences, and members as indexes into the nids present, which come with their needs."""
    used, index = np.unique(who, return_inverse=True)
    body = np.diff(sig, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes() + index.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(sig).to_bytes(8, "little") + len(used).to_bytes(8, "little") + nids[used].astype("<i8").tobytes() + needs[used].tobytes() + zlib.compress(body, 1)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, index of the member, nids, needs)."""
    n, m = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    nids = np.frombuffer(blob, "<i8", m, 16)
    needs = np.frombuffer(blob, np.uint8, m, 16 + 8 * m)
    body = np.frombuffer(zlib.decompress(blob[16 + 9 * m :]), np.uint8)
    steps = np.ascontiguousarray(body[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    index = np.ascontiguousarray(body[8 * n : 12 * n].reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint64), index.astype(np.int64), nids, needs


_SENT = pa.schema([("range", pa.int32()), ("blob", pa.binary()), ("bid", pa.int64()), ("nid", pa.int64())])
_MET = pa.schema([("bid", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64()), ("need", pa.int64())])


def buckets(docs: DataFrame, text: str, k: int, num: int, counts: dict[int, bytes], shingles: int, clashes: frozenset[int]) -> DataFrame:
    """The written table of what met: counted pairs (a, b, shared, need) of small buckets, and members (bid, a) of large ones. A second pass over the texts."""
    ranges = LEAST_RANGES + int(0.8 * shingles // RANGE_ROWS)
    shipped, limit = docs.sparkSession.sparkContext.broadcast(counts), max(20, 3 * shingles // COUNTERS) // step(shingles)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, known = Shingler(k), unpacked(shipped.value)
        held: dict[int, tuple[np.ndarray, int]] = {}
        rows = 0

        def out() -> Iterator[pa.RecordBatch]:
            nids, needs = np.array(list(held), np.int64), np.array([min(need, 255) for _, need in held.values()], np.uint8)  # a smaller need lets more through
            sig = np.concatenate([own for own, _ in held.values()])
            who = np.repeat(np.arange(len(nids)), [len(own) for own, _ in held.values()])
            order = np.argsort(sig, kind="stable")
            sig, who = sig[order], who[order]
            at = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            size = np.diff(np.append(at, len(sig)))
            # A hot signature stays in the run HOT times, which marks it; its other members go by themselves.
            extra = np.arange(len(sig)) - np.repeat(at, size) >= HOT
            stay = np.flatnonzero(~extra)
            place = (sig[stay] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
            r, starts = np.unique(place, return_index=True)
            for i, mine in zip(r.tolist(), np.split(stay, starts[1:]), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([_pack(sig[mine], who[mine], nids, needs)], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], schema=_SENT)
            if extra.any():
                more = np.flatnonzero(extra)
                for mine in np.array_split(more, -(-len(more) // 100_000)):
                    who_else = nids[who[mine]]
                    yield pa.RecordBatch.from_arrays([pa.array((who_else % ranges).astype(np.int32)), pa.nulls(len(mine), pa.binary()), pa.array(sig[mine].view(np.int64)), pa.array(who_else)], schema=_SENT)

        for batch in batches:
            for value in batch.column(text).to_pylist():
                s = shingler.of(value)
                if not len(s) or (nid := name(fingerprint(s), clashes)) in held:
                    continue
                held[nid] = own, _ = signatures(s, known, limit, num)
                rows += len(own)
                if rows >= CHUNK_ROWS:
                    yield from out()
                    held.clear()
                    rows = 0
        if rows:
            yield from out()

    def meet(part: pa.Table) -> pa.Table:
        loose = part.filter(part.column("bid").is_valid())
        n = len(loose)
        longs = lambda n: pa.nulls(n, pa.int64())
        tables = [pa.table([loose.column("bid").combine_chunks(), loose.column("nid").combine_chunks(), longs(n), longs(n), longs(n)], schema=_MET)] if n else []
        blobs = [x for x in part.column("blob").to_pylist() if x is not None]
        if blobs:
            sig, who, nids, needs, at = [], [], [], [], 0
            for x in map(_unpack, blobs):
                sig.append(x[0])
                who.append(x[1] + at)
                nids.append(x[2])
                needs.append(x[3])
                at += len(x[2])
            sig, who, nids, needs = (np.concatenate(x) for x in (sig, who, nids, needs))
            del blobs
            nids, first, code = np.unique(nids, return_index=True, return_inverse=True)  # ascending
            who, needs = code[who], needs[first].astype(np.int64)
            order = np.lexsort((who, sig))
            sig, who = sig[order], who[order]
            # Runs that are HOT long within a chunk have members elsewhere too; they are longer than SMALL.
            fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (who[1:] != who[:-1])])
            sig, who = sig[fresh], who[fresh]
            at = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            size = np.diff(np.append(at, len(sig)))
            keys = []
            for m in np.unique(size[(size > 1) & (size <= SMALL)]):
                starts, (i, j) = at[size == m], np.triu_indices(m, 1)
                for some in np.array_split(starts, -(-len(starts) * len(i) // 4_000_000)):
                    keys.append((who[some[:, None] + i] * len(nids) + who[some[:, None] + j]).ravel())
            if keys:
                key, shared = np.unique(np.concatenate(keys), return_counts=True)
                a, b = key // len(nids), key % len(nids)
                tables.append(pa.table([longs(len(a)), pa.array(nids[a]), pa.array(nids[b]), pa.array(shared.astype(np.int64)), pa.array(np.maximum(needs[a], needs[b]))], schema=_MET))
            large = np.flatnonzero(np.repeat(size > SMALL, size))
            if n := len(large):
                tables.append(pa.table([pa.array(sig[large].view(np.int64)), pa.array(nids[who[large]]), longs(n), longs(n), longs(n)], schema=_MET))
        return pa.concat_tables(tables) if tables else _MET.empty_table()

    sent = docs.select(text).mapInArrow(emit, "range int, blob binary, bid long, nid long")
    met = written(sent.groupBy("range").applyInArrow(meet, "bid long, a long, b long, shared long, need long"), "met")
    shipped.destroy()
    return met


def candidates(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs a < b that share enough signatures or have a hub; members bid, nid of large buckets), both written."""
    large = written(met.where("bid is not null").select("bid", F.col("a").alias("nid")).distinct(), "large")
    pairs = met.where("b is not null").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("need").alias("need"))
    if not (members := large.count()):
        return written(pairs.where("shared >= need").select("a", "b"), "pairs"), large
    # What two sets may share in large buckets isn't counted; it counts as shared in full.
    inside = large.groupBy("nid").agg(F.count("*").alias("c"))
    ca, cb = (sized(inside.select(F.col("nid").alias(x), F.col("c").alias("c" + x)), members) for x in "ab")
    both = pairs.join(ca, "a", "left").join(cb, "b", "left")
    enough = both.where(F.col("shared") + F.when(F.col("ca").isNull() | F.col("cb").isNull(), 0).otherwise(F.least("ca", "cb")) >= F.col("need")).select("a", "b")
    hubs = large.groupBy("bid").agg(*[F.min_by("nid", F.xxhash64("nid", F.lit(r))).alias(f"hub{r}") for r in range(HUBS)])
    led = sized(large, members).join(hubs, "bid").select("nid", F.explode(F.array(*[f"hub{r}" for r in range(HUBS)])).alias("hub")).where("nid <> hub")
    return written(enough.unionByName(led.select(F.least("nid", "hub").alias("a"), F.greatest("nid", "hub").alias("b"))).distinct(), "pairs"), large


def sets(docs: DataFrame, heads: DataFrame, wanted: DataFrame, key: str, text: str, k: int, clashes: frozenset[int]) -> DataFrame:
    """The written table (nid, n, sketch in columns, shingles) for the nids in ``wanted``. A third pass over the texts, but only their documents are cut into shingles.

    heads: (nid, least key) of all sets. A bitmap of hashed keys, as large as
    the wanted ones ask for up to a bound, says which documents may be wanted;
    what it lets through besides is dropped by the join.
    """
    asked = written(wanted.join(heads.hint("merge"), "nid").select("nid", F.xxhash64("least").alias("h")), "asked")
    keys = asked.count()
    bits = min(MOST_BITS, max(15, (KEY_BITS * keys).bit_length()))
    slot = lambda h: F.pmod(h, F.lit(1 << bits))
    counted = slot(F.col("h")) + 1  # bucket 1 of the bitmap functions begins at value 1
    maps = asked.groupBy(F.bitmap_bucket_number(counted).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(counted)).alias("m")).collect()
    seen = np.zeros((1 << bits) // 8, np.uint8)
    for r in maps:
        seen[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(bytes(r.m), np.uint8)
    shipped, names = docs.sparkSession.sparkContext.broadcast(seen), ["nid", "n", *SKETCH, "shingles"]

    def make():
        shingler, seen, given = Shingler(k), shipped.value, set()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            places = batch.column("slot").to_numpy()
            fits = seen[places // 8] >> (places % 8) & 1
            nids, n, odd, own = [], [], [], []
            texts = batch.column(text)
            for i in np.flatnonzero(fits):
                s = shingler.of(texts[int(i)].as_py())
                if len(s) and (f := name(fingerprint(s), clashes)) not in given:
                    if len(given) < 200_000:
                        given.add(f)
                    nids.append(f)
                    n.append(len(s))
                    odd.append(sketch(s))
                    own.append(s.view(np.int64))
            longs = pa.list_(pa.int64())
            odd = np.array(odd, np.int64).reshape(-1, SKETCH_WORDS)
            return pa.RecordBatch.from_arrays([pa.array(nids, pa.int64()), pa.array(n, pa.int64()), *map(pa.array, odd.T), pa.array(own, longs)], names)

        return step

    schema = StructType([*[StructField(x, LongType()) for x in names[:-1]], StructField("shingles", ArrayType(LongType()))])
    made = map_batches(docs.select(text, slot(F.xxhash64(key)).alias("slot")), make, schema)
    out = written(made.join(sized(asked.select("nid"), keys), "nid", "left_semi").groupBy("nid").agg(*[F.first(x).alias(x) for x in names[1:]]), "sets")
    shipped.destroy()
    drop(asked)
    return out


def near(num: int) -> Column:
    """What every linked pair meets, from sizes and sketches alone (columns of ``_sides``)."""
    na, nb = F.col("na"), F.col("nb")
    apart = sum((F.bit_count(F.col(f"{x}a").bitwiseXOR(F.col(f"{x}b"))) for x in SKETCH), F.lit(0))
    return (num * F.greatest(na, nb) <= 100 * F.least(na, nb)) & ((100 + num) * apart <= (100 - num) * (na + nb))


def _sides(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sizes and sketches, named for the one and the other end of a pair."""
    return tuple(known.select(F.col("nid").alias(x), *[F.col(y).alias(y + x) for y in ("n", *SKETCH)]) for x in "ab")


def verified(pairs: DataFrame, known: DataFrame, num: int) -> DataFrame:
    """The linked ones of the distinct pairs (a, b, ...), decided on the whole sets."""
    whole = known.select("nid", "shingles")
    both = pairs.join(whole.withColumnsRenamed({"nid": "a", "shingles": "sa"}), "a").join(whole.withColumnsRenamed({"nid": "b", "shingles": "sb"}), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= num * (F.size("sa") + F.size("sb") - common)).select(*pairs.columns)


def leftovers(large: DataFrame, labels: DataFrame, known: DataFrame, num: int) -> DataFrame | None:
    """The near pairs (a, b) of different components that meet in large buckets, once each; None if every large bucket lies in one component."""
    marked = large.join(sized(labels.select(F.col("node").alias("nid"), "label")), "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    counted = marked.groupBy("bid", "label").agg(F.count("*").alias("c")).groupBy("bid").agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.count("*").alias("c"))
    active = written(marked.join(counted.where("c > 1").select("bid", "most"), "bid"), "active")
    if active.isEmpty():
        drop(active)
        return None
    # The least common bucket is among the first of both if these have any in common; other pairs may come several times.
    first = active.groupBy("nid").agg(F.slice(F.array_sort(F.collect_set("bid")), 1, FIRST).alias("bids"))
    listed = active.join(first.hint("merge"), "nid")
    one, other = (x.hint("merge") for x in _sides(known))
    left = listed.where("label <> most").select(F.col("bid").alias("xa"), F.col("nid").alias("a"), F.col("label").alias("la"), F.col("bids").alias("ba")).join(one, "a")
    right = listed.select(F.col("bid").alias("xb"), F.col("nid").alias("b"), F.col("label").alias("lb"), F.col("bids").alias("bb"), (F.col("label") == F.col("most")).alias("usual")).join(other, "b")
    once = (F.col("usual") | (F.col("a") < F.col("b"))) & (F.coalesce(F.array_min(F.array_intersect("ba", "bb")), "xa") == F.col("xa"))
    met = left.join(right.hint("merge"), (F.col("xa") == F.col("xb")) & (F.col("la") != F.col("lb")) & near(num) & once)
    out = written(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    drop(active)
    return out


def links(pairs: DataFrame, large: DataFrame, known: DataFrame, num: int) -> DataFrame:
    """The components (node, label < node) of all links: of the candidate pairs, and within large buckets."""
    one, other = _sides(known)
    close = written(sized(pairs).join(one, "a").join(other, "b").where(near(num)).select("a", "b"), "close")
    # A node's link to its least neighbour makes it a child of that neighbour.
    labels = roots(verified(sized(close.groupBy("b").agg(F.min("a").alias("a")), close.count()), known, num).select(F.col("b").alias("node"), F.col("a").alias("label")))
    labels = _merged(labels, close, known, num)
    if (rest := leftovers(large, labels, known, num)) is not None:
        labels = _merged(labels, rest, known, num)
        drop(rest)
    drop(close)
    return labels


def _merged(labels: DataFrame, pairs: DataFrame, known: DataFrame, num: int) -> DataFrame:
    """``labels`` after the pairs between different components are tested, and those of links become one. Deletes ``labels``."""
    nodes = labels.count()
    la, lb = (sized(labels.select(F.col("node").alias(x), F.col("label").alias("l" + x)), nodes) for x in "ab")
    apart = pairs.join(la, "a", "left").join(lb, "b", "left").withColumns({"la": F.coalesce("la", "a"), "lb": F.coalesce("lb", "b")}).where("la <> lb")
    fresh = written(verified(apart, known, num).select("la", "lb"), "links")
    over = components(fresh, "la", "lb")
    out = written(composed(labels, over), "labels")
    drop(labels, fresh, over)
    return out


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 75) -> DataFrame:
    """(key, n_shingles, component_id): the smallest key reachable by links, for every row."""
    return _classes(docs, key, text, k, num)[0].drop("nid")


def _classes(docs: DataFrame, key: str, text: str, k: int, num: int) -> tuple[DataFrame, frozenset[int]]:
    """``classes`` with the name of the set (nid), null where it is empty; and the clashing words."""
    docs = docs.select(key, text)
    profile, counts, shingles, clashes = profiles(docs, key, text, k)
    met = buckets(docs, text, k, num, counts, shingles, clashes)
    pairs, large = candidates(met)
    drop(met)
    heads = written(profile.where("nid is not null").groupBy("nid").agg(F.min(key).alias("least")), "heads")
    wanted = pairs.select(F.col("a").alias("nid")).unionByName(pairs.select(F.col("b").alias("nid"))).unionByName(large.select("nid")).distinct()
    known = sets(docs, heads, wanted, key, text, k, clashes)
    labels = links(pairs, large, known, num)
    drop(pairs, large, known)
    members = labels.select(F.col("node").alias("nid"), "label").unionByName(labels.select(F.col("label").alias("nid"), "label").distinct()).join(heads.hint("merge"), "nid")
    whole = members.groupBy("label").agg(F.min("least").alias("component_id"))
    named = heads.join(members.join(whole, "label").select("nid", "component_id"), "nid", "left").select("nid", F.coalesce("component_id", "least").alias("component_id"))
    return profile.join(named, "nid", "left").select(key, F.col("n").alias("n_shingles"), F.coalesce("component_id", key).alias("component_id"), "nid"), clashes


def _with_names(docs: DataFrame, text: str, k: int, clashes: frozenset[int], out: str) -> DataFrame:
    """``docs`` with column ``out``, the name of a row's set, null where it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch in batches:
            own = [shingler.of(x) for x in batch.column(text).to_pylist()]
            nids = [name(fingerprint(s), clashes) if len(s) else None for s in own]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nids, pa.int64())], [*batch.schema.names, out])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, LongType())]))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 75) -> DataFrame:
    """One row of every component, that of the smallest key, with all columns. Rows with a null key stay as they are.

    Rows that share key and text count once; texts are moved once, by key. Where
    a key stands on texts of several components, rows go by key and set.
    """
    names = [f"`{x}`" for x in docs.columns]
    found, clashes = _classes(docs, key, text, k, num)
    done = written(found, "classes")
    away = done.where(F.col(key) != F.col("component_id"))
    gone = away.select(key).distinct()
    left = docs.join(gone, key, "left_anti").select(*names)
    if done.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty():
        return left
    mixed = gone.join(done.where(F.col(key) == F.col("component_id")), key, "left_semi")
    if not mixed.isEmpty():
        own = free(docs, "__nid")
        told = _with_names(docs.join(mixed, key, "left_semi").select(*names), text, k, clashes, own)
        left = left.unionByName(told.join(away.select(key, F.col("nid").alias(own)).distinct(), [key, own], "left_anti").select(*names))
    digest = free(docs, "__h")
    named = left.where(F.col(key).isNotNull()).withColumn(digest, F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).dropDuplicates([key, digest]).drop(digest)
    return named.unionByName(left.where(F.col(key).isNull()))
