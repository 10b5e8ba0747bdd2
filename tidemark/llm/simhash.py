"""SimHash near-dedup with bit-sliced comparison.

Fingerprints are compared in blocks.  A block stores its fingerprints as *bit planes*: plane ``i``
packs bit ``i`` of 64 fingerprints into each machine word.  For a query the planes are XORed with
its bits and the mismatches of 64 fingerprints at a time are added by carry-save counters (one
word for each binary digit of the count); a block is abandoned as soon as every count has passed
the radius.

Blocks come from bands of fingerprint bits.  For a radius ``r`` given in full (op10), ``r + 1``
bands cover all bits, so two fingerprints within the radius agree on one band at least and no
link can be lost.  A group that is too large for one block is divided again in the same way by
the bits that are left, which are ever fewer: 64, 43, 29, 19, 13, so a block never holds more
than 2 to the 13 distinct fingerprints, however large the group.  Equal fingerprints are one node.

Near copies at a shingle similarity (the pipeline's stage) are found by ``near_copies``, which compares
256-bit fingerprints by the same means.

Defined results
---------------
* null or empty text, or white space only: fingerprint zero, linked like any other
* fewer words than a shingle: the whole word sequence is the one shingle
* null id: ranks after every other id, and is returned as null
* equal ids: rows of one id are one node for links; each row keeps its own fingerprint
* empty table: empty result
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import LAST_ID, ship, shuffle_width, staged
from tidemark.llm.components import components

SHINGLE = 3
RADIUS = 2
#: Distinct fingerprints that one block compares; larger groups are divided.
BLOCK = 2048
SEED = 42

_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_U64 = np.uint64
_FULL = ~_U64(0)


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every ``size``-word shingle, repeats included."""
    words = text.lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, _U64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), SEED)], _U64)
    grams = zip(*(words[i:] for i in range(size)), strict=False)
    return np.fromiter((digest(g, SEED) for g in map(b" ".join, grams)), _U64, len(words) - size + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have set, as a signed integer."""
    if not len(hashes):
        return 0
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS_OF_BYTE for k in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, fp)`` of every row; ``fp`` is an array of one long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [[majority(shingle_hashes(t, shingle))] for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(prints, pa.list_(pa.int64()))], ["id", "fp"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, fp array<long>")


# ---------------------------------------------------------------- bit-sliced comparison


def bit_planes(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of ``block`` (m rows of words) and, packed over rows, the planes that vary."""
    m = len(block)
    bits = np.unpackbits(np.ascontiguousarray(block).view(np.uint8).reshape(m, -1), axis=1, bitorder="little")
    varying = np.flatnonzero(bits.min(axis=0) != bits.max(axis=0))
    bits = bits[:, varying]
    padded = np.zeros((len(varying), -(-m // 64) * 64), np.uint8)
    padded[:, :m] = bits.T
    return bits, np.packbits(padded, axis=1, bitorder="little").view("<u8")


def _exceeds(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose binary count is above the radius, compared digit by digit from the top."""
    above, equal = np.zeros_like(count[0]), np.full_like(count[0], _FULL)
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            equal &= count[k]
        else:
            above |= equal & count[k]
            equal &= ~count[k]
    return above


def _compare(bits: np.ndarray, lanes_of: Callable[[np.ndarray, np.ndarray], np.ndarray], over: np.ndarray, planes: np.ndarray, radius: int) -> np.ndarray:
    """Packed lanes within the radius of each query.

    ``bits`` are the queries' varying bits, ``over`` the lanes that don't count from the start, and
    ``lanes_of(plane, queries)`` the words of a plane that queries are compared with.  Queries all
    of whose lanes have passed the radius are abandoned.
    """
    out = np.zeros_like(over)
    live = np.arange(len(bits))
    digits = (radius + 1).bit_length()
    count = [np.zeros_like(over) for _ in range(digits)]
    for i, plane in enumerate(planes):
        carry = lanes_of(plane, live) ^ np.where(bits[live, i], _FULL, _U64(0))[:, None]
        for digit in count:  # carry-save addition of one bit to 64 counts a word
            follow = digit & carry
            digit ^= carry
            carry = follow
        over |= carry
        if i >= radius and i % 16 == 15:
            over |= _exceeds(count, radius)
            alive = (over != _FULL).any(axis=1)
            if not alive.all():
                live, over = live[alive], over[alive]
                count = [digit[alive] for digit in count]
                if not len(live):
                    return out
    out[live] = ~(over | _exceeds(count, radius))
    return out


def within_radius(block: np.ndarray, radius: int, queries: int = 128) -> np.ndarray:
    """For each row of a block, packed, the other rows within the radius."""
    m = len(block)
    bits, planes = bit_planes(block)
    words = -(-m // 64)
    beyond = np.packbits((np.arange(words * 64) >= m).astype(np.uint8), bitorder="little").view("<u8")
    found = []
    for at in range(0, m, queries):
        mine = np.arange(at, min(at + queries, m))
        over = np.broadcast_to(beyond, (len(mine), words)).copy()
        over[np.arange(len(mine)), mine // 64] |= _U64(1) << (mine % 64).astype(_U64)
        found.append(_compare(bits[mine], lambda plane, live: np.broadcast_to(plane, (len(live), words)), over, planes, radius))
    return np.concatenate(found)


def small_blocks_within(rows: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``within_radius`` for many blocks of at most 64 rows at once, given one after the other.

    Blocks share machine words but none lies across two, so a query needs one word.  Returns
    for each row its packed lanes and the lane of its block's first row.
    """
    place = np.zeros(len(sizes), np.int64)
    at = 0
    for i, n in enumerate(sizes.tolist()):
        if at % 64 + n > 64:
            at += 64 - at % 64
        place[i] = at
        at += n
    first = np.repeat(place, sizes)
    lane = first + np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    laid = np.zeros((-(-at // 64) * 64, rows.shape[1]), rows.dtype)
    laid[lane] = rows
    bits = np.unpackbits(laid.view(np.uint8).reshape(len(laid), -1), axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")
    block = np.repeat(np.where(sizes == 64, _FULL, (_U64(1) << (sizes % 64).astype(_U64)) - _U64(1)), sizes) << (first % 64).astype(_U64)
    over = (~block | _U64(1) << (lane % 64).astype(_U64))[:, None]
    word = lane // 64
    return _compare(bits[lane], lambda plane, live: plane[word[live]][:, None], over, planes, radius)[:, 0], first % 64


def _spanning(hits: np.ndarray) -> list[tuple[int, int]]:
    """(child, parent) rows of a spanning forest, by breadth; ``hits`` are packed neighbours."""
    m = len(hits)
    unseen = np.ones(-(-m // 64) * 64, bool)
    unseen[m:] = False
    pairs = []
    for root in np.flatnonzero(hits.any(axis=1)):
        if not unseen[root]:
            continue
        unseen[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            found = np.flatnonzero(np.unpackbits(hits[at].view(np.uint8), bitorder="little").astype(bool) & unseen)
            unseen[found] = False
            pairs += [(f, at) for f in found]
            queue.extend(found.tolist())
    return pairs


def forests(rows: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """(child, parent) rows of a spanning forest of the links within each of many blocks, laid one after the other."""
    start = np.cumsum(sizes) - sizes
    pairs: list[tuple[int, int]] = []
    small = np.flatnonzero(sizes <= 64)
    for at in range(0, len(small), 512):
        some = small[at : at + 512]
        index = np.repeat(start[some], sizes[some]) + np.arange(sizes[some].sum()) - np.repeat(np.cumsum(sizes[some]) - sizes[some], sizes[some])
        lanes, first = small_blocks_within(rows[index], sizes[some], radius)
        owner = np.repeat(np.arange(len(some)), sizes[some])
        ends = np.cumsum(sizes[some])
        for b in np.unique(owner[lanes != 0]):
            lo, hi = ends[b] - sizes[some[b]], ends[b]
            hits = (lanes[lo:hi] >> first[lo:hi].astype(_U64))[:, None]
            own = index[lo:hi]
            pairs += [(own[c], own[p]) for c, p in _spanning(hits)]
    for b in np.flatnonzero(sizes > 64):
        block = np.ascontiguousarray(rows[start[b] : start[b] + sizes[b]])
        pairs += [(start[b] + c, start[b] + p) for c, p in _spanning(within_radius(block, radius))]
    return np.array(pairs, np.int64).reshape(-1, 2)


# ---------------------------------------------------------------- blocks from bands


def _split(bits: list[int], n: int) -> list[list[int]]:
    edges = [round(i * len(bits) / n) for i in range(n + 1)]
    return [bits[a:b] for a, b in zip(edges, edges[1:], strict=False)]


class _Path:
    """Bits that a block's fingerprints share, and those left to divide it by."""

    def __init__(self, fixed: list[int], left: list[int]):
        self.fixed, self.left = fixed, left

    def key(self, fp: list[Column], lanes: int) -> Column:
        parts = []
        for lane in range(lanes):
            word = sum(1 << (b - 64 * lane) for b in self.fixed if b // 64 == lane)
            if word:
                signed = word - 2**64 if word >= 2**63 else word
                parts.append(fp[lane].bitwiseAND(F.lit(signed).cast("long")))
        return F.xxhash64(*parts) if len(parts) > 1 else parts[0]

    def children(self, n: int) -> list[_Path]:
        return [_Path(self.fixed + g, [b for b in self.left if b not in set(g)]) for g in _split(self.left, n)]


class _Blocks:
    """Takes rows in the order of their groups; gives links, and rows of groups to be divided again.

    A group of at most ``block`` rows is one block.  A larger one goes on whole to be divided.
    """

    def __init__(self, lanes: int, radius: int, block: int):
        self.lanes, self.radius, self.block = lanes, radius, block
        self.group: tuple[int, int] | None = None
        self.fp, self.node = np.empty((0, lanes), _U64), np.empty(0, np.int64)
        self.spilled = False
        self.links: list[np.ndarray] = []
        self.rest: list[tuple[int, np.ndarray, np.ndarray]] = []

    def _link(self, fp: np.ndarray, node: np.ndarray, sizes: np.ndarray) -> None:
        pairs = forests(fp, sizes, self.radius)
        if len(pairs):
            self.links.append(node[pairs])

    def _spill(self, fp: np.ndarray, node: np.ndarray) -> None:
        self.rest.append((self.group[0], fp, node))

    def _add(self, fp: np.ndarray, node: np.ndarray) -> None:
        while len(fp) and not self.spilled:
            room = self.block - len(self.fp)
            if room == 0:
                self._spill(self.fp, self.node)
                self.spilled = True
                continue
            self.fp, self.node = np.concatenate([self.fp, fp[:room]]), np.concatenate([self.node, node[:room]])
            fp, node = fp[room:], node[room:]
        if len(fp):
            self._spill(fp, node)

    def close(self) -> None:
        if not self.spilled and len(self.fp) > 1:
            self._link(np.ascontiguousarray(self.fp), self.node, np.array([len(self.fp)]))
        self.group, self.fp, self.node, self.spilled = None, self.fp[:0], self.node[:0], False

    def _piece(self, group: tuple[int, int], fp: np.ndarray, node: np.ndarray) -> None:
        if self.group != group:
            self.close()
            self.group = group
        self._add(fp, node)

    def take(self, path: np.ndarray, key: np.ndarray, fp: np.ndarray, node: np.ndarray) -> None:
        cut = np.flatnonzero((path[1:] != path[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(path)]])
        inner = np.arange(len(starts))[1:-1]
        small = inner[(ends - starts)[inner] <= self.block]
        for g in np.setdiff1d(np.arange(len(starts)), small):
            if g == len(starts) - 1 and len(small):
                index = np.concatenate([np.arange(starts[i], ends[i]) for i in small])
                self._link(fp[index], node[index], (ends - starts)[small])
            self._piece((int(path[starts[g]]), int(key[starts[g]])), fp[starts[g] : ends[g]], node[starts[g] : ends[g]])

    def drain(self) -> pa.RecordBatch:
        """Links as (a, b), and rows to be divided as (path, node, f0...)."""
        links = np.concatenate(self.links) if self.links else np.empty((0, 2), np.int64)
        paths = np.concatenate([np.full(len(n), p) for p, _, n in self.rest]) if self.rest else np.empty(0, np.int64)
        nodes = np.concatenate([n for _, _, n in self.rest]) if self.rest else np.empty(0, np.int64)
        prints = np.concatenate([f for _, f, _ in self.rest]).view(np.int64) if self.rest else np.empty((0, self.lanes), np.int64)
        self.links, self.rest = [], []
        none = lambda n: pa.nulls(n, pa.int64())
        column = lambda first, then: pa.concat_arrays([pa.array(first, pa.int64()) if not isinstance(first, pa.Array) else first, pa.array(then, pa.int64()) if not isinstance(then, pa.Array) else then])
        n, m = len(links), len(nodes)
        columns = [column(links[:, 0], none(m)), column(links[:, 1], none(m)), column(none(n), paths), column(none(n), nodes)]
        columns += [column(none(n), np.ascontiguousarray(prints[:, k])) for k in range(self.lanes)]
        return pa.record_batch(columns, ["a", "b", "path", "node", *[f"f{k}" for k in range(self.lanes)]])


def _links(nodes: DataFrame, lanes: int, paths: list[_Path], radius: int, block: int) -> DataFrame:
    """``(a, b)``: spanning forests of the links within every block, as nodes.

    Rows are shuffled once by (path, key) and met in order by a task, which holds one block at a
    time.  A group of more than ``block`` is divided again by bands of the bits left, until no group is
    left.
    """
    spark = nodes.sparkSession
    f = [f"f{k}" for k in range(lanes)]
    word = [F.col(x) for x in f]
    schema = "a long, b long, path long, node long, " + ", ".join(f"{x} long" for x in f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(lanes, radius, block)
        for batch in batches:
            if batch.num_rows:
                columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                fp = np.ascontiguousarray(np.column_stack(columns[3:])).view(_U64)
                blocks.take(columns[0], columns[1], fp, columns[2])
                yield blocks.drain()
        blocks.close()
        yield blocks.drain()

    def keys(some: list[_Path], first: int = 0) -> Column:
        return F.array(*[F.struct(F.lit(first + i).cast("long").alias("path"), p.key(word, lanes).alias("key")) for i, p in enumerate(some)])

    rows = nodes.select("node", *[F.col("fp")[k].alias(x) for k, x in enumerate(f)])
    choice, found = keys(paths), None
    while True:
        keyed = rows.withColumn("k", F.explode(choice)).select(F.col("k.path").alias("path"), F.col("k.key").alias("key"), "node", *f)
        ordered = keyed.repartition(shuffle_width(spark), "path", "key").sortWithinPartitions("path", "key")
        made = staged(ordered.mapInArrow(run, schema), "blocks")
        links = made.where("a IS NOT NULL").select("a", "b")
        found = links if found is None else found.unionByName(links)
        rows = made.where("path IS NOT NULL").select("path", "node", *f)
        used = sorted(r["path"] for r in rows.select("path").distinct().collect())  # at most one for each path
        if not used:
            return found
        after: list[_Path] = []
        choice = None
        for p in used:
            grown = paths[p].children(radius + 1)
            chosen = keys(grown, len(after))
            choice = F.when(F.col("path") == p, chosen) if choice is None else choice.when(F.col("path") == p, chosen)
            after += grown
        paths = after


def _nodes(prints: DataFrame) -> DataFrame:
    """One node for each distinct fingerprint, named by its smallest id."""
    return staged(
        prints.groupBy("fp").agg(F.min(F.coalesce("id", F.lit(LAST_ID))).alias("node")), "nodes"
    )


def link_components(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``(id, fp, component_id)`` of ``prints (id, fp)``: every link within the radius, none lost."""
    nodes = _nodes(prints)
    paths = _Path([], list(range(64))).children(radius + 1)
    edges = _links(nodes, 1, paths, radius, block)
    reach = staged(components(edges), "reach")
    named = staged(
        nodes.join(reach, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "named"
    )
    return prints.join(named, "fp").select(
        "id", "fp", F.when(F.col("component_id") != LAST_ID, F.col("component_id")).alias("component_id")
    )


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    prints = staged(fingerprints(docs).select("id", F.col("fp")), "prints")
    return link_components(prints).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"),
        "component_id",
    )
