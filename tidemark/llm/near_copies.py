"""Near copies: texts linked by a Jaccard similarity of their word shingles, by bit-sliced SimHash.

Two texts at the similarity differ in about 39 of 256 SimHash bits, beyond the reach of bands that
cover a small radius.  So blocks are made of texts that share an extreme shingle, which keeps the work
in proportion to the input, for unrelated texts share none:

1. *Blocks.*  Each of four lanes of shingle hashes gives two keys, its least and its greatest hash.
   Texts at similarity s agree on a key with probability s, so a pair at 0.8 shares none of
   eight with a probability of 0.2 ** 8 or less, whatever the size of the corpus.  Every block is
   compared by bit planes with a wide radius; only a spanning forest of its *candidate* links is kept.
2. *Large blocks.*  A block of more than ``block`` rows is thinned: rows within ``tight`` bits of a row held
   are linked to it and let go, and from then on rows are compared with the rows held by the
   radius ``spread``, which covers every row that a row let go can link to.  A block that does not become
   small this way holds texts that share a passage and little else; nothing of it is let go, it
   is divided by the other keys.  Of pairs at 0.8 a division loses those that share no further key: 0.2 ** 7, and
   then 0.2 ** 6 and 0.2 ** 5.
3. *Groups.*  Components of the candidate links hold every link whole.  Their texts come together once, and all
   pairs within the radius that are not yet connected are checked by their shingle sets.
4. *Large groups* are dealt over chunks of bounded size and checked within them; then the representatives of
   what was found are checked among themselves; and at last every row that is not in the main
   component of its group meets all rows of the group.  So no link between components is left out
   however large the group, and no task holds more than two chunks.

Components therefore don't depend on ``block`` or on the chunks: they are those of all links that share a
block key and lie within the radius.

Defined results
---------------
* null or empty text, or white space only: texts without words are copies of each other, and of nothing else
* fewer words than a shingle: the whole word sequence is the one shingle
* null id: ranks after every other id, and is returned as null
* equal ids: each row is judged by its own text; rows that are equal in id and text stay or go together
* empty table: empty result
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LAST_ID, mark, settled, ship, shuffle_width, staged
from tidemark.llm.components import components
from tidemark.llm.simhash import BLOCK, _compare, forests, majority, shingle_hashes, within_radius
from tidemark.llm.textbytes import groups

SHINGLE = 5
SIMILARITY = 0.8
#: Keys that a block's rows share at most, and half of all at most, before it is no longer divided.
DEPTH = 4
#: Rows and grams of one chunk of a large group.
CHUNK_ROWS, CHUNK_GRAMS = 1024, 4 << 20

_U64 = np.uint64


def shingle_sets(texts: list[bytes | None], size: int = SHINGLE) -> list[np.ndarray]:
    """The set of shingle hashes of each text, sorted."""
    return [np.unique(shingle_hashes(t, size)) for t in texts]


@dataclass(frozen=True)
class Scheme:
    """What texts are compared by, and the distances that go with it.

    A text has two keys and 64 fingerprint bits for each lane.  With ``length_partition`` texts meet only within a
    partition of set sizes and between neighbours.
    """

    #: Sorted sets of 64-bit hashes of texts, or of what ``packed`` makes of them.
    sets: Callable[[list], list[np.ndarray]] = shingle_sets
    #: Texts as bytes that are smaller than the text and tell the set; they are kept, and texts need no second look.
    packed: Callable[[list], list[bytes]] | None = None
    lanes: int = 4
    #: Bits that links may differ in: 39 of 256 on average at a similarity of 0.8, with a deviation of 5.7.
    radius: int = 68
    #: Rows of a large block this near to a row held are let go (a similarity of 0.7 at least).  What such a row
    #: links to is at 0.5 or above to the row held: 69 bits on average, with a deviation of 7.
    tight: int = 40
    spread: int = 104
    length_partition: Callable[[int], int] | None = None

    @property
    def prints(self) -> list[str]:
        return [f"f{k}" for k in range(self.lanes)]

    @property
    def keys(self) -> list[str]:
        return [f"k{k}" for k in range(2 * self.lanes)]


def remix(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Further 64-bit hashes of the same shingles (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = hashes + _U64((0x9E3779B97F4A7C15 * lane) % 2**64)
        x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
        return x ^ (x >> _U64(31))


def set_print(grams: np.ndarray, scheme: Scheme) -> list[int]:
    """SimHash, keys, the two hashes that name the set, its size and its partition."""
    prints, keys = [], []
    for lane in range(scheme.lanes):
        hashes = grams if lane == 0 else remix(grams, lane)
        prints.append(majority(hashes))
        ends = np.array([hashes.min(), hashes.max()] if len(hashes) else [0, 0], _U64)
        keys += ends.view(np.int64).tolist()
    name = xxhash.xxh3_128_intdigest(grams.tobytes()).to_bytes(16, "little")
    part = scheme.length_partition(len(grams)) if scheme.length_partition else 0
    return [*prints, *keys, *np.frombuffer(name, "<i8").tolist(), len(grams), part]


# ---------------------------------------------------------------- blocks


def near_rows(block: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """For each query, as booleans, the rows of a block within the radius."""
    m = len(block)
    words = -(-m // 64)
    to_bits = lambda rows: np.unpackbits(np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
    padded = np.zeros((64 * block.shape[1], words * 64), np.uint8)
    padded[:, :m] = to_bits(block).T
    planes = np.packbits(padded, axis=1, bitorder="little").view("<u8")
    beyond = np.packbits((np.arange(words * 64) >= m).astype(np.uint8), bitorder="little").view("<u8")
    found = [np.zeros((0, m), bool)]
    for at in range(0, len(queries), 256):
        bits = to_bits(queries[at : at + 256])
        over = np.broadcast_to(beyond, (len(bits), words)).copy()
        hits = _compare(bits, lambda plane, live: np.broadcast_to(plane, (len(live), words)), over, planes, radius)
        found.append(np.unpackbits(hits.view(np.uint8), axis=1, bitorder="little")[:, :m].astype(bool))
    return np.concatenate(found)


class _Blocks:
    """Takes rows in the order of their blocks; gives candidate links, and rows of blocks to be divided.

    All rows of a block that is larger than ``block`` are given out again, so that it can be divided; if
    it turned out to be dense (thinning keeps it small) a note says that this is not needed.
    With ``last`` blocks are not divided any more: one that is not dense is held whole.
    """

    def __init__(self, scheme: Scheme, block: int, last: bool):
        self.scheme, self.block, self.last = scheme, block, last
        self.group: tuple[int, int] | None = None
        self.state = "small"
        self.fp, self.node = np.empty((0, scheme.lanes), _U64), np.empty(0, np.int64)
        self.links: list[np.ndarray] = []
        self.rest: list[tuple[tuple[int, int], np.ndarray]] = []
        self.dense: list[tuple[int, int]] = []

    def _link(self, fp: np.ndarray, node: np.ndarray, sizes: np.ndarray, radius: int) -> None:
        pairs = forests(fp, sizes, radius)
        if len(pairs):
            self.links.append(node[pairs])

    def _thin(self, fp: np.ndarray) -> np.ndarray:
        """Rows that stay when those within ``tight`` bits of an earlier one go."""
        near = within_radius(fp, self.scheme.tight)
        covered, kept = np.zeros(near.shape[1], _U64), []
        for i in range(len(near)):
            if not covered[i // 64] >> _U64(i % 64) & _U64(1):
                kept.append(i)
                covered |= near[i]
        return np.array(kept, np.int64)

    def _overflow(self) -> None:
        self._link(self.fp, self.node, np.array([len(self.fp)]), self.scheme.radius)
        kept = self._thin(self.fp)
        if len(kept) <= self.block // 2:
            self.state, self.fp, self.node = "dense", self.fp[kept], self.node[kept]
        elif self.last:
            self.state = "held"
        else:
            self.state, self.fp, self.node = "sparse", self.fp[:0], self.node[:0]

    def _meet(self, fp: np.ndarray, node: np.ndarray) -> None:
        """New rows of a large block against the rows held, which in a dense block stand for those let go."""
        dense = self.state == "dense"
        radius = self.scheme.spread if dense else self.scheme.radius
        near = near_rows(self.fp, fp, radius)
        met = np.flatnonzero(near.any(axis=1))
        label = np.arange(len(self.fp))  # rows held that one new row has joined
        for i in met:
            held = np.flatnonzero(near[i])
            others = held[np.unique(label[held], return_index=True)[1]]
            self.links.append(np.column_stack([np.full(len(others), node[i]), self.node[others]]))
            if len(others) > 1:
                label[np.isin(label, label[others])] = label[others[0]]
        if dense:
            gone = met[near_rows(self.fp, fp[met], self.scheme.tight).any(axis=1)]
            new = np.setdiff1d(np.arange(len(fp)), gone)
            fp, node = np.ascontiguousarray(fp[new]), node[new]
        if len(fp):
            self._link(fp, node, np.array([len(fp)]), radius)
            kept = self._thin(fp) if dense else slice(None)
            self.fp, self.node = np.concatenate([self.fp, fp[kept]]), np.concatenate([self.node, node[kept]])
        if dense and len(self.fp) > self.block // 2 and not self.last:
            self.state, self.fp, self.node = "sparse", self.fp[:0], self.node[:0]

    def _add(self, fp: np.ndarray, node: np.ndarray) -> None:
        if self.state != "small":
            self.rest.append((self.group, node))
        while len(fp) and self.state != "sparse":
            if self.state != "small":
                self._meet(fp[: self.block], node[: self.block])
                fp, node = fp[self.block :], node[self.block :]
                continue
            room = self.block - len(self.fp)
            if room == 0:
                self.rest += [(self.group, self.node), (self.group, node)]
                self._overflow()
                continue
            self.fp, self.node = np.concatenate([self.fp, fp[:room]]), np.concatenate([self.node, node[:room]])
            fp, node = fp[room:], node[room:]

    def close(self) -> None:
        if self.state in ("dense", "held"):
            self.dense.append(self.group)
        elif len(self.fp) > 1:
            self._link(np.ascontiguousarray(self.fp), self.node, np.array([len(self.fp)]), self.scheme.radius)
        self.group, self.state, self.fp, self.node = None, "small", self.fp[:0], self.node[:0]

    def _piece(self, group: tuple[int, int], fp: np.ndarray, node: np.ndarray) -> None:
        if self.group != group:
            self.close()
            self.group = group
        self._add(fp, node)

    def take(self, path: np.ndarray, key: np.ndarray, fp: np.ndarray, node: np.ndarray) -> None:
        cut = np.flatnonzero((path[1:] != path[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(path)]])
        whole = np.zeros(len(starts), bool)  # blocks that begin and end within these rows
        whole[1:-1] = (ends - starts)[1:-1] <= self.block
        for g in np.flatnonzero(~whole):
            self._piece((int(path[starts[g]]), int(key[starts[g]])), fp[starts[g] : ends[g]], node[starts[g] : ends[g]])
        some = np.flatnonzero(whole & (ends - starts > 1))
        if len(some):
            index = np.concatenate([np.arange(starts[i], ends[i]) for i in some])
            self._link(fp[index], node[index], (ends - starts)[some], self.scheme.radius)

    def drain(self) -> pa.RecordBatch:
        """Links (0, a, b), rows to be divided (1, node, -, path, key), dense blocks (2, -, -, path, key)."""
        links = np.concatenate(self.links) if self.links else np.empty((0, 2), np.int64)
        parts = [np.column_stack([np.zeros(len(links), np.int64), links, np.zeros((len(links), 2), np.int64)])]
        for (path, key), nodes in self.rest:
            parts.append(np.column_stack([np.ones(len(nodes), np.int64), nodes, *[np.full(len(nodes), x, np.int64) for x in (0, path, key)]]))
        parts += [np.array([[2, 0, 0, path, key]], np.int64) for path, key in self.dense]
        self.links, self.rest, self.dense = [], [], []
        rows = np.concatenate(parts)
        return pa.record_batch([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(5)], ["kind", "a", "b", "path", "key"])


def candidate_links(nodes: DataFrame, scheme: Scheme, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: forests of the candidate links within the blocks of ``nodes (node, part, f0.., k0..)``.

    Rows are shuffled once by (path, key), a path being the keys that a block's rows share, and a task meets
    them in order.  Rows of blocks to be divided go on with each further key.
    """
    spark = nodes.sparkSession
    columns = ["node", "part", *scheme.prints]

    def keys(paths: list[tuple[int, ...]], first: int = 0) -> Column:
        def place(i: int, p: tuple[int, ...], *more: Column) -> Column:
            own = [F.col(scheme.keys[k]) for k in p]
            key = own[0] if len(p) == 1 and not more else F.xxhash64(*own, *more)
            return F.struct(F.lit(first + i).cast("long").alias("path"), key.alias("key"))

        if scheme.length_partition is None:
            return F.array(*[place(i, p) for i, p in enumerate(paths)])
        return F.array(*[place(i, p, F.col("part") + step) for i, p in enumerate(paths) for step in (0, 1)])

    def compared(rows: DataFrame, last: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = _Blocks(scheme, block, last)
            for batch in batches:
                if batch.num_rows:
                    path, key, node, *fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                    blocks.take(path, key, np.ascontiguousarray(np.column_stack(fp)).view(_U64), node)
                    yield blocks.drain()
            blocks.close()
            yield blocks.drain()

        ordered = rows.select("p.path", "p.key", "node", *scheme.prints).repartition(shuffle_width(spark), "path", "key").sortWithinPartitions("path", "key")
        return staged(ordered.mapInArrow(run, "kind long, a long, b long, path long, key long"), "blocks")

    n_keys = len(scheme.keys)
    paths: list[tuple[int, ...]] = [(k,) for k in range(n_keys)]
    rows, found = nodes.select(*columns, F.explode(keys(paths)).alias("p")), None
    while True:
        made = compared(rows, len(paths[0]) >= min(DEPTH, n_keys // 2))
        links = made.where("kind = 0").select("a", "b")
        found = links if found is None else found.unionByName(links)
        dense = made.where("kind = 2").select("path", "key")
        rest = made.where("kind = 1").join(dense, ["path", "key"], "left_anti").select(F.col("a").alias("node"), "path")
        used = sorted(r["path"] for r in rest.select("path").distinct().collect())  # at most one for each path
        if not used:
            return found
        after: list[tuple[int, ...]] = []
        choice = None
        for p in used:
            grown = [(*paths[p], k) for k in range(n_keys) if k not in paths[p]]
            chosen = keys(grown, len(after))
            choice = F.when(F.col("path") == p, chosen) if choice is None else choice.when(F.col("path") == p, chosen)
            after += grown
        rows, paths = rest.join(nodes, "node").select(*columns, F.explode(choice).alias("p")), after


# ---------------------------------------------------------------- the check by shingle sets


class _Sets:
    """Shingle sets over one vocabulary, for exact similarities of one set with many."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        words, tokens = np.unique(np.concatenate([*sets, np.empty(0, _U64)]), return_inverse=True)
        self.tokens = tokens.reshape(-1)
        self.mark = np.zeros(len(words), bool)

    def linked(self, i: int, others: np.ndarray, similarity: float) -> np.ndarray:
        """Those of ``others`` whose Jaccard similarity with set ``i`` is high enough."""
        small, large = np.minimum(self.size[others], self.size[i]), np.maximum(self.size[others], self.size[i])
        others = others[(small >= similarity * large) & (small > 0)]
        if not len(others):
            return others
        own = self.tokens[self.start[i] : self.start[i + 1]]
        self.mark[own] = True
        hit = self.mark[np.concatenate([self.tokens[self.start[j] : self.start[j + 1]] for j in others])]
        self.mark[own] = False
        both = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(self.size[others])[:-1]]), dtype=np.int64)
        return others[both >= similarity * (self.size[i] + self.size[others] - both)]


def checked_links(fp: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float, mine: np.ndarray | None = None, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect rows which no other link given connects: a spanning forest of all links within the radius.

    With ``mine`` only the rows at those places are taken as queries, against all; rows of one ``label``
    are connected already.
    """
    label = np.arange(len(fp)) if label is None else label.copy()
    table, out = _Sets(sets), []
    queries = np.arange(len(fp)) if mine is None else mine
    if len(fp) > 16:
        near = near_rows(fp, fp[queries], radius)
    else:
        near = np.bitwise_count(fp[queries][:, None] ^ fp[None]).sum(axis=2) <= radius
    for i, row in zip(queries, near, strict=True):
        if mine is None:
            row[: i + 1] = False
        for j in table.linked(i, np.flatnonzero(row & (label != label[i])), similarity):
            if label[j] != label[i]:
                out.append((int(i), int(j)))
                label[label == label[j]] = label[i]
    return out


def _checked(rows: DataFrame, scheme: Scheme, similarity: float, sweep: bool = False) -> DataFrame:
    """``(a, b)`` for ``rows (cell.., node, f0.., body)``, all rows of a cell in one task; with ``sweep`` also mine, label."""
    prints, lanes = scheme.prints, scheme.lanes
    cell = [c for c in rows.columns if c not in {"node", *prints, "body", "mine", "label"}]
    more = ["mine", "label"] * sweep

    def solve(held: list[tuple]) -> np.ndarray:
        seen: dict[int, tuple] = {}
        for row in held:  # a node comes once as a query and once as a row of its group at most
            if row[0] not in seen or (sweep and row[-2]):
                seen[row[0]] = row
        rows = list(seen.values())
        fp = np.array([r[1 : 1 + lanes] for r in rows], np.int64).view(_U64)
        sets = scheme.sets([r[1 + lanes] for r in rows])
        if sweep:
            _, label = np.unique([r[-1] for r in rows], return_inverse=True)
            pairs = checked_links(fp, sets, scheme.radius, similarity, np.flatnonzero([r[-2] for r in rows]), label.reshape(-1))
        else:
            pairs = checked_links(fp, sets, scheme.radius, similarity)
        nodes = np.array([r[0] for r in rows], np.int64)
        return nodes[np.array(pairs, np.int64).reshape(-1, 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def links() -> pa.RecordBatch:
            found = solve(held) if len(held) > 1 else np.empty((0, 2), np.int64)
            return pa.record_batch([pa.array(np.ascontiguousarray(found[:, k])) for k in range(2)], ["a", "b"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                if row[: len(cell)] != now:
                    if held:
                        yield links()
                    now, held = row[: len(cell)], []
                held.append(row[len(cell) :])
        if held:
            yield links()

    spark = rows.sparkSession
    ordered = rows.select(*cell, "node", *prints, "body", *more).repartition(shuffle_width(spark), *cell).sortWithinPartitions(*cell)
    return staged(ordered.mapInArrow(run, "a long, b long"), "checked")


def _chunks(rows: Column, grams: Column, chunk_rows: int) -> Column:
    return F.greatest(F.ceil(rows / chunk_rows), F.ceil(grams / CHUNK_GRAMS)).cast("long")


def _dealt(chunks: Column, salt: int = 0) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "node"), chunks)


def _joined_up(rows: DataFrame, links: DataFrame, scheme: Scheme, similarity: float, chunk_rows: int) -> DataFrame:
    """The links between the chunks of large groups; ``rows (group, node, n, f0.., body)`` of those groups, ``links`` within chunks."""
    size = lambda df, *by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("grams"))

    def labelled() -> DataFrame:
        reach = staged(components(links), "reach")
        return staged(rows.join(reach, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"), "labelled")

    # Representatives among themselves, as long as that joins a good part of them.
    before, salt = None, 0
    while True:
        named = labelled()
        heads = named.where("label = node")
        open_groups = staged(size(heads, "group").where("rows > 1"), "heads")
        n = open_groups.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        if not n:
            return links
        if before is not None and n > 0.7 * before:
            break
        before, salt = n, salt + 1
        some = heads.join(open_groups.withColumn("chunks", _chunks(F.col("rows"), F.col("grams"), chunk_rows)).select("group", "chunks"), "group")
        links = links.unionByName(_checked(some.withColumn("chunk", _dealt(F.col("chunks"), salt)).select("group", "chunk", "node", *scheme.prints, "body"), scheme, similarity))

    # Every row outside the main component of its group against all rows of the group.
    main = size(named, "group", "label").groupBy("group").agg(F.max_by("label", F.struct("rows", "label")).alias("main"), F.sum("rows").alias("rows"), F.sum("grams").alias("grams"))
    main = staged(main.select("group", "main", _chunks(F.col("rows"), F.col("grams"), chunk_rows).alias("deep")), "main")
    outer = named.join(main, "group").where("label <> main")
    wide = staged(size(outer, "group").select("group", _chunks(F.col("rows"), F.col("grams"), chunk_rows).alias("wide")), "outer")
    cells = named.join(main, "group").join(wide, "group")
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = cells.where("label <> main").withColumn("w", _dealt(F.col("wide"))).withColumn("d", span("deep")).withColumn("mine", F.lit(True))
    others = cells.withColumn("d", _dealt(F.col("deep"))).withColumn("w", span("wide")).withColumn("mine", F.lit(False))
    columns = ["group", "w", "d", "node", *scheme.prints, "body", "mine", "label"]
    return links.unionByName(_checked(asked.select(*columns).unionByName(others.select(*columns)), scheme, similarity, sweep=True))


# ---------------------------------------------------------------- the operator


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    """A row's rank, and two hashes of its text."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)), F.xxhash64(body), F.xxhash64(F.lit(7), body)


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    scheme: Scheme | None = None,
    similarity: float = SIMILARITY,
    block: int = BLOCK,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``(id, t1, t2, component_id)`` of every row: groups of texts linked at the similarity or above.

    ``t1``, ``t2`` are hashes of the row's text.  Equal sets are one node from the start.
    """
    scheme = scheme or Scheme()
    prints, keys = scheme.prints, scheme.keys
    made_columns = [*prints, *keys, "s1", "s2", "n", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in groups(batch.column(3)):
                bodies = batch.column(3)[a:b].to_pylist()
                kept = []
                if scheme.packed:
                    bodies = scheme.packed(bodies)
                    kept = [pa.array(bodies, pa.binary())]
                rows = [set_print(s, scheme) for s in scheme.sets(bodies)]
                made = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.record_batch([*[c[a:b] for c in batch.columns[:3]], *made, *kept], ["id", "t1", "t2", *made_columns, *["body"] * len(kept)])

    ship(docs.sparkSession)
    since = mark()
    rank, t1, t2 = _rows(docs, id_col, text_col)
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body")
    rows = docs.select(rank.alias("id"), t1.alias("t1"), t2.alias("t2"), body)
    schema = ", ".join(f"{c} long" for c in ["id", "t1", "t2", *made_columns]) + (", body binary" if scheme.packed else "")
    told = staged(rows.mapInArrow(run, schema), "prints")
    one = told.groupBy("s1", "s2").agg(F.min(F.struct("id", "t1", "t2")).alias("rep"), *[F.min(c).alias(c) for c in (*prints, *keys, "n", "part")])
    nodes = staged(one.withColumn("node", F.monotonically_increasing_id()), "nodes")

    near = staged(components(candidate_links(nodes, scheme, block)), "near").withColumnRenamed("component", "group")
    members = near.join(nodes, "node").select("group", "node", "n", *prints, F.col("rep.id").alias("id"), F.col("rep.t1").alias("t1"), F.col("rep.t2").alias("t2"))
    chunks = members.groupBy("group").agg(_chunks(F.count(F.lit(1)), F.sum("n"), chunk_rows).alias("chunks"))
    members = staged(members.join(chunks, "group"), "members")
    bodies = told.select("id", "t1", "t2", "body") if scheme.packed else rows
    texts = bodies.join(members, ["id", "t1", "t2"]).select("group", "chunks", "node", "n", *prints, "body")
    large = members.where("chunks > 1").limit(1).count()
    if large:  # they are read again
        texts = staged(texts, "texts")
    links = _checked(texts.withColumn("chunk", _dealt(F.col("chunks"))).select("group", "chunk", "node", *prints, "body"), scheme, similarity)
    if large:
        links = _joined_up(texts.where("chunks > 1").drop("chunks").dropDuplicates(["node"]), links, scheme, similarity, chunk_rows)

    reach = staged(components(links), "reach")
    named = staged(
        nodes.join(reach, "node", "left").select(F.coalesce("component", "node").alias("label"), "s1", "s2", F.col("rep.id").alias("id")), "named"
    )
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    named = staged(named.join(least, "label").select("s1", "s2", "component_id"), "components")
    known = lambda c: F.when(F.col(c) != LAST_ID, F.col(c)).alias(c)
    return settled(told.join(named, ["s1", "s2"]).select(known("id"), "t1", "t2", known("component_id")), "copies", since)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text is linked, over any number of links, to a row of a smaller id."""
    groups = near_copies(docs, id_col, text_col).where(F.col("id").eqNullSafe(F.col("component_id")))
    kept = staged(groups.select(F.coalesce("id", F.lit(LAST_ID)).alias("_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2")).distinct(), "kept")
    rank, t1, t2 = _rows(docs, id_col, text_col)
    rows = docs.select(F.struct("*").alias("_row"), rank.alias("_id"), t1.alias("_t1"), t2.alias("_t2"))
    return rows.join(kept, ["_id", "_t1", "_t2"], "left_semi").select("_row.*")
