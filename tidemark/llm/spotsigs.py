"""SpotSigs document fingerprints.

A *spot signature* is a common word (the anchor) and the chain of content words that follows it.  Prose
is full of anchors and boilerplate has few, so the set of a text's signatures stands for its
prose.  Signatures are 32-bit hashes; a fingerprint is the sorted set of them.

Texts of an Arrow batch are cut into words and hashed as one byte array; no word becomes a Python
object.  Fingerprints fall into partitions by the size of their sets, such that a wanted
similarity can only be reached within a partition or between neighbours.

``similar_texts`` finds the near copies of a whole table: fingerprints meet in blocks of one partition and one
signature, an extreme one of their set under a hash, as rows of a partition and of the one below; pairs that a
bit sketch does not rule out are pruned by their sizes, and then their common signatures are counted.  Links of a
similarity of 0.8 are missed with a probability of 0.2 ** 4 or less.  Of equal sets one is compared.

Defined results
---------------
* null text: the empty text; its fingerprint is empty
* no anchor in a text: every word anchors; fewer words than a chain: the word sequence is one signature
* likeness of two empty fingerprints: 1, of an empty one and another: 0
* null id: comes first in descending order; equal ids: in the order of their texts' hashes
* one document only: it is its own next document
* empty table: empty result
* other columns are not read
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import LAST_ID, ship, shuffle_width
from tidemark.llm.near_copies import Scheme, near_copies
from tidemark.llm.textbytes import joined, lowered, runs

#: Content words of a chain.
CHAIN = 2
#: Bytes of text that a task works on at once.
WORK_BYTES = 4 << 20
#: Ranges of ids for each shuffle partition.
RANGES = 4

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to a in is that for it was on are as with his they at be this from have or by one had not but what all were "
    "der die das und in zu den mit von für auf ist im nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "le la les de des du et un une que qui dans est pour pas sur au avec ce il par plus se sont "
    "el los las del y en por con su para como al lo o si más ya era pero entre"
)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.full(max(n, 1 << 20), _BASE | np.uint64(1), np.uint64)) if n else _POWERS
    return _POWERS[:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and 64-bit hash of each word of a byte array that ends in no word."""
    low = lowered(data, latin=True)
    first, after = runs(_WORD[low])
    if not len(first):
        return first, np.zeros(0, np.uint64)
    # Bytes weighted by powers counted from the word's own beginning.
    place = np.arange(len(low)) - np.repeat(first, np.diff(np.append(first, len(low))))[: len(low)] if first[0] == 0 else None
    if place is None:
        lead = np.concatenate([[0], first])
        place = np.arange(len(low)) - np.repeat(lead, np.diff(np.append(lead, len(low))))
    weighted = (low.astype(np.uint64) + np.uint64(1)) * _powers(int(place.max()) + 1)[place]
    weighted[~_WORD[low]] = 0
    return first, _mix(np.add.reduceat(weighted, first))


_anchors: np.ndarray | None = None


def _anchor_hashes() -> np.ndarray:
    global _anchors
    if _anchors is None:
        _anchors = np.unique(word_hashes(np.frombuffer(ANCHORS.encode() + b"\n", np.uint8))[1])
    return _anchors


def _chained(heads: np.ndarray, content: np.ndarray, hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature) of the anchors at words ``heads`` over the content words' positions."""
    k = np.searchsorted(content, heads, "right")
    whole = k + CHAIN <= len(content)
    heads, k = heads[whole], k[whole]
    whole = text[content[k + CHAIN - 1]] == text[heads] if len(heads) else np.zeros(0, bool)
    heads, k = heads[whole], k[whole]
    sig = hashes[heads]
    for i in range(CHAIN):
        sig = _mix(sig * _M2 + hashes[content[k + i]])
    return text[heads], (sig >> np.uint64(32)).astype(np.uint32)


def signatures(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted signature set of each text."""
    with np.errstate(over="ignore"):
        data, starts = joined(texts)
        first, hashes = word_hashes(data)
        text = np.searchsorted(starts, first, "right") - 1
        anchor = np.isin(hashes, _anchor_hashes())
        content = np.flatnonzero(~anchor)
        owner, sig = _chained(np.flatnonzero(anchor), content, hashes, text)
        bare = np.bincount(owner, minlength=len(texts)) == 0
        if bare.any():
            heads = np.flatnonzero(bare[text])
            owner2, sig2 = _chained(heads, np.arange(len(hashes)), hashes, text)
            owner, sig = np.concatenate([owner, owner2]), np.concatenate([sig, sig2])
            short = np.flatnonzero((np.bincount(owner, minlength=len(texts)) == 0) & (np.bincount(text, minlength=len(texts)) > 0))
            for i in short:
                one = np.uint64(0)
                for h in hashes[text == i]:
                    one = _mix(one * _M2 + h)
                owner, sig = np.append(owner, i), np.append(sig, np.uint32(one >> np.uint64(32)))
    both = np.unique(owner.astype(np.uint64) << np.uint64(32) | sig.astype(np.uint64))
    cut = np.searchsorted(both, np.arange(len(texts) + 1).astype(np.uint64) << np.uint64(32))
    sets = (both & np.uint64(0xFFFFFFFF)).astype("<u4")
    return [sets[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def length_partition(size: int, floor: float) -> int:
    """The partition of a set size: similarities of at least ``floor`` don't skip one."""
    return math.floor(math.log(size) / -math.log(floor)) if size and 0 < floor < 1 else 0


def likeness(a: np.ndarray, b: np.ndarray, floor: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 as soon as it cannot reach ``floor``."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if length_partition(len(large), floor) - length_partition(len(small), floor) > 1 or len(small) < floor * len(large):
        return 0.0
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    found = both / (len(a) + len(b) - both)
    return found if found >= floor else 0.0


#: Similarity of signature sets from which texts are near copies.
NEAR = 0.8


def near_partition(size: int) -> int:
    return length_partition(size, NEAR)


def packed_sets(texts: list[bytes | None]) -> list[bytes]:
    """The signature set of each text, four bytes a signature."""
    return [s.tobytes() for s in signatures([t or b"" for t in texts])]


def hashed_sets(packed: list[bytes]) -> list[np.ndarray]:
    """Packed signature sets as sorted, well mixed 64-bit hashes."""
    with np.errstate(over="ignore"):
        return [np.sort(_mix(np.frombuffer(p, "<u4").astype(np.uint64) * _BASE + _M1)) for p in packed]


#: 128 bits: links at 0.8 differ in 19 of them on average, with a deviation of 4; unrelated texts in 64, with one of 5.7.
SCHEME = Scheme(hashed_sets, packed_sets, lanes=2, radius=42, tight=20, spread=54, length_partition=near_partition)


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = NEAR) -> DataFrame:
    """``(id, t1, t2, component_id)`` of every row: the smallest id that it reaches over links of near copies.

    ``t1`` and ``t2`` are hashes of the row's text.  Texts without a word are copies of each other.
    """
    if similarity < NEAR:
        raise ValueError(f"partitions are made for similarities of {NEAR} and above")
    return near_copies(docs, id_col, text_col, SCHEME, similarity)


def as_string(signature_set: np.ndarray) -> str:
    return base64.b64encode(signature_set.tobytes()).decode()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint, sigs)`` of every row: the set as text and as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = signatures([t or b"" for t in batch.column(1).to_pylist()])
            yield pa.record_batch(
                [batch.column(0), pa.array([as_string(s) for s in sets], pa.string()), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))],
                ["id", "fingerprint", "sigs"],
            )

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(run, "id long, fingerprint string, sigs array<long>")


def _range_of(rank: Column, edges: list[int], first: int = 0) -> Column:
    """The number of edges (falling) above a rank, by a balanced tree of comparisons."""
    if not edges:
        return F.lit(first)
    mid = len(edges) // 2
    return F.when(rank < edges[mid], _range_of(rank, edges[mid + 1 :], first + mid + 1)).otherwise(_range_of(rank, edges[:mid], first))


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", told: DataFrame | None = None) -> DataFrame:
    """``(range, role, id, body, told)``: the documents in descending order of ids, each range in one partition.

    The texts are shuffled once.  A range also gets the first document of the following one
    (role 1), and the last the first of all, so every document stands beside its next one.  What is ``told``
    of documents, ``(id, t1, t2, value)``, comes as a row of its own (body null) before the documents of that id and text,
    so it is brought together with them by the same shuffle.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("rank"),
        F.coalesce(F.col(text_col), F.lit("")).alias("body"),
        F.lit(None).cast("long").alias("told"),
    ).withColumn("tie", F.xxhash64("body"))
    width = shuffle_width(spark)
    ranges = RANGES * width
    found = rows.select(F.percentile_approx("rank", [i / ranges for i in range(1, ranges)], 100 * ranges).alias("e")).first()
    edges = sorted(set((found and found["e"]) or []), reverse=True)
    here = _range_of(F.col("rank"), [int(e) for e in edges])
    rows = rows.withColumn("range", here)
    # The first document of each range; at most as many as ranges.
    heads = rows.groupBy("range").agg(F.max(F.struct("rank", "tie")).alias("h")).orderBy("range").collect()
    also = [(r["h"]["rank"], r["h"]["tie"], heads[i - 1]["range"]) for i, r in enumerate(heads)]
    firsts = spark.createDataFrame(also, "rank long, tie long, also int")
    places = F.array_compact(
        F.array(
            F.struct(F.col("range"), F.lit(0).alias("role")),
            F.when(F.col("also").isNotNull(), F.struct(F.col("also").alias("range"), F.lit(1).alias("role"))),
        )
    )
    placed = rows.join(F.broadcast(firsts), ["rank", "tie"], "left").withColumn("p", F.explode(places)).select("p.range", "p.role", "id", "body", "rank", "tie", "told")
    if told is not None:
        known = told.select(F.col("id"), F.coalesce("id", F.lit(LAST_ID)).alias("rank"), F.col("t1").alias("tie"), F.col("value").alias("told")).distinct()
        known = known.select(_range_of(F.col("rank"), [int(e) for e in edges]).alias("range"), F.lit(0).alias("role"), "id", F.lit(None).cast("string").alias("body"), "rank", "tie", "told")
        placed = placed.unionByName(known)
    return (
        placed.repartition(width, "range")
        .sortWithinPartitions("range", "role", F.desc("rank"), F.desc("tie"), F.col("body").isNotNull())
        .select("range", "role", "id", F.col("body").cast("binary").alias("body"), "told")
    )


OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, near_class long, length_partition int"
)


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns; ``near_class`` is the smallest doc_id among the near copies, ``length_partition`` that of the fingerprint."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ordered = beside_next(docs, told=similar_texts(docs).select("id", "t1", "t2", F.col("component_id").alias("value")))

    def compare(ids: list, texts: list[bytes], classes: list) -> pa.RecordBatch:
        """Rows of all documents but the last, which is there as the next of the one before."""
        plain = [t.decode("utf-8", "replace") for t in texts]
        edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(plain, plain[1:], strict=False)]
        edited = [e.encode() for e in edited]
        own, new = signatures(texts), signatures(edited)
        rows = [
            (i, len(p), hashlib.sha256(e).hexdigest(), as_string(s), as_string(x), likeness(s, x), likeness(s, following), k, near_partition(len(s)))
            for i, p, e, s, x, following, k in zip(ids, plain, edited, own, new, own[1:], classes, strict=False)
        ]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int32()]
        return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in OUT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []
        classes: list = []
        held, now, closed, near = 0, None, False, None
        for batch in batches:
            for place, role, name, body, told in zip(*(batch.column(k) for k in range(5)), strict=True):
                place, role = place.as_py(), role.as_py()
                if place != now:
                    ids, texts, classes, held, now, closed = [], [], [], 0, place, False
                if closed:
                    continue  # an equal first document of the following range
                if not body.is_valid:
                    near = told.as_py()
                    continue
                ids.append(name.as_py())
                texts.append(body.as_py())
                classes.append(near)
                held += len(texts[-1])
                closed = role == 1
                if len(texts) > 1 and (closed or held >= WORK_BYTES):
                    yield compare(ids, texts, classes)
                    ids, texts, classes, held = ids[-1:], texts[-1:], classes[-1:], len(texts[-1])

    return ordered.mapInArrow(run, OUT)
