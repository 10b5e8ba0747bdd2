"""Hierarchical multi-length packing of tokenised documents.

Documents are routed by length to context-size tiers, each a power of two.  A tier's documents
are packed into windows of its size by best fit; what room is left in a long window is filled
with documents of the shorter tiers, the last of them cut to fit.  At the end of a task the
documents that fill no window of their own are chained and cut into windows of falling powers
of two, so no window needs padding.  Windows are dealt to *step groups* of exactly the same number
of tokens (but for the last of a task, which is smaller); each group gets its share of every
window size.

Tokens are made and packed in one pass over a bounded number of documents at a time: nothing is
shuffled, ids never leave the task that made them, and the windows of a task depend on its input
rows alone, so a lost task is repeated alike.

Defined results
---------------
* null or empty text: the end id alone
* a document longer than the largest tier: whole largest windows first, the rest by its length
* a special token spelled out in a text: that token's id, as the tokenizer gives it
* null or repeated ids: every row is packed as a document of its own
* equal lengths: in the order of the rows
* empty table: empty result
* other columns are not read
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ship

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
TIERS = (256, 512, 1024, 2048)
#: Tokens of one step group.
STEP_TOKENS = 65536
#: Documents whose tokens a task holds at once, and their bytes of text.
WINDOW_DOCS = 4000
WINDOW_BYTES = 16 << 20
#: Words whose ids a Python worker remembers before it starts anew, and the longest of them in bytes.
CACHE_WORDS, CACHE_BYTES = 600_000, 64


class WordIds(dict):
    """Token ids of single words as little-endian unsigned 32-bit bytes, made when first asked for.

    The tokenizer drops white space before anything else looks at the text, so the ids of a
    text are those of its words in a row.  Words of letters go to the BPE model directly.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        #: Spelled-out special tokens may span words, so a text with one is encoded whole.
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        #: Characters that stand for bytes in byte-level vocabularies.
        self.letters = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _direct(self, word: str) -> list[int] | None:
        """Ids of one run of letters without the regular expressions, or None if unsure."""
        if not word.isalpha():
            return None
        if word.isascii():
            return [t.id for t in self.model.tokenize(word)]
        if "Σ" in word or "İ" in word or not unicodedata.is_normalized("NFC", word):
            return None
        low = word.lower()
        if not low.isalpha():
            return None
        return [t.id for t in self.model.tokenize(low.encode().decode("latin-1").translate(self.letters))]

    def __missing__(self, word: bytes) -> bytes:
        # A lone mark after an ASCII letter or digit is a piece of its own; in a run of marks it is not.
        if word[-1:] in b".," and word[-2:-1].isalnum():
            ids = self[word[:-1]] + self[word[-1:]]
        else:
            ids = self.whole(word)
        if len(word) <= CACHE_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def whole(self, text: bytes) -> bytes:
        """Ids of a text that is not cut any further."""
        plain = text.decode("utf-8", "replace")
        found = self._direct(plain)
        if found is None:
            found = self.tokenizer.encode(plain, add_special_tokens=False).ids
        return np.array(found, "<u4").tobytes()


_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The cache of this Python worker, which keeps it from task to task."""
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def encode(text: bytes | None, words: WordIds) -> bytes:
    """Ids of a text, then the end id; A-Z is lowered first as the tokenizer would."""
    end = END_ID.to_bytes(4, "little")
    if not text:
        return end
    if any(token in text for token in words.special):
        return words.whole(text) + end
    return b"".join(map(words.__getitem__, text.lower().split())) + end


def count_ids(text: bytes | None, words: WordIds) -> int:
    """The number of ids that ``encode`` gives."""
    if text and any(token in text for token in words.special):
        return len(words.whole(text)) // 4 + 1
    return sum(map(len, map(words.__getitem__, text.lower().split()))) // 4 + 1 if text else 1


Piece = tuple[int, int, int]  # document, start, length


class Packer:
    """Packs documents by their lengths alone; knows nothing of ids."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tiers

    def window(self, lengths: list[int], last: bool) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
        """Full windows as (size, pieces), and the pieces left for the next call.

        With ``last`` nothing is left: what remains is cut into windows of powers of two.
        """
        largest, full = self.tiers[-1], []
        shelves: list[list[Piece]] = [[] for _ in self.tiers]
        for doc, n in enumerate(lengths):
            at = 0
            while n - at >= largest:
                full.append((largest, [(doc, at, largest)]))
                at += largest
            if n > at:
                shelves[bisect_left(self.tiers, n - at)].append((doc, at, n - at))
        spare: list[Piece] = []
        for tier in reversed(range(len(self.tiers))):
            bins = self._best_fit(shelves[tier], self.tiers[tier])
            for room, pieces in bins:
                room = self._fill(pieces, room, shelves[:tier])
                if room:
                    spare.extend(pieces)
                else:
                    full.append((self.tiers[tier], pieces))
        chained, rest = self._chain(spare, last)
        return full + chained, rest

    @staticmethod
    def _best_fit(pieces: list[Piece], size: int) -> list[tuple[int, list[Piece]]]:
        """Best fit of falling lengths: each piece goes where the least room is left."""
        rooms: list[tuple[int, int]] = []
        bins: list[list[Piece]] = []
        for piece in sorted(pieces, key=lambda p: -p[2]):
            i = bisect_left(rooms, (piece[2], -1))
            if i < len(rooms):
                room, k = rooms.pop(i)
                bins[k].append(piece)
                insort(rooms, (room - piece[2], k))
            else:
                bins.append([piece])
                insort(rooms, (size - piece[2], len(bins) - 1))
        return [(room, bins[k]) for room, k in sorted(rooms)]

    @staticmethod
    def _fill(pieces: list[Piece], room: int, shorter: list[list[Piece]]) -> int:
        """Fill a window's room from shorter tiers, longest first; the last piece is cut."""
        for shelf in reversed(shorter):
            while room and shelf:
                doc, start, n = shelf.pop()
                took = min(n, room)
                pieces.append((doc, start, took))
                room -= took
                if took < n:
                    shelf.append((doc, start + took, n - took))
        return room

    def _chain(self, spare: list[Piece], last: bool) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
        """Cut a chain of pieces into largest windows, and with ``last`` into smaller ones."""
        total, largest, sizes = sum(p[2] for p in spare), self.tiers[-1], []
        while total >= largest:
            sizes.append(largest)
            total -= largest
        if last:
            sizes += [1 << b for b in reversed(range(largest.bit_length())) if total >> b & 1]
        out, queue = [], list(reversed(spare))
        for size in sizes:
            room, pieces = size, []
            while room:
                doc, start, n = queue.pop()
                took = min(n, room)
                pieces.append((doc, start, took))
                room -= took
                if took < n:
                    queue.append((doc, start + took, n - took))
            out.append((size, pieces))
        return out, list(reversed(queue))


def deal(sizes: list[int], budget: int, last: bool) -> list[int]:
    """The step group of each window: 0 and on for groups of exactly ``budget`` tokens, -1 for what is left.

    Sizes are powers of two that divide the budget.  Windows are taken by falling size, each into the
    group whose share of room is largest, so every group (and what is left) gets its part of
    every size; room stays a multiple of the size at hand, so the groups fill up exactly.  With
    ``last`` what is left is a group of its own.
    """
    groups, over = divmod(sum(sizes), budget)
    rest = groups if last else -1
    out = [rest] * len(sizes)
    room = [(-1.0, k, budget) for k in range(groups)]
    spare, whole = over, max(over, 1)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        # The heap's first group has the largest share of room among the full-size ones.
        if room and (-room[0][0] >= spare / whole or spare < sizes[i]):
            _, k, left = heappop(room)
            out[i], left = k, left - sizes[i]
            if left:
                heappush(room, (-left / budget, k, left))
        else:
            spare -= sizes[i]
    return out


SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier long, step_group long"
)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece: its document, place in it, checksum, window, place there, tier, step group.

    ``with_ids`` adds the ids themselves.  ``sequence_id`` and ``step_group`` count within a
    task, whose number is their upper half.
    """
    if step_tokens % tiers[-1]:
        raise ValueError("a step group holds a whole number of the largest windows")
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = word_ids(tokenizer_path), Packer(tiers)
        task = TaskContext.get().partitionId() << 40
        names: list = []
        parts: list[tuple[bytes, int, int]] = []  # ids, tokens before them in the document, its tokens
        waiting: list[tuple[int, list[list]]] = []  # windows of no step group yet: size, rows
        held, sequence, step = 0, 0, 0
        kinds = [pa.int64()] * 9 + [pa.list_(pa.int32())] * with_ids
        labels = [c.split()[0] for c in schema.split(", ")]

        def flush(last: bool) -> pa.RecordBatch | None:
            nonlocal names, parts, held, sequence, step, waiting
            windows, rest = packer.window([len(ids) // 4 for ids, _, _ in parts], last)
            for size, pieces in windows:
                offset, rows = 0, []
                for doc, start, n in pieces:
                    ids, before, total = parts[doc]
                    cut = ids[4 * start : 4 * (start + n)]
                    row = [names[doc], before + start, n, zlib.crc32(cut), total, task + sequence, offset, size, 0]
                    if with_ids:
                        row.append(np.frombuffer(cut, "<u4").astype(np.int32))
                    rows.append(row)
                    offset += n
                waiting.append((size, rows))
                sequence += 1
            left = [(names[d], (parts[d][0][4 * s : 4 * (s + n)], parts[d][1] + s, parts[d][2])) for d, s, n in rest]
            names, parts, held = [x for x, _ in left], [y for _, y in left], 0
            group = deal([size for size, _ in waiting], step_tokens, last)
            out: list[list] = [[] for _ in labels]
            for g, (_, rows) in zip(group, waiting, strict=True):
                for row in rows if g >= 0 else ():
                    row[8] = task + step + g
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            waiting = [w for g, w in zip(group, waiting, strict=True) if g < 0]
            step += max(group, default=-1) + 1
            return pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], labels) if out[0] else None

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py(), words)
                names.append(name)
                parts.append((ids, 0, len(ids) // 4))
                held += len(ids)
                if len(parts) >= WINDOW_DOCS or held >= WINDOW_BYTES:
                    found = flush(False)
                    if found:
                        yield found
        if (parts or waiting) and (found := flush(True)):
            yield found

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(run, schema)


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the installed vocabulary file is, on every machine alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, tokenizer_path())
