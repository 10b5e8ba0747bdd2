"""Language identification of mixed texts.

*Learning.*  Letter trigrams (of bytes, with word edges) are counted for each language over every
labelled document that is not held out, and so are the scripts of its words.  The counts are
summed on the cluster; the table that reaches the driver has at most ``GRAMS`` rows a language.

*Prediction.*  The script of a word - from the ranges of its characters - narrows the languages that may
claim it to those seen in that script.  Each word scores its trigrams' log probabilities; Viterbi
over the words with a penalty for switching labels every word, so a text in two languages falls
into spans.  The predicted language is that of the most letters.

Viterbi is exact and runs on all texts of a group at once: texts are cut into segments, each
segment's best scores from every entry state are found in parallel, and the segments of a text are
chained before the labels are traced back.

Defined results
---------------
* null text, or no letter: ``und`` with score 0
* letters of unknown scripts only (as beyond U+FFFF): the alphabetically first language, score 1 / languages
* more than ``LANGUAGES`` labels: an error, for the table would not be bounded
* no labelled document: ``und`` everywhere
* null id: not held out and not learned from
* ties between languages: the alphabetically first
* equal rows: predicted alike
* other columns are not read
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ship
from tidemark.llm.textbytes import groups, joined, lowered, runs

GRAM_BITS = 17
GRAMS = 1 << GRAM_BITS
SMOOTHING = 0.5
#: Log-probability cost of a change of language between two words.
SWITCH = 8.0
#: A language is seen in a script if so much of its words is.
SCRIPT_SHARE = 0.02
#: Words of a segment.
SEGMENT = 128
#: Languages that one model tells apart at most; its table holds GRAMS floats for each.
LANGUAGES = 64
UNKNOWN = "und"

#: Scripts by their ranges of code points, in the order of their numbers; 0 is no letter.
SCRIPTS = (
    ("latin", (0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    ("other", (0x250, 0x36F), (0x700, 0x8FF), (0x1000, 0x10FF), (0x1200, 0x1DFF)),
    ("greek", (0x370, 0x3FF), (0x1F00, 0x1FFF)),
    ("cyrillic", (0x400, 0x52F)),
    ("armenian", (0x531, 0x58F)),
    ("hebrew", (0x591, 0x5F4)),
    ("arabic", (0x600, 0x6FF)),
    ("devanagari", (0x900, 0x97F)),
    ("indic", (0x980, 0xDFF)),
    ("thai", (0xE00, 0xE7F)),
    ("kana", (0x3040, 0x30FF)),
    ("han", (0x3400, 0x9FFF)),
    ("hangul", (0x1100, 0x11FF), (0xAC00, 0xD7AF)),
)
N_SCRIPTS = len(SCRIPTS) + 1


def _script_table() -> np.ndarray:
    """Script by the first two bytes of a character in UTF-8."""
    table = np.zeros((256, 256), np.uint8)
    for number, (_, *ranges) in enumerate(SCRIPTS, 1):
        for low, high in ranges:
            for lead, second in {tuple((chr(c).encode() + b"\0")[:2]) for c in range(low, high + 1) if not 0xD800 <= c < 0xE000}:
                if lead < 0x80:
                    table[lead, :] = number
                else:
                    table[lead, second] = number
    return table


_SCRIPT = _script_table()


class Words:
    """The words (runs of letters) of a list of texts."""

    def __init__(self, texts: list[bytes | None]):
        data, self.text_starts = joined(texts)
        self.data = lowered(data, latin=True)
        follow = np.append(self.data[1:], np.uint8(0))
        script = _SCRIPT[self.data, follow]
        tail = (self.data >= 0x80) & (self.data < 0xC0)
        known = script > 0
        for _ in range(3):  # the other bytes of a letter belong to it
            known[1:] |= tail[1:] & known[:-1]
        self.mask = known
        self.starts, self.ends = runs(known)
        self.text = np.searchsorted(self.text_starts, self.starts, "right") - 1
        self.script = np.maximum.reduceat(script, self.starts) if len(self.starts) else np.zeros(0, np.uint8)

    def grams(self, a: int, b: int) -> np.ndarray:
        """Trigram numbers at the bytes a to b; where no letter is, meaningless."""
        code = np.where(self.mask, self.data, 0)[max(a - 1, 0) : b + 1].astype(np.uint32)
        if a == 0:
            code = np.concatenate([np.zeros(1, np.uint32), code])
        if len(code) < b - a + 2:
            code = np.append(code, np.uint32(0))
        mixed = (code[:-2] << np.uint32(16) | code[1:-1] << np.uint32(8) | code[2:]) * np.uint32(2654435761)
        return (mixed >> np.uint32(32 - GRAM_BITS)).astype(np.int64)

    def scores(self, table: np.ndarray, step: int = 1 << 18) -> np.ndarray:
        """Sum of the table's rows over the trigrams of each word, some bytes at a time."""
        out = np.zeros((len(self.starts), table.shape[1]), np.float32)
        first = 0
        while first < len(self.starts):
            last = max(first + 1, int(np.searchsorted(self.starts, self.starts[first] + step)))
            a, b = int(self.starts[first]), int(self.ends[last - 1])
            rows = table[self.grams(a, b)]
            rows[~self.mask[a:b]] = 0
            out[first:last] = np.add.reduceat(rows, self.starts[first:last] - a, axis=0)
            first = last
        return out


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float = SWITCH, segment: int = SEGMENT) -> np.ndarray:
    """The best label of every word; ``counts`` has the number of words of each text in turn."""
    n_labels = scores.shape[1]
    if not len(scores):
        return np.zeros(0, np.int64)
    per_text = -(-counts // segment)
    owner = np.repeat(np.arange(len(counts)), per_text)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    begin = np.repeat(np.cumsum(counts) - counts, per_text) + rank * segment
    length = np.minimum(segment, np.repeat(counts, per_text) - rank * segment)

    def at(t: int) -> np.ndarray:
        return np.where((t < length)[:, None], scores[np.minimum(begin + t, len(scores) - 1)], np.float32(0))

    steps = int(length.max())
    entry = np.zeros((len(owner), n_labels), np.float32)
    long_texts = np.flatnonzero(per_text > 1)
    if len(long_texts):
        # Best scores of each segment from every entry state, then chained along each text.
        some = np.flatnonzero(np.isin(owner, long_texts))
        best = np.full((len(some), n_labels, n_labels), -1e9, np.float32)
        best[:, np.arange(n_labels), np.arange(n_labels)] = 0
        for t in range(steps):
            best = np.maximum(best, best.max(axis=2, keepdims=True) - np.float32(switch))
            best += at(t)[some][:, None, :]
        row = np.full(len(owner), -1)
        row[some] = np.arange(len(some))
        for r in range(1, int(per_text.max())):
            here = np.flatnonzero(rank == r)
            found = (entry[here - 1][:, :, None] + best[row[here - 1]]).max(axis=1)
            entry[here] = found - found.max(axis=1, keepdims=True)
    # Forward with back pointers, all segments at once.
    state, back = entry, np.empty((steps, len(owner), n_labels), np.uint8)
    own = np.arange(n_labels, dtype=np.uint8)[None, :]
    for t in range(steps):
        top, who = state.max(axis=1, keepdims=True), state.argmax(axis=1).astype(np.uint8)[:, None]
        change = state < top - np.float32(switch)
        back[t] = np.where(change, who, own)
        state = np.maximum(state, top - np.float32(switch)) + at(t)
    # For each exit state of a segment, the state before its first word.
    last = state.argmax(axis=1)
    seg = np.arange(len(owner))
    if len(long_texts):
        origin = np.tile(own.astype(np.int64), (len(owner), 1))
        for t in reversed(range(steps)):
            origin = np.take_along_axis(back[t], origin, 1).astype(np.int64)
        for r in reversed(range(int(per_text.max()) - 1)):
            here = np.flatnonzero((rank == r) & (per_text[owner] > r + 1))
            last[here] = origin[here + 1, last[here + 1]]
    labels, now = np.empty(len(scores), np.int64), last
    for t in reversed(range(steps)):
        live = t < length
        labels[begin[live] + t] = now[live]
        now = np.where(live, back[t, seg, now], now)
    return labels


class LanguageModel:
    def __init__(self, languages: list[str], grams: np.ndarray, scripts: np.ndarray):
        """``grams`` (GRAMS x languages) and ``scripts`` (languages x scripts) are counts."""
        self.languages = languages
        table = np.log((grams + SMOOTHING) / (grams.sum(axis=0) + SMOOTHING * GRAMS))
        self.table = (table - table.mean(axis=1, keepdims=True)).astype(np.float32)
        seen = scripts > SCRIPT_SHARE * scripts.sum(axis=1, keepdims=True)
        seen[:, ~seen.any(axis=0)] = True  # a script that no language was seen in narrows nothing
        self.barred = np.where(seen, 0, -50).astype(np.float32).T

    def predict(self, texts: list[bytes | None], with_spans: bool = False) -> list[tuple]:
        """(language, score[, spans]) of each text; spans are (start, end, language) in code points."""
        words = Words(texts)
        scores = words.scores(self.table) + self.barred[words.script]
        counts = np.bincount(words.text, minlength=len(texts))
        some = np.flatnonzero(counts)
        labels = viterbi(scores, counts[some])
        size = (words.ends - words.starts).astype(float)
        n = len(self.languages)
        held = np.bincount(words.text * n + labels, weights=size, minlength=len(texts) * n).reshape(-1, n)
        total = np.zeros((len(texts), n))
        for k in range(n):
            total[:, k] = np.bincount(words.text, weights=scores[:, k], minlength=len(texts))
        pick = held.argmax(axis=1)
        share = held.max(axis=1) / np.maximum(held.sum(axis=1), 1)
        rest = total.copy()
        rest[np.arange(len(texts)), pick] = -np.inf
        lead = total[np.arange(len(texts)), pick] - rest.max(axis=1) if n > 1 else np.full(len(texts), 30.0)
        sure = 1 / (1 + np.exp(-np.clip(lead, -30, 30)))
        out: list[tuple] = [
            (self.languages[p], float(s * u)) if c else (UNKNOWN, 0.0)
            for p, s, u, c in zip(pick, share, sure, counts, strict=True)
        ]
        # The ranges stand for letters; where they alone decide whether there is any, characters do.
        plain = (words.data >= 97) & (words.data <= 122)
        for i in np.flatnonzero(np.add.reduceat(plain.astype(np.int64), words.text_starts[:-1]) == 0) if len(texts) else ():
            letter = any(map(str.isalpha, (texts[i] or b"").decode("utf-8", "replace")))
            if not letter:
                out[i] = (UNKNOWN, 0.0)
            elif not counts[i]:
                out[i] = (self.languages[0], 1.0 / n)
        return [(*o, s) for o, s in zip(out, self._spans(words, labels, len(texts)), strict=True)] if with_spans else out

    def _spans(self, words: Words, labels: np.ndarray, n: int) -> list[list]:
        chars = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
        out: list[list] = [[] for _ in range(n)]
        for text, a, b, label in zip(words.text, words.starts, words.ends, labels, strict=True):
            base, name = chars[words.text_starts[text]], self.languages[label]
            if out[text] and out[text][-1]["lang"] == name:
                out[text][-1]["end"] = int(chars[b] - base)
            else:
                out[text].append({"start": int(chars[a] - base), "end": int(chars[b] - base), "lang": name})
        return out


def held_out(id_col: str) -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """A model of all rows of ``labelled``; None without any."""
    ship(labelled.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for a, b in groups(batch.column(0)):
                words = Words(batch.column(0)[a:b].to_pylist())
                if not len(words.starts):
                    continue
                grams = words.grams(0, len(words.data))
                names, code = np.unique(langs[a:b].astype(str), return_inverse=True)
                for k, name in enumerate(names):
                    sums.setdefault(name, np.zeros(GRAMS + N_SCRIPTS, np.int64))
                    mine = code[words.text] == k
                    sums[name][GRAMS:] += np.bincount(words.script[mine], minlength=N_SCRIPTS)
                spread = np.repeat(code[np.arange(b - a)], np.diff(words.text_starts))
                both = np.bincount(spread[words.mask] * GRAMS + grams[words.mask], minlength=len(names) * GRAMS)
                for k, name in enumerate(names):
                    sums[name][:GRAMS] += both[k * GRAMS : (k + 1) * GRAMS]
        for name, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.record_batch([pa.array([name] * len(at)), pa.array(at), pa.array(counts[at])], ["lang", "gram", "n"])

    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(text_col).cast("binary"), F.col(lang_col).cast("string").alias("lang"))
    if rows.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counts.column("lang").to_pylist()))
    if not languages:
        return None
    column = np.searchsorted(languages, np.array(counts.column("lang").to_pylist()))
    table = np.zeros((GRAMS + N_SCRIPTS, len(languages)))
    table[counts.column("gram").to_numpy(), column] = counts.column("n").to_numpy()
    return LanguageModel(languages, table[:GRAMS], table[GRAMS:].T)


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """``(id, lang, score[, spans])`` of every row."""
    ship(docs.sparkSession)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
    kinds = [pa.string(), pa.float64(), *[spans] * with_spans]
    names = ["lang", "score", *["spans"] * with_spans]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # LANGUAGES bounds its size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found: list[tuple] = []
            for a, b in groups(batch.column(1)):
                texts = batch.column(1)[a:b].to_pylist()
                found += model.predict(texts, with_spans) if model else [(UNKNOWN, 0.0, *[[]] * with_spans)] * len(texts)
            columns = [pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)]
            yield pa.record_batch([batch.column(0), *columns], ["id", *names])

    schema = "id long, lang string, score double" + ", spans array<struct<start:long,end:long,lang:string>>" * with_spans
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(run, schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = learn(docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id")))
    return identify(docs.select("doc_id", "text"), model).select(
        F.col("id").alias("doc_id"), held_out("id").alias("held_out"), F.col("lang").alias("lang_pred"), "score"
    )
