"""Personal data by candidate gradient boosting, in column functions alone.

1. *Generators* propose overlapping spans: the four base patterns, and wider ones that cut into or
   across them (a phone number followed by other digits, a card number within a longer run) or lie
   beyond them (phone numbers without a plus, disguised addresses, cards with other separators).
2. Every candidate gets a few discrete *features* of its writing (separators) and context
   (characters beside it, telling words before it).
3. *Boosted trees* learn from all candidates: those that are base spans against those whose
   format check fails, and announced secrets against other long runs.  Neither the check nor the
   announcement is a feature.  As features are discrete the training set is a table of counts, whose
   size the feature domains bound; it is aggregated on the cluster and the trees grow on it on
   the driver.  They come back as one arithmetic expression of ``CASE`` terms.
4. A *threshold* for each kind is calibrated on documents left out of training, to a stated precision;
   candidates above it that touch no base span are added.

Positions are code points, end exclusive.  They come from the lengths of the gaps and matches of
one left-to-right scan, so a text is never searched again for a match.

Defined results
---------------
* null text: no spans
* very long texts: patterns don't backtrack over runs, scans and choices are folds in blocks, so time
  grows with the text and the number of its candidates
* ties: of two added spans of a kind that overlap, met from the left, the higher score stays, then the
  longer, then the first
* equal ids: every row is judged by itself
* empty table: empty result, no model
* other columns are not read
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fold_map, let, staged

#: Secrets (keys, tokens) are looked for as well; they have no base pattern.
KINDS = ("email", "ip", "card", "phone", "secret")

_LOCAL = "A-Za-z0-9._%+-"
#: kind, pattern, whether it is the kind's base pattern.
#: The base patterns match what their plain forms do, from the left and without overlaps, but are
#: anchored where a run starts and keep what they have taken.
GENERATORS = (
    ("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", True),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", True),
    ("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])", True),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", True),
    ("ip", r"(?<![0-9.])[0-9]{1,4}(?:\.[0-9]{1,4}){3}(?![0-9.])", False),
    ("card", r"(?<![0-9])(?:[0-9]{16}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])", False),
    ("email", rf"(?<![{_LOCAL}])[{_LOCAL}]++\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?i:dot)[\])]\x20?)[A-Za-z0-9-]++)++", False),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\x20?[\[(](?:(?i:dot)|\.)[\])]\x20?[0-9]{1,3}){3}(?![0-9])", False),
    ("card", r"(?<![0-9])[0-9](?:[\x20./-]{0,2}[0-9]){15,18}(?![0-9])", False),
    ("phone", r"(?<![0-9+.-])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{2,5}(?:[\x20./-][0-9]{2,5}){0,4}(?![0-9])", False),
    ("phone", r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20.-]?[0-9]{3,4}){2}(?![0-9])", False),
    ("secret", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+", False),
)
#: A text without any of these has no candidate.
ANY = r"@|[\[(](?i:at)[\])]|[0-9](?:\.|\x20?[\[(](?:(?i:dot)|\.)[\])]\x20?)[0-9]|[0-9](?:[\x20./-]{0,2}[0-9]){15}|\+[0-9]|[0-9]{2}(?:\)\x20?|[\x20./-])[0-9]{2}|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16}"
#: Words that announce personal data.
TELLING = r"(?i)(?:tel|phone|call|fax|mobil|mail|contact|card|visa|iban|account|host|addr|\bip)[^0-9@]*$"
#: What announces a secret; it labels the candidates and is no feature of theirs.
ANNOUNCED = r"(?i)(?:token|secret|key|passw(?:or)?d|bearer|auth)[a-z_]{0,8}[\"']?\x20?[=:]?\x20?[\"']?$"
CONTEXT = 24

#: Figures that look like a date; none begins as the base patterns of its kind do.
DATE = r"^(?:(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2})$"

#: None of them tells whether the format check holds: it makes the labels, so trees that knew it, or the
#: number of digits, would learn nothing else.
FEATURES = ("kind", "separators", "left", "right", "telling", "writing")
#: Trees, their depth, the learning rate, and the precision that thresholds are calibrated to.
TREES, DEPTH, RATE, PRECISION = 24, 2, 0.3, 0.95
#: Of so many folds of documents one is left out of training.
FOLDS = 4


def _scan(text: Column, pattern: str) -> Column:
    """Array of (start, hit, before, after) of the matches of ``pattern``."""
    kind = "struct<start:int,hit:string,before:string,after:string>"

    def walk(hits: Column) -> Column:
        def steps(gaps: Column) -> Column:
            def step(at: Column, i: Column) -> Column:
                start = at + F.length(F.get(gaps, i))
                found = F.struct(
                    start.alias("start"),
                    F.get(hits, i).alias("hit"),
                    F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"),
                    F.left(F.get(gaps, i + 1), F.lit(1)).alias("after"),
                )
                return F.struct((start + F.length(F.get(hits, i))).alias("state"), found.alias("out"))

            return fold_map(F.sequence(F.lit(0), F.size(hits) - 1), F.lit(0), step, kind)

        return F.when(F.size(hits) == 0, F.array().cast(f"array<{kind}>")).otherwise(let(F.split(text, pattern, -1), steps))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), walk)


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return F.regexp_replace(hit, "[^0-9]+", ".").rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return let(digits, lambda d: F.length(d).between(16, 19) & _luhn(d))
    if kind == "phone":
        return F.length(digits).between(8, 15) & ~hit.rlike(DATE)
    if kind == "secret":  # letters and digits mixed, of some variety
        letters = F.array_distinct(F.filter(F.split(hit, ""), lambda c: c != ""))
        return hit.rlike("[0-9].*[0-9].*[0-9]") & hit.rlike("[A-Za-z].*[A-Za-z].*[A-Za-z]") & (F.size(letters) >= 8)
    return F.lit(True)


def _beside(char: Column) -> Column:
    """0 nothing, 1 white space, 2 other, 3 letter or digit."""
    return (
        F.when(char == "", 0).when(char.rlike(r"^[\x20\x09-\x0D]$"), 1).when(char.rlike(r"^[\p{L}\p{N}]$"), 3).otherwise(2)
    )


def _candidate(kind: str, base: bool, m: Column) -> Column:
    hit = m["hit"]
    valid = _valid(kind, hit)
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"),
        m["start"].alias("start"),
        (m["start"] + F.length(hit)).alias("end"),
        (valid if base else F.lit(False)).alias("base"),
        valid.cast("int").alias("valid"),
        F.when(hit.rlike(r"[\x20()]"), 2).when(hit.rlike(r"[.-]"), 1).otherwise(0).alias("separators"),
        _beside(F.right(m["before"], F.lit(1))).alias("left"),
        _beside(m["after"]).alias("right"),
        m["before"].rlike(TELLING).cast("int").alias("telling"),
        F.when(hit.rlike("^[0-9]+$"), 0).when(hit.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), 1).when(hit.rlike("[a-z].*[A-Z]|[A-Z].*[a-z]"), 2).otherwise(3).alias("writing"),
        (m["before"].rlike(ANNOUNCED) & F.lit(kind == "secret")).alias("announced"),
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fold, spans)``: every document with the spans that any generator proposes."""
    text = F.col("body")
    proposed = lambda kind, pattern, base: F.transform(_scan(text, pattern), lambda m: _candidate(kind, base, m))
    found = [proposed(*generator) for generator in GENERATORS]
    none = F.filter(found[0], lambda _: F.lit(False))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).select(
        "id",
        F.pmod(F.xxhash64("id"), F.lit(FOLDS)).alias("fold"),
        F.when(text.rlike(ANY), F.concat(*found)).otherwise(none).alias("spans"),
    )


# ---------------------------------------------------------------- boosted trees over counts


def _with_twins(spans: DataFrame) -> DataFrame:
    """``spans`` with the array sorted and each span told whether it equals a base span (``twin``).

    Equal spans stand side by side, the base span first, so one fold sees them all.
    """
    none = F.struct(*[F.lit(-1).alias(c) for c in ("kind", "start", "end")])
    fields = ("kind", "start", "end", "base", "valid", "announced", *FEATURES[1:])
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), (~s["base"]).alias("added"), s.alias("s"))))

    def step(last: Column, x: Column) -> Column:
        here = F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
        twin = x["s"]["base"] | (here == last)
        out = F.struct(*[x["s"][c].alias(c) for c in fields], twin.alias("twin"))
        return F.struct(F.when(twin, here).otherwise(none).alias("state"), out.alias("out"))

    kind = "struct<kind:int,start:int,end:int,base:boolean,valid:int,announced:boolean," + ",".join(f"{f}:int" for f in FEATURES[1:]) + ",twin:boolean>"
    return spans.withColumn("spans", let(order, lambda xs: fold_map(xs, none, step, kind)))


def _labelled(spans: DataFrame) -> list[Row]:
    """Counts by features, label and fold: at most the product of the feature domains."""
    rows = _with_twins(spans).select("fold", F.explode("spans").alias("s")).select(
        (F.col("fold") == 0).alias("held"),
        "s.valid",
        *[F.col(f"s.{f}") for f in FEATURES],
        (F.col("s.twin") | ((F.col("s.valid") == 1) & F.col("s.announced"))).alias("positive"),
    )
    # A valid span that is no base span is what the model shall judge: it has no label.  Secrets have no
    # base pattern: those announced are set against those that are not.
    secret = KINDS.index("secret")
    return rows.where((F.col("positive")) | (F.col("valid") == 0) | (F.col("kind") == secret)).groupBy("held", "positive", *FEATURES).count().collect()


class Boosted:
    """Additive regression trees for a logistic loss; each tree is (feature, cut, left, right) or a leaf."""

    def __init__(self, trees: list, bias: float, thresholds: dict[int, float]):
        self.trees, self.bias, self.thresholds = trees, bias, thresholds

    @classmethod
    def fit(cls, rows: list[Row]) -> Boosted | None:
        if not any(r["positive"] for r in rows):
            return None
        x = np.array([[r[f] for f in FEATURES] for r in rows])
        y = np.array([float(r["positive"]) for r in rows])
        n = np.array([float(r["count"]) for r in rows])
        held = np.array([r["held"] for r in rows])
        w = np.where(held, 0.0, n)
        share = (w @ y + 1) / (w.sum() + 2)
        bias, trees = math.log(share / (1 - share)), []
        score = np.full(len(rows), bias)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = cls._grow(x, w * (y - p), w * p * (1 - p), np.ones(len(rows), bool), DEPTH)
            trees.append(tree)
            score += cls._apply(tree, x)
        p, thresholds = 1 / (1 + np.exp(-score)), {}
        for kind in range(len(KINDS)):
            mine = (x[:, 0] == kind) & held
            for cut in sorted(set(p[mine & (y == 1)])):
                above = mine & (p >= cut)
                if cut >= 0.5 and n[above] @ y[above] >= PRECISION * n[above].sum():
                    thresholds[kind] = float(cut)
                    break
        return cls(trees, bias, thresholds)

    @classmethod
    def _grow(cls, x: np.ndarray, g: np.ndarray, h: np.ndarray, here: np.ndarray, depth: int):
        value = lambda m: RATE * g[m].sum() / (h[m].sum() + 1)
        gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        best = (1e-9, None, None)
        for f in range(x.shape[1]) if depth else ():
            for cut in np.unique(x[here, f])[:-1]:
                low = here & (x[:, f] <= cut)
                won = gain(low) + gain(here & ~low) - gain(here)
                if won > best[0]:
                    best = (won, f, int(cut))
        if best[1] is None:
            return float(value(here))
        low = here & (x[:, best[1]] <= best[2])
        return best[1], best[2], cls._grow(x, g, h, low, depth - 1), cls._grow(x, g, h, here & ~low, depth - 1)

    @classmethod
    def _apply(cls, tree, x: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        f, cut, low, high = tree
        return np.where(x[:, f] <= cut, cls._apply(low, x), cls._apply(high, x))

    def score(self, s: Column) -> Column:
        """The probability of a candidate struct, as an expression."""

        def term(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            f, cut, low, high = tree
            return F.when(s[FEATURES[f]] <= cut, term(low)).otherwise(term(high))

        total = reduce(lambda a, b: a + b, map(term, self.trees), F.lit(self.bias))
        return 1 / (1 + F.exp(-total))

    def accepts(self, s: Column, score: Column) -> Column:
        out = F.lit(False)
        for kind, cut in self.thresholds.items():
            out = out | ((s["kind"] == kind) & (score >= cut - 1e-9))
        return out


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, base, added)``: arrays of ``(kind, start, end)``, sorted; kinds as numbered in ``KINDS``."""
    spans = staged(candidates(docs, id_col, text_col), "spans")
    model = Boosted.fit(_labelled(spans))
    bare = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    base = F.array_sort(F.transform(F.filter("spans", lambda s: s["base"]), bare))
    if model is None:
        return spans.select("id", base.alias("base"), F.filter(base, lambda _: F.lit(False)).alias("added"))

    scored = F.transform(
        F.filter("spans", lambda s: ~s["base"] & (s["valid"] == 1)),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), model.score(s).alias("score")),
    )
    accepted = F.filter(scored, lambda s: model.accepts(s, s["score"]))
    found = spans.select("id", base.alias("base"), accepted.alias("accepted"))
    none = F.filter("base", lambda _: F.lit(False))
    return found.select("id", "base", F.when(F.size("accepted") == 0, none).otherwise(let(_clear_of(F.col("accepted"), F.col("base")), _best)).alias("added"))


_FAR = 2**31 - 1
_SCORED = "struct<kind:int,start:int,end:int,score:double>"


def _clear_of(spans: Column, base: Column) -> Column:
    """The spans that touch no base span: a fold from the left and one from the right over both, sorted."""
    one = lambda s, is_base, score: F.struct(s["start"].alias("start"), (~is_base).alias("added"), s["end"].alias("end"), s["kind"].alias("kind"), score.alias("score"))
    both = F.array_sort(F.concat(
        F.transform(base, lambda s: one(s, F.lit(True), F.lit(0.0))), F.transform(spans, lambda s: one(s, F.lit(False), s["score"]))
    ))
    kind = "struct<start:int,added:boolean,end:int,kind:int,score:double>"
    skip = F.lit(None).cast(kind)

    def from_left(reach: Column, x: Column) -> Column:  # base spans come first among those of one start
        touched = x["added"] & (x["start"] < reach)
        return F.struct(F.when(x["added"], reach).otherwise(F.greatest(reach, x["end"])).alias("state"), F.when(touched, skip).otherwise(x).alias("out"))

    def from_right(first: Column, x: Column) -> Column:
        touched = x["added"] & (x["end"] > first)
        return F.struct(F.when(x["added"], first).otherwise(x["start"]).alias("state"), F.when(touched, skip).otherwise(x).alias("out"))

    present = lambda xs: F.filter(xs, lambda x: x.isNotNull())
    left = let(both, lambda xs: present(fold_map(xs, F.lit(0), from_left, kind)))
    clear = let(F.reverse(left), lambda xs: present(fold_map(xs, F.lit(_FAR), from_right, kind)))
    return F.transform(F.filter(clear, lambda x: x["added"]), lambda x: F.struct(*[x[c].alias(c) for c in ("kind", "start", "end", "score")]))


def _best(spans: Column) -> Column:
    """Of spans of a kind that overlap, met from the left, the better stays: by score, length, place."""
    end = F.transform(
        F.array(*[F.lit(k) for k in range(len(KINDS) + 1)]),
        lambda k: F.struct(k.alias("kind"), F.lit(_FAR).alias("start"), F.lit(_FAR).alias("end"), F.lit(0.0).alias("score")),
    )
    nothing = F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0.0).alias("score"))
    rank = lambda s: F.struct(s["score"], s["end"] - s["start"], -s["start"])

    def step(best: Column, x: Column) -> Column:
        apart = (x["kind"] != best["kind"]) | (x["start"] >= best["end"])
        done = F.when(apart & (best["kind"] >= 0) & (best["start"] < _FAR), best)
        return F.struct(F.when(apart | (rank(x) > rank(best)), x).otherwise(best).alias("state"), done.alias("out"))

    kept = let(F.array_sort(F.concat(spans, end)), lambda xs: fold_map(xs, nothing, step, _SCORED))
    return F.transform(F.filter(kept, lambda s: s.isNotNull()), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def span_text(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``find_personal_data`` replaced by its kind in brackets.

    Overlapping spans are replaced as one, under the kind of the first.
    """
    names = F.array(*map(F.lit, KINDS))

    def cut(t: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            inside = s["start"] < acc["at"]
            kept = F.substring(t["text"], acc["at"] + 1, s["start"] - acc["at"])
            return F.struct(
                F.greatest(acc["at"], s["end"]).alias("at"),
                F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], kept, F.lit("["), F.get(names, s["kind"]), F.lit("]"))).alias("out"),
            )

        return F.aggregate(t["spans"], zero, step, lambda acc: F.concat(acc["out"], F.substring(t["text"], acc["at"] + 1, F.length(t["text"]))))

    by_start = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    found = spans.select(F.col("id").alias("_pii_id"), by_start.alias("_pii"))
    new = let(F.struct(F.col(text_col).alias("text"), F.col("_pii").alias("spans")), cut)
    joined = docs.join(found, docs[id_col].eqNullSafe(found["_pii_id"]), "left")
    return joined.select(
        *[F.when(F.size("_pii") > 0, new).otherwise(docs[c]).alias(c) if c == text_col else docs[c] for c in docs.columns]
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns; ``secrets`` are the added spans of keys and tokens, ``n_spans`` counts all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    secret = KINDS.index("secret")
    found = find_personal_data(docs).select("id", "base", F.array_sort(F.concat("base", "added")).alias("every"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS) if i != secret],
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.filter("every", lambda s: s["kind"] != secret)).alias("spans"),
        span_text(F.filter("every", lambda s: s["kind"] == secret)).alias("secrets"),
        F.size("every").cast("long").alias("n_spans"),
    )
