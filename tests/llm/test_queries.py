"""The operators' queries on the smallest tables: against SQL, or against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import LOWER, ODD, documents, table, words
from tests.oracle import assert_same, run_sql
from tidemark.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def texts_of(folder):
    return dict(run_sql("SELECT doc_id, text FROM documents ORDER BY 1", folder)[1])


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return table(spark, tmp_path_factory.mktemp("odd"), documents(ODD * 2 + [ODD[6]] * 3))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    table(spark, folder, [], "page_id long, url string, html string", "pages")
    return table(spark, folder, [])


def folder_of(name, odd):
    return {"small": SMALL, "odd": odd}[name]


@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"op5_warc"}))
@pytest.mark.parametrize("data", ["small", "odd"])
def test_matches_sql(spark, odd, name, data):
    folder = folder_of(data, odd)
    assert_same(QUERIES[name](spark, folder), ORACLES[name], folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("data", ["small", "odd"])
def test_op2(spark, odd, data):
    from tidemark.llm import spotsigs

    folder = folder_of(data, odd)
    texts = texts_of(folder)
    ids = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in QUERIES["op2_spotsigs"](spark, folder).collect()}
    assert sorted(got) == sorted(ids)
    by_text = {}
    for i, d in enumerate(ids):
        own, following = texts[d] or "", texts[ids[(i + 1) % len(ids)]] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = (set(spotsigs.signatures([t.encode()])[0].tolist()) for t in (own, edited, following))
        jaccard = lambda x, y: len(x & y) / len(x | y) if x or y else 1.0
        assert r["near_edited"] == pytest.approx(jaccard(a, b)) and r["near_next"] == pytest.approx(jaccard(a, c))
        by_text.setdefault(own, set()).add((r["fingerprint"], r["near_class"]))
        assert r["near_class"] <= d and got[r["near_class"]]["near_class"] == r["near_class"]
    assert all(len(prints) == 1 for prints in by_text.values())


def test_op3(spark, odd):
    folder = "/root/testdata/sf0.01"
    langs = dict(run_sql("SELECT doc_id, lang FROM documents", folder)[1])
    rows = QUERIES["op3_language_id"](spark, folder).collect()
    assert len(rows) == len(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) / len(held) > 0.97
    texts = texts_of(odd)
    for r in QUERIES["op3_language_id"](spark, odd).collect():
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, texts[r["doc_id"]] or "")))


def plain_words(text):
    """(script, UTF-8 bytes) of each run of letters, by characters."""
    from tidemark.llm.language import SCRIPTS

    out = []
    for c in text:
        c = c.lower() if "A" <= c <= "Z" or "\u00c0" <= c <= "\u00de" and c != "\u00d7" else c
        script = next((i for i, (_, *ranges) in enumerate(SCRIPTS, 1) for low, high in ranges if low <= ord(c) <= high), 0)
        if script and out and out[-1] is not None:
            out[-1] = (max(out[-1][0], script), out[-1][1] + c.encode())
        elif script:
            out.append((script, c.encode()))
        else:
            out.append(None)
    return [w for w in out if w is not None]


def plain_grams(word):
    padded = b"\0" + word + b"\0"
    return [((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 15 for a, b, c in zip(padded, padded[1:], padded[2:], strict=False)]


def test_op3_by_brute_force(spark, tmp_path):
    """Counts, log probabilities, script bars and the best path over words, text by text and word by word."""
    import random

    from tidemark.llm import language as L

    rng = random.Random(21)
    vocabulary = {"de": "der die das und Haus groß schön über Straße nicht".split(), "en": "the and house big street not over nice was with".split(), "ru": "дом и сад большие улица не над был это так".split()}
    texts = []
    for i in range(150):
        langs = rng.choices(list(vocabulary), k=rng.choice([1, 1, 2, 3]))
        texts.append((langs[0], ", ".join(" ".join(rng.choices(vocabulary[x], k=rng.randint(1, 150))) for x in langs)))
    texts += [("en", None), ("de", "12 !"), (None, "house und дом"), ("en", "Ω Ωμέγα the"), ("de", "\U00010400 \U00010401")]
    rows = [(i, t, lang, "s", len(t or "")) for i, (lang, t) in enumerate(texts)]
    folder = table(spark, tmp_path, rows)
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in rows}
    names = sorted({lang for i, _, lang, *_ in rows if lang and not held[i]})
    grams = {n: Counter() for n in names}
    scripts = {n: Counter() for n in names}
    for i, t, lang, *_ in rows:
        if lang and not held[i]:
            for script, w in plain_words(t or ""):
                scripts[lang][script] += 1
                grams[lang].update(plain_grams(w))
    total = {n: sum(grams[n].values()) for n in names}
    seen = {s: [n for n in names if scripts[n][s] > L.SCRIPT_SHARE * sum(scripts[n].values())] for s in range(L.N_SCRIPTS)}

    def score(script, w):
        log = [0.0] * len(names)
        for g in plain_grams(w):
            p = [np.log((grams[n][g] + L.SMOOTHING) / (total[n] + L.SMOOTHING * L.GRAMS)) for n in names]
            log = [a + b - sum(p) / len(p) for a, b in zip(log, p, strict=True)]
        return [x - 50 * (bool(seen[script]) and n not in seen[script]) for x, n in zip(log, names, strict=True)]

    cache = {}
    for r in QUERIES["op3_language_id"](spark, folder).collect():
        text = rows[r["doc_id"]][1] or ""
        assert r["held_out"] == held[r["doc_id"]]
        own = plain_words(text)
        if not own:
            assert (r["lang_pred"], r["score"]) == ((names[0], pytest.approx(1 / len(names))) if any(map(str.isalpha, text)) else ("und", 0.0))
            continue
        scores = [cache.setdefault(w, score(*w)) for w in own]
        state, back = [0.0] * len(names), []
        for s in scores:
            top = max(range(len(names)), key=lambda k: state[k])
            come = [top if state[k] < state[top] - L.SWITCH else k for k in range(len(names))]
            back.append(come)
            state = [state[c] - L.SWITCH * (c != k) + s[k] for k, c in enumerate(come)]
        at, labels = max(range(len(names)), key=lambda k: state[k]), []
        for come in reversed(back):
            labels.append(at)
            at = come[at]
        held_by = Counter()
        for k, (_, w) in zip(reversed(labels), own, strict=True):
            held_by[k] += len(w)
        pick = max(range(len(names)), key=lambda k: held_by[k])
        sums = [sum(s[k] for s in scores) for k in range(len(names))]
        lead = max(-30, min(30, sums[pick] - max(x for k, x in enumerate(sums) if k != pick)))
        want = held_by[pick] / sum(held_by.values()) / (1 + np.exp(-lead))
        if len([k for k, n in held_by.items() if n == held_by[pick]]) == 1:
            assert r["lang_pred"] == names[pick] and r["score"] == pytest.approx(want, abs=2e-3), text[:80]


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) < 256 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


PRIVATE = [
    "a@b.c%d@e.f x", "1.2.3.4.5.6.7.8 999.1.1.1 000255.1.1.1", "4111 1111 1111 1111 12", "4111-1111-1111-1111", "x4111111111111111y",
    "+1 (826) 555-4081 190.137.223.204", "ééé foo@bar.de é 1.1.1.1", "5--5 -5 4111111111111111", "@@a@b..c a@b.c.", "+1" + "1" * 30,
    "a" * 3000 + "@x.y", "1" * 5000, "+1 " * 50, "12345678901234567890 4111111111111111 5", "+49 30 1234567 ext", "0.0.0.0" * 9, "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7",
]


@pytest.mark.parametrize("data", ["small", "odd", "private"])
def test_op6(spark, odd, tmp_path, data):
    folder = table(spark, tmp_path, documents(PRIVATE)) if data == "private" else folder_of(data, odd)
    texts = texts_of(folder)
    rows = QUERIES["op6_pii"](spark, folder).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        spans = base_spans(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s.startswith(k) for s in spans) for k in ("email", "ip", "card", "phone")]
        every = [s for column in ("spans", "secrets") for s in r[column].split(",") if s]
        assert set(spans) <= set(every) and r["n_spans"] == len(every)
        kinds = [s.partition(":")[0] for s in every]
        assert kinds == sorted(kinds, key=["email", "ip", "card", "phone", "secret"].index)


def test_op6_finds_planted_secrets(spark):
    folder = "/root/testdata/sf0.01"
    texts = texts_of(folder)
    planted = {d: {(m.start(1), m.end(1)) for m in re.finditer(r'token = "([0-9a-f]{40})"', t or "")} for d, t in texts.items()}
    assert sum(map(bool, planted.values())) >= 10
    for r in QUERIES["op6_pii"](spark, folder).collect():
        assert {tuple(map(int, s.split(":")[1:])) for s in r["secrets"].split(",") if s} == planted[r["doc_id"]]


@pytest.mark.parametrize("data", ["small", "odd"])
def test_op8(spark, odd, data):
    folder = folder_of(data, odd)
    texts = texts_of(folder)
    rows = QUERIES["op8_sharding"](spark, folder).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op8_balances(spark):
    folder = "/root/testdata/sf0.1"
    texts = texts_of(folder)
    rows = QUERIES["op8_sharding"](spark, folder).collect()
    assert len(rows) == len(texts)
    held, sums = {}, {}
    for r in rows:
        held.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
        for k, v in (("size", r["size"]), ("tokens", r["tokens"]), ("rows", 1)):
            sums.setdefault(k, Counter())[r["shard"]] += v
    assert all(len(s) == 1 for s in held.values())
    for per_shard in sums.values():
        assert len(per_shard) == 16 and max(per_shard.values()) / min(per_shard.values()) < 1.01


@pytest.mark.parametrize("data", ["small", "odd"])
def test_op9(spark, odd, data):
    import public_tokenizers
    from tokenizers import Tokenizer

    folder = folder_of(data, odd)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in texts_of(folder).items()}
    pieces, windows, steps = {}, {}, {}
    for r in QUERIES["op9_packing"](spark, folder).collect():
        steps[r["step_group"]] = steps.get(r["step_group"], 0) + r["length"]
        pieces.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == set(want)
    for d, found in pieces.items():
        at = 0
        for r in sorted(found, key=lambda r: r["start"]):
            cut = want[d][at : at + r["length"]]
            assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, zlib.crc32(cut.tobytes()), len(want[d]))
            at += r["length"]
        assert at == len(want[d])
    for found in windows.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0
    # One group of a task is smaller, all others are equal.
    assert all(n == 65536 or n < 65536 and g + 1 not in steps for g, n in steps.items())


def majority(text):
    own = [w.translate(LOWER) for w in words(text)]
    grams = [" ".join(own[i : i + 3]) for i in range(len(own) - 2)] or [" ".join(own)] * bool(own)
    counts = Counter(b for g in grams for h in [xxhash.xxh64_intdigest(g.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in counts.items() if 2 * n > len(grams))


@pytest.mark.parametrize("data", ["small", "odd"])
def test_op10(spark, odd, data):
    folder = folder_of(data, odd)
    prints = {d: majority(t) for d, t in texts_of(folder).items()}
    above = {d: d for d in prints}

    def root(d):
        while above[d] != d:
            d = above[d]
        return d

    for a in prints:
        for b in prints:
            if b < a and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                above[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op10_simhash_near_dedup"](spark, folder).collect()}
    assert got == {d: (f"{p:016x}", root(d)) for d, p in prints.items()}
