"""The pipeline's stages on their own input, and as a whole."""

import random

import corpus_pipeline
from tests.llm.helpers import table, words
from tidemark.llm import stages

SMALL = "/root/testdata/sf0.001"


def made(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n))


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "mixing", "packing"]


def test_stages_by_brute_force(spark, tmp_path):
    rng = random.Random(11)
    texts = [made(rng, 120) for _ in range(20)]
    texts += [texts[0], texts[1] + " tail", made(rng, 10), "word " * 100, "$$$ x " * 80, None, ""]
    texts += [texts[2] + "\na line that many documents share\n" + made(rng, 60), made(rng, 60) + "\nA line that many documents share "]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    folder = table(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns

    good = stages.quality_rules(spark, docs, folder)
    assert good.columns == names and {r["doc_id"] for r in good.collect()} == {*range(22), 27, 28}

    lines = stages.line_dedup(spark, good, folder).cache()
    assert lines.columns == names and lines.count() == 24
    kept = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert kept[20] == "" and kept[27].count("\n") == 1 and kept[28].count("\n") == 0
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    single = stages.simhash_near_dedup(spark, lines, folder).cache()
    sets = {i: {tuple(words(t)[k : k + 5]) for k in range(len(words(t)) - 4)} for i, t in kept.items()}
    ids = {r["doc_id"] for r in single.collect()}
    assert single.columns == names and 21 not in ids and 1 in ids
    for i in kept:
        near = [j for j in kept if j < i and (kept[i] == kept[j] or (sets[i] | sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])))]
        assert (i in ids) == (not near)

    mixed = stages.mixing(spark, single, folder).cache()
    assert mixed.columns == names and {r["doc_id"] for r in mixed.collect()} <= ids

    pieces = stages.packing(spark, mixed, folder).collect()
    per_copy = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    copies = {}
    for r in mixed.collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    for d, n in copies.items():
        assert sum(r["length"] for r in pieces if r["doc_id"] == d) == n * per_copy[d]


def test_whole(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() > 0 and {"doc_id", "start", "length", "sequence_id"} <= set(out.columns)


def test_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, table(spark, tmp_path, [])).count() == 0
