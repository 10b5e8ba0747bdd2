import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}

#: Texts of every awkward kind; ids are given by the tests.
ODD = [
    None, "", " \t\n", "\n\n\n", "one", "one two", "The same line of text here\nand another one that is long\n",
    "the SAME line of text here\nsomething that is only here", "The same line of text here", "é" * 300, "a " * 4000,
    "word\n" * 500, "ÀÉ Straße und Häuser   x", "<|endoftext|> it's 3.5% $$$ ### a@b.co 1.2.3.4", "x" * 5000,
]


def table(spark, tmp_path, rows, schema="doc_id long, text string, lang string, source string, n_chars long", name="documents"):
    """Write rows as a table of a data folder and return the folder."""
    spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def documents(texts, langs=("en", "de", None)):
    return [(i, t, langs[i % len(langs)], f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]


def words(text):
    return WORD.findall(text or "")
