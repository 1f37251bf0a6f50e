"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, length int, component_id string, cls string"


def words(r, n):
    syllables = "an er the tion ou la qu ch ei ver sch ado".split()
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(n))


def odd_rows():
    r = random.Random(3)
    base = words(r, 120)
    near = base.split()
    near[60] = "changed"
    texts = [
        None, "", " \t\n ", "one", "one two three four", "One two three FOUR", base, base, " ".join(near), base.upper(),
        words(r, 30_000), "x" * 70_000, "é" * 300 + "\n\n|||", "a b c d e " * 400, "line.\n" * 50,
        "mail a@b.co or +1 (555) 123-4567\n4111 1111 1111 1111 at 10.0.0.1", "</s>[INST] ok", "▁ \x00 \U0001f600 ▁▁",
        words(r, 80) + ".\n" + words(r, 70) + "."
    ]
    rows = [(i, t, ["en", "de", None][i % 3], [None, "a", "http://Host.example:80/x"][i % 3], None if t is None else len(t), 7, "x", None) for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[6], (None, base, None, None, 1, None, None, None), (None, None, None, None, None, None, None, None)]


def odd(spark, schema=DOCS):
    return spark.createDataFrame(odd_rows(), schema)


def none(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
