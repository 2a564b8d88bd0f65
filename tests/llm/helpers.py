from __future__ import annotations

import os
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

ODD = [
    (900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "two words"), (905, "three short words"), (905, "three short words"),
    (906, "ÄÖ ñ é́ 𝒳 word"), (907, "a b c d e f g h " * 60), (908, "long " * 30_000),
]


def documents(spark, rows, source=lambda i: f"src{i % 3}"):
    """A documents table of (doc_id, text) rows."""
    data = [(i, t, "en", source(i) if i is not None else None, None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(data, DOCS)


def folder(spark, path, rows, **more):
    """A data folder with these documents and further tables."""
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    for name, df in more.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" + r.choice(["", "", ",", "."]) for _ in range(n))


def edited(text, seed, share):
    r = random.Random(seed)
    w = text.split(" ")
    for k in range(len(w)):
        if r.random() < share:
            w[k] = f"x{r.randrange(10**6)}"
    return " ".join(w)


def have(path):
    return os.path.exists(path)
