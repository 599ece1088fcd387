"""Small tables with every odd case: nulls, empty and blank texts, ties, repeated rows, clashing extra columns."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


def rows():
    base = words(300, 1)
    near = base.split()
    near[150] = "zzzz"
    out = [
        (1, base),
        (2, base),
        (3, " ".join(near)),
        (4, base.replace(" ", "\n\t")),
        (5, ""),
        (6, None),
        (7, " \t\n "),
        (8, "one"),
        (8, "one"),
        (None, "one two three"),
        (9, "Ünïcode ß 你好 😀 " + words(20, 2)),
        (10, words(20_000, 3)),
        (11, "x" * 50_000),
        (12, "a\x0bb\x0cc\rd e"),
        (None, None),
    ]
    return [(i, t, "en", "src0", len(t or "")) for i, t in out]


def docs(spark, clash=True):
    df = spark.createDataFrame(rows(), DOCS)
    if clash:  # names that operators use inside or return
        for name in ("row_id", "row", "fp", "kept", "fingerprint", "score", "sequence_id", "key", "size", "shard", "url_length", "host"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


def no_docs(spark):
    return spark.createDataFrame([], DOCS)
