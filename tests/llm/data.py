"""Small documents with everything that can go wrong in them."""

import random

DDL = "doc_id long, text string, lang string, source string, n_chars long, kept string, g_id string, bucket int"


def texts() -> list[tuple]:
    r = random.Random(7)
    vocabulary = [a + b for a in ("th", "er", "on", "än", "é") for b in ("e", "ing", "ü", "s", "ation", "ly")]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, base = prose(70), prose(160)
    words = base.split()
    near = " ".join(words[:80] + ["CHANGED"] + words[81:])
    rows = [
        (1, prose(30) + "\n" + passage + "\t" + prose(10)),
        (2, passage),
        (3, prose(55) + " " + passage + " " + prose(5)),
        (4, base),
        (5, base),
        (6, near),
        (7, base.upper()),
        (8, None),
        (9, ""),
        (10, " \t\n "),
        (11, "a" * 300),
        (12, "b" + "a" * 260),
        (13, "word " * 400),
        (14, "word " * 130 + "end"),
        (15, "\n".join(["same line here"] * 40 + [prose(12)] * 2)),
        (16, "kurz"),
        (16, "kurz"),
        (17, base + " " + passage),
        (17, passage + " x"),
        (None, base),
        (18, prose(3000)),
        (19, "x\0y " + passage + " \x0b\x0c   wide"),
        (20, "### $$$ %%% | | |" * 20),
        (21, words[0] + " " + words[1]),
        (0, passage[: len(passage) // 2]),
    ]
    sources = ["s0", "s1", None, "s0", "é", "s0"]
    return [(i, t, None if k % 7 == 0 else "en", sources[k % 6], None if t is None else len(t), "own", "mine", k) for k, (i, t) in enumerate(rows)]


def documents(spark, rows=None):
    return spark.createDataFrame(texts() if rows is None else rows, DDL)


def words(t):
    return (t or "").encode().split()
