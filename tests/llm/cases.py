"""Rows that every operator has to stand: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __id string, __text int, chunk string, __h int, n int"


#: Two words that every polynomial hash modulo 2**64 with an odd base takes for one: this, and it with a and b exchanged.
THUE_MORSE = "".join("ab"[i.bit_count() & 1] for i in range(1024))
NINETEEN = [f"k{i}" for i in range(19)]


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def edge_docs(seed=3, n=60):
    """(doc_id, text, lang, source) with planted copies, repeats and odd rows."""
    rng = random.Random(seed)
    rows = [(i, " ".join(words(rng, rng.randrange(1, 120))), rng.choice(["en", "fr", None]), rng.choice(["a", "b"])) for i in range(n)]
    passage = " ".join(words(rng, 60))
    base = words(rng, 200)
    near = list(base)
    near[50] = "changed"
    rows += [
        (100, None, "en", "a"), (101, "", None, None), (102, " \n\t ", "en", "a"), (None, "a text without number " * 5, "en", "a"), (None, None, None, None),
        (103, " ".join(base), "en", "a"), (104, "  ".join(base), "en", "a"), (105, " ".join(near), "fr", "b"), (105, " ".join(near), "fr", "b"),
        (106, "head one " + passage + " tail", "en", "a"), (107, "another start\n" + passage, "en", "b"), (108, "one two", "en", "a"), (109, "one two", "en", "a"),
        (110, "x" * 50_000 + " " + " ".join(words(rng, 30_000, 5000)), "en", "a"), (111, "Größe İ ß\u00a0naïve 🙂 e\u0301 \ud7ff \x1c end", "de", "b"), (112, "same same same same same same same same same same same same", "en", "a"),
        (114, THUE_MORSE, "en", "a"), (115, THUE_MORSE.translate({97: 98, 98: 97}), "en", "a"), (116, " ".join([*NINETEEN, THUE_MORSE]), "en", "a"), (117, " ".join([*NINETEEN, THUE_MORSE.translate({97: 98, 98: 97})]), "en", "a"),
        (113, "line one is here\nline one is here\n\nother ###%% line|<b>", "en", "a"),
    ]
    return rows


def frame(spark, rows):
    """The rows with clashing extra columns, in three partitions."""
    full = [(*r, len(r[1]) if r[1] else None, "x", 1, "c", 2, 3) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)
