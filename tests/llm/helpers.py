"""Small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, letters="abcdefgh é"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))


def mixed_texts(seed=3, n=60):
    """Texts with shared passages, exact and near copies, and odd ones."""
    rng = random.Random(seed)
    shared = [prose(rng, rng.randint(70, 160)) for _ in range(5)]
    texts = []
    for _ in range(n):
        t = prose(rng, rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            q = rng.choice(shared)
            a = rng.randint(0, len(q) // 2)
            q = q[a : rng.randint(a, len(q))]
            if rng.random() < 0.4:
                k = rng.randint(0, max(0, len(q) - 1))
                q = q[:k] + "X" + q[k + 1 :]
            t += q + "\n" + prose(rng, rng.randint(0, 30))
        texts.append(t)
    return texts + [None, "", " \n\t ", "one", "a" * 2000, "a" * 399, "ab" * 500, "b" * 400, texts[3], texts[3], texts[5].upper()]


def long_text(seed=9, n=60_000):
    return prose(random.Random(seed), n)


def documents(spark, texts, parts=3):
    rows = [(i, t, ("en", None, "fr")[i % 3], f"s{i % 4}" if i % 5 else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(parts)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
