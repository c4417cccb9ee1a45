"""Small awkward tables for the operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string, key long"


def word(rng: random.Random) -> str:
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))


def prose(rng: random.Random, n: int) -> list[str]:
    return [word(rng) for _ in range(n)]


def awkward(spark, more: list[str] = ()):
    """Null ids, texts and sources, empty, blank and very long texts, ties, repeated rows, clashing columns."""
    rng = random.Random(3)
    base = prose(rng, 120)
    near = [*base[:60], "changed", *base[61:]]
    long = " ".join(prose(rng, 30_000))
    texts = [
        " ".join(base), " ".join(near), "  ".join(base) + "\n", " ".join(base), "", "   \t\n", None, "one two", "One  two", "é" * 700,
        long, "a" * 5_000, "🙂 wörter ▁ mit   Zeichen\x0b\x0c\r\n ende", " ".join(prose(rng, 200)), *more,
    ]
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, None if t is None else len(t), None, "x", 5) for i, t in enumerate(texts)]
    rows += [rows[0], rows[13], (None, "null id text with several words in it", None, "s1", 3, True, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df, *columns):
    """Rows as comparable tuples, in order."""
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)
