"""A small corpus with every awkward row at once, and plain helpers to check against."""

import re

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use inside
    *[T.StructField(c, T.StringType()) for c in ("id", "k", "h", "node", "line", "n", "ids", "score", "n_lines", "kept_text")]])
EXTRA = ("x",) * 10


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(seed, n):
    """Seeded invented words, no two alike soon."""
    out, state = [], seed * 7919 + 17
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append("".join("abcdefghijklmnopqrstuvwxyz"[(state >> s) % 26] for s in (3, 7, 11, 15, 19)))
    return out


def rows():
    shared = " ".join(prose(5, 50))
    base = prose(9, 120)
    near = [*base[:60], "changed", *base[61:]]
    return [
        (1, " ".join(prose(1, 40)) + "\n" + shared + "\n" + " ".join(prose(2, 9)), "en", "a"),
        (2, shared + "\t" + " ".join(prose(3, 60)), "en", "a"),
        (3, " ".join(base), "en", "b"),
        (4, " ".join(near), "en", "b"),
        (5, " ".join(base), "de", None),
        (6, None, None, "a"),
        (7, "", "en", "b"),
        (8, " \n\t ", None, None),
        (9, "one two", "en", "a"),
        (9, "one two", "en", "a"),
        (10, "é🙂 ÀÉ\x85x y Straße ΑΣ <|endoftext|> it's 1234 İ", "fr", "b"),
        (None, " ".join(prose(11, 45)), "en", "b"),
        (None, None, None, None),
        (12, " ".join(prose(12, 5000)), "en", "c"),
        (13, "\n".join(["the same line here again and again"] * 3 + ["the same line here again and agaim", "short", "shart"]), "en", "c"),
        (14, "a " * 200, "en", "c"),
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *EXTRA) for i, t, lang, s in rows()], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
