"""Small inputs that every operator must take."""

import random

from pyspark.sql import types as T

# names that operators use themselves
CLASHING = ("size", "score", "kept", "fp", "row", "key", "range", "target", "slot", "line", "ids", "source_size", "n_words",
            "tie", "c1", "next", "first", "leaf", "position", "copies", "component_id", "fingerprint")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                       *(T.StructField(c, T.StringType()) for c in CLASHING)])
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so", "té", "vu", "xi") for b in ("", "n", "ra", "st", "lo", "ß", "t9")]


def prose(rnd: random.Random, n: int) -> str:
    out, line = [], []
    for _ in range(n):
        line.append(rnd.choice(WORDS))
        if rnd.random() < 0.08:
            out.append(" ".join(line).capitalize() + ".")
            line = []
    return "\n".join([*out, " ".join(line) + "."])


def texts(seed: int = 7) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars) with nulls in any column, empty
    and long texts, ties, copies, near copies and repeated rows."""
    rnd = random.Random(seed)
    rows = [(k, prose(rnd, rnd.choice((3, 60, 90, 150, 300))), rnd.choice(("en", "fr", None)),
             rnd.choice(("a", "b", "b", "b", "c", None)), 1) for k in range(60)]
    copy, near = rows[5][1], rows[6][1].split(" ")
    rows += [(100 + k, copy, "en", "b", None) for k in range(12)]
    rows += [(200 + k, " ".join([*near[:-2], f"{rnd.choice(WORDS)}", near[-1]]), "en", "c", 5) for k in range(8)]
    rows += [(300, "", "en", "a", 0), (301, None, None, None, None), (302, " \n\t ", "en", "b", 3), (303, "one", "en", "b", 3),
             (304, "same same same same same same same same", "en", "a", 9), (305, "x" * 70_000, "en", "b", 70_000),
             (306, prose(rnd, 20_000), "en", "b", 1), (None, "Without an id.\nAnd more.", "en", "b", 1), (None, None, "en", "b", 1),
             (-5, "A negative id, with enough words to be told apart.", "en", "b", 1), (1 << 60, copy, "en", "b", 1),
             (307, "emoji 😀 and ▁ sign\x00 zero", "en", "b", 1), (rows[9][0], rows[9][1], *rows[9][2:]), rows[10], rows[10]]
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(*r, *("clash" for _ in CLASHING)) for r in rows], SCHEMA)


def as_bag(rows) -> list:
    return sorted((tuple(r) for r in rows), key=repr)
