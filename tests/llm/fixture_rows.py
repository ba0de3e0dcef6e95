"""Small document tables with the awkward cases that every operator has to meet."""
import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept boolean, size string, score string, "
          "start string, target string, row string, taken string, hub string, id string")


def documents(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, source), with further columns whose names operators use themselves."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src", None if r[1] is None else len(r[1]), None, "s", "x", "1", "t", "r", "k", "h", "i") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward():
    """Nulls, empty and blank texts, copies, repeated rows and a very long text."""
    long = prose(99, 30_000)
    return [(1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, prose(1, 120)), (5, prose(1, 120)), (6, prose(2, 200)), (6, prose(2, 200)),
            (7, "one"), (8, "one"), (None, prose(3, 80)), (9, long), (10, long + " tail"), (11, "naïve\x1ctext\x00 £ 日本 don't <|endoftext|> İ")]
