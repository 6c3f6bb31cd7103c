"""Documents with everything that an operator must bear."""

import random

WORDS = "the of and to in red blue green fast slow night river stone glass paper wind water light dark über naïve señal".split()


def words(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def documents(seed=0, n=40):
    """(doc_id, text, lang, source, n_chars, and columns whose names operators use inside)."""
    rnd = random.Random(seed)
    texts = ["\n".join(words(rnd, rnd.randrange(1, 30)) for _ in range(rnd.randrange(1, 6))) for _ in range(n)]
    texts += [None, "", "   \n\t", "one", "one two", texts[0], texts[0], texts[1].replace("the", "THE"), texts[2] + " tail", words(rnd, 30_000)]
    rows = [(i, t, "en", rnd.choice(["a", "b", "c", None]), len(t or ""), "x", 7, "y", 1.5) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, texts[4], "en", "a", 1, "x", 7, "y", 1.5)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, n int, component_id string, pos double"


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
