import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(k: int, n: int) -> str:
    """n words of a fixed pseudo-random sequence, in lines of twelve words."""
    state, out = k * 7919 + 17, []
    syllables = ["the", "on", "er", "an", "ti", "re", "ha", "nd", "ou", "st", "é", "ing"]
    for i in range(n):
        word = ""
        for _ in range(1 + (state >> 7) % 3):
            state = (state * 1103515245 + 12345) % (1 << 31)
            word += syllables[(state >> 16) % len(syllables)]
        out.append(word + (".\n" if i % 12 == 11 else " "))
    return "".join(out).strip()


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows and junk."""
    long_text = prose(3, 12_000)
    base = prose(1, 200)
    rows = [
        (0, base, "en", "a", 1),
        (1, base, "en", "a", 1),
        (1, base, "en", "a", 1),
        (2, base.replace("the", "The", 1) + " extra", None, None, None),
        (3, None, "en", "a", 1),
        (4, "", "en", "a", 0),
        (5, " \n\t ", "de", "b", 4),
        (None, prose(2, 90), "fr", "b", 3),
        (None, None, None, None, None),
        (6, long_text, "en", "a", 9),
        (7, prose(2, 60) + "\n" + prose(3, 40), "es", "c", 2),
        (8, "one two", "en", "a", 7),
        (9, "A B c A B c A B c x", "en", "a", 7),
        (10, "same line\nsame line\nsame line\nsame line\n\nsame line", "en", "a", 7),
        (11, "\x00 a\x0b b\x0c c\r\nd\x85e f　g 日本語 🎉 É é <s> </s> ▁x <|endoftext|> y", "en", "a", 7),
        (12, "WORD!! " * 300, "en", "a", 7),
        (13, "word*** and$$$ of### " * 90, "en", "a", 7),
        (14, "x" * 50_000, "en", "a", 7),
        (15, prose(4, 300), "en", "a", 7),
        (-5, prose(5, 300), "en", "a", 7),
    ]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(spark, odd_docs):
    """The same rows with further columns whose names operators use for their results."""
    from pyspark.sql import functions as F

    names = ["fp", "w", "pos", "size", "items", "item", "n_words", "component_id", "score", "kept", "h", "fingerprint", "n_lines", "rule", "host", "root", "first", "node", "n", "ws", "label", "held_out"]
    return odd_docs.select("*", *(F.lit(f"x_{c}").alias(c) for c in names), F.create_map(F.lit("a"), F.lit(1)).alias("m"))


@pytest.fixture(scope="session")
def sample():
    return "/root/testdata/sf0.001"
