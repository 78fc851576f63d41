import random

import pytest

WORDS = "the of and to in is that it for on with as at be by this are or was from alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()


def prose(rng, n, lines=True):
    out = [rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n)]
    return "".join(w + ("\n" if lines and rng.random() < 0.05 else " ") for w in out).strip()


@pytest.fixture(scope="session")
def rows():
    """Documents with everything unpleasant: nulls anywhere, empty and very long texts, copies, near copies, repeated rows,
    shared passages, secrets, odd characters, a hot source."""
    rng = random.Random(3)
    base = [prose(rng, rng.randint(60, 300)) for _ in range(40)]
    passage = prose(rng, 120, lines=False)
    out = []
    for i in range(120):
        text = base[i % 40] if i < 60 else prose(rng, rng.randint(1, 400))
        if 40 <= i < 50:  # near copies
            w = text.split(" ")
            w[len(w) // 2] = f"changed{i}"
            text = " ".join(w)
        if i % 10 == 7:
            text = f"{text[: len(text) // 2]} {passage} {text[len(text) // 2 :]}"
        if i % 15 == 3:
            text += ' token = "%s" and %s' % ("".join(rng.choice("0123456789abcdef") for _ in range(40)), "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(32)))
        out.append((i, text, "en" if i % 7 else "fr", "src0" if i % 3 else f"src{i % 5}"))
    out += [(200, None, None, None), (201, "", "en", "src1"), (202, " \t\n ", None, "src0"), (203, "one", "xx", None), (204, "two words", "en", ""), (None, prose(rng, 80), "en", "src0"), (None, None, None, None)]
    out += [out[5], out[5], (206, "ÉCOLE naïve 日本語 ½ ² \U0001f600 <|endoftext|> it's  x\r\n\r\n\ty " * 30, "fr", "src2"), (207, prose(rng, 60_000), "en", "src3"), (208, "A B C D E", "en", "src0"), (209, "a b c d e", "en", "src0")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows as a table whose further columns clash with names used inside."""
    df = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, "x", 1.5, i) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, _text string, place double, key long")
    return df.repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
