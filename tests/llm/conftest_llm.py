"""Texts shared by the tests of the corpus operators."""


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


#: Texts every operator has to survive.
ODD_TEXTS = [None, "", " \t\n", "é", "🙂🙂 ß", "word", "word word", "\u0000\u0001", "a" * 300_000, "long tail " * 20_000, "dup", "dup"]
