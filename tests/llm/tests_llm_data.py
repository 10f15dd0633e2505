"""What the tests of the llm operators share."""

import random

#: Names that operators use inside; a table may have them too.
CLASHING = ["k", "h", "n", "i", "j", "s", "p", "b", "bucket", "before", "number", "digest", "norm", "size", "root", "prefix", "windows", "start", "words", "found"]


def prose(rng: random.Random, words: int) -> str:
    syllables = ["ta", "ri", "on", "é", "sch", "lo", "ven", "qua", "mi", "dor", "pel", "su"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) + rng.choice(["", "", "", ",", "."]) for _ in range(words))
