"""Made-up texts for the operator tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": "th er on an re he in ed nd ha at en".split(), "fr": "é ou ai eau le tre ment que ré pa".split()}


def prose(rng: random.Random, words: int, lang: str = "en") -> str:
    out = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    return " ".join(out) + "."
