"""Texts that try the rules: clauses of the corpus, near misses, odd characters, and mixtures of all."""

import random

from regulith.plans.corpus import CLAUSES

ODD = [
    "", " ", "\n\n", "counterpart of the deed", "See section . and more", "avoid", "it is to be filed", "shall be required to pay", "notwithstanding a\rb section",
    "notwithstanding a b provision", "original signature", "ſigned in ink", "٣٠ days before", "éfee of $5", "billion", "electronically", "notary public " * 40,
    "Section 5Section 6 Part Section 7", "Section 1 " + "x" * 250 + "\nrest of it in writing", "Keep in writıng", "Part\n\nA\nbody", "shall appear before. a.b!c?? d;;", "e the. be! I... Índex",
    "Section 1.\n\nMandatory felony: in writing. (a) (b) is filed are FILED", "😀 filing fee 😀 of $50",
]


def mixed(n=60, seed=3):
    rng = random.Random(seed)
    bits = list(CLAUSES) + ODD + ["Section 3. ", "Article X ", "Chapter 2\n", "Part C ", "§ 4 ", "plain words here and there. ", "Sec. 9a-b\n"]
    return [rng.choice(["", " ", "\n"]).join(rng.choices(bits, k=rng.randint(1, 7))) for _ in range(n)]


ALL = list(CLAUSES) + ODD + mixed()
