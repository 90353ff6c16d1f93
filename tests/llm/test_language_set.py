"""The language set grows as far as the penalised likelihood lets it."""

import numpy as np

from lexigrove.llm import language_mixture


def test_six_languages_share_a_document():
    kinds = {f"l{i}": "".join(chr(97 + 4 * i + j) for j in range(4)) for i in range(6)}
    rng = np.random.default_rng(3)
    text = lambda letters, n: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(n))
    counts = {k: np.bincount(language_mixture.grams(language_mixture.normal(text(v, 2000))), minlength=1 << language_mixture.BUCKET_BITS) for k, v in kinds.items()}
    shares = language_mixture.Model(counts).infer(" ".join(text(v, 200) for v in kinds.values()))[2]
    assert set(shares) == set(kinds) and all(abs(s - 1 / 6) < 0.02 for s in shares.values())
