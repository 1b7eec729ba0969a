"""Which words to blame get forms with an inserted character."""

import numpy as np

from strandweave.llm import toxicity


def test_words_of_four_letters_have_spoilt_forms():
    assert toxicity.spoilt("scum") == ["s￿cum", "sc￿um", "scu￿m"]
    assert toxicity.spoilt("dim") == []


def test_forms_are_cut_by_blame_and_not_by_alphabet(monkeypatch):
    rng = np.random.default_rng(3)
    plain = ["".join(rng.choice(list("bcdfglmnprst"), 6)) for _ in range(120)]
    rare = ["aa" + "".join(rng.choice(list("hjkq"), 6)) for _ in range(12)]
    text = lambda: " ".join(rng.choice(plain, 12))
    toxic = [f"{text()} zyxwvu" for _ in range(60)] + [f"{text()} {w}" for w in rare for _ in range(3)]
    seen = []
    mapped = toxicity.mapped
    monkeypatch.setattr(toxicity, "GUILTY_WORDS", 10)
    monkeypatch.setattr(toxicity, "mapped", lambda words, *a: seen.append(list(words)) or mapped(words, *a))
    assert toxicity.train(toxic + [text() for _ in range(200)], [1] * len(toxic) + [0] * 200) is not None
    bad = [words for words in seen if any("￿" in w for w in words)]
    assert bad and all(set(toxicity.spoilt("zyxwvu")) <= set(words) for words in bad)
