"""The pipeline's near-copy stage against brute-force similarity of five-word shingles."""

import random

import numpy as np
import pytest

import corpus_pipeline
from strandweave.llm import similar
from tests.llm.test_llm import brute_components, corpus, docs, words


def brute_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def edited():
    """Chains of near copies with a few words changed, so that fingerprints differ in many bits."""
    rng = random.Random(7)
    out = corpus()
    for _ in range(12):
        base = words(rng, rng.randint(40, 300), 5000).split()
        for _ in range(rng.randint(1, 4)):
            out.append(" ".join(base))
            for at in rng.sample(range(len(base)), rng.randint(1, max(1, len(base) // 60))):
                base[at] = f"z{rng.randrange(9999)}"
    return out


@pytest.mark.parametrize("block, piece", [(similar.BLOCK, similar.PIECE), (7, 900)])
def test_near_copies_against_brute_force(spark, block, piece):
    texts = edited()
    sets = [brute_set(t) for t in texts]
    want = brute_components(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    got = {r["doc_id"]: r["component_id"] for r in similar.near_copies(docs(spark, texts), block=block, piece=piece).collect()}
    assert got == dict(enumerate(want))
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs(spark, texts), "").collect()}
    assert kept == {i for i, r in enumerate(want) if i == r}


def test_near_copies_without_ids(spark):
    text = " ".join(f"w{i}" for i in range(100))
    got = corpus_pipeline.near_dedup(spark, docs(spark, [text, text + " x", "lone words", text], [None, 5, None, 7]), "").collect()
    assert sorted((r["doc_id"] is None, r["text"]) for r in got) == [(False, text + " x"), (True, "lone words")]
    assert not similar.near_copies(docs(spark, [])).collect()


def test_candidates_miss_nothing_of_note():
    """Sets of similarity just 0.8 and of several sizes, as far as fingerprints go."""
    rng = np.random.default_rng(1)
    missed = 0
    for n in (45, 90, 450):
        for _ in range(300):
            both, x, y = (rng.integers(0, 2**63, k, dtype=np.uint64) for k in (n * 8 // 9 + 1, n // 9, n // 9))
            a, b = np.concatenate([both, x]), np.concatenate([both, y])
            near = [similar.bits_of(f(a), ties=True) ^ similar.bits_of(f(b), ties=True) for f in (lambda h: h, similar.second)]
            low, high = ((v & (2**64 - 1)).bit_count() for v in near)
            missed += low > similar.HALF or low + high > similar.WHOLE
    assert missed <= 1


def test_repeated_ids_keep_every_text(spark):
    """Rows (3, A), (7, A), (7, B): A stays once, B stays."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    got = corpus_pipeline.near_dedup(spark, docs(spark, [a, a, b, b, None, "", " "], [3, 7, 7, 7, 1, 2, None]), "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, None), (3, a), (7, b)]


def test_a_group_of_unlike_texts_is_resolved():
    """Fingerprints that all lie near each other, but only some sets are similar: every similar pair is found."""
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(base, 150, replace=False), rng.integers(0, 2**63, 10, dtype=np.uint64)])) for _ in range(12)]
    sets += [np.unique(np.r_[s[5:], rng.integers(0, 2**63, 5, dtype=np.uint64)]) for s in sets]
    zero = np.zeros(len(sets), np.uint64)
    for side in (None, np.arange(len(sets)) % 2):
        got = {frozenset(x) for x in similar.links_in(np.arange(len(sets)), sets, zero, zero, side)}
        linked = lambda i, j: side is None or side[i] != side[j]
        want = brute_components(list(range(len(sets))), lambda i, j: linked(i, j) and similar.similar(sets[i], sets[j]))
        assert brute_components(list(range(len(sets))), lambda i, j: frozenset((i, j)) in got) == want
        assert len(got) < len(sets)
