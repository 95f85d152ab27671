"""Links and candidates of near-duplicate detection where sketches are estimates: sets far larger than a sketch."""

import random

from lodestack.llm import neardup


def copied(rng, words, similarity_of):
    """The words with as many single ones replaced as a similarity of 0.8 or just above allows; replaced ones are no neighbours."""
    shingles = len(words) - 1
    m = max(k for k in range(1, shingles) if similarity_of(shingles - 2 * k, shingles + 2 * k))
    places = rng.sample(range(1, (len(words) - 1) // 2), m)
    out = list(words)
    for p in places:
        out[2 * p] = f"z{rng.random()}"
    return out


def test_pairs_of_large_sets_at_the_limit(spark):
    """Every pair at a similarity of 0.8 to 0.81, of sets of 150 to 3000 shingles, is linked."""
    rng = random.Random(41)
    rows, pairs = [], []
    for k in range(150):
        words = [f"w{rng.random()}" for _ in range(rng.choice([151, 300, 700, 3000]))]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copied(rng, words, lambda i, u: 100 * i >= 80 * u)))]
        pairs.append((2 * k, 2 * k + 1))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    assert [p for p in pairs if got[p[1]] != p[0]] == [] and sum(d == c for d, c in got.items()) == 150


def test_pairs_below_the_limit_are_not_linked(spark):
    rng = random.Random(43)
    rows = []
    for k in range(60):
        words = [f"w{rng.random()}" for _ in range(400)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copied(rng, words, lambda i, u: 100 * i >= 78 * u)))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2)
    assert got.where("doc_id <> component_id").count() == 0
