"""Near-duplicates by five-word shingles against a plain version of the same, and as a stage of the pipeline."""

import random

import numpy as np

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.test_text_operators import ODD, components
from veritally.llm import simhash


def plain_set(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def plain_similarity(a, b):
    return len(a & b) / len(a | b)


def edited(rng, text, n):
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(rng):
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(n)) for n in (50, 100, 100, 200, 400, 1000)]
    return [*ODD, *base, *base[:2], *(edited(rng, b, k) for b in base for k in (1, 2, 3, 5, 8, 13))]


def test_links_are_those_of_the_shingles(spark):
    texts = corpus(random.Random(7))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([*rows, rows[5], (None, texts[len(ODD)])], "doc_id long, text string")
    sets = dict((i, plain_set(t)) for i, t in rows)
    want = components(list(sets), [(a, b) for a in sets for b in sets if a < b and plain_similarity(sets[a], sets[b]) >= 0.8])
    got = simhash.near_copies(docs).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        assert r["component_id"] == want[len(ODD) if r["doc_id"] is None else r["doc_id"]]
    assert simhash.near_copies(docs.limit(0)).collect() == []


def test_chain_of_which_the_first_is_no_neighbour_of_the_last(spark):
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words[k : k + 200]) for k in range(0, 100, 15)]  # neighbours share 181 of 211 shingles, next ones 166 of 226
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component_id"] for r in simhash.near_copies(docs).collect()} == {0}


def test_stage_drops_a_document_with_one_changed_word(spark):
    rng = random.Random(11)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(100)) for _ in range(10)]
    texts = [*base, *(edited(rng, b, 1) for b in base)]  # similarity 0.9 or more
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.dedup_documents(spark, docs, SMALL).collect()} == set(range(10))


def test_postings_at_any_size():
    """Blocks stay within what a task holds, without copies of postings, and postings grow with the logarithm."""
    for n in (10, 10**4, 10**6, 10**7, 10**8, 10**9):
        bits, radius, slices = simhash.plan(n, 0.8)
        narrow = min(w for _, _, w in simhash.blocks_of(bits, radius))
        assert n / 2**narrow <= simhash.HOT and slices * (radius + 1) <= 160, n


def test_pairs_at_the_similarity_meet():
    """Of sets that share 0.8 to 0.85, as many meet in a slice as planned, at sizes whose plans differ."""
    rng = np.random.default_rng(5)
    for n in (10**4, 10**9):
        bits, radius, slices = simhash.plan(n, 0.8)
        words, met, pairs = -(-bits * slices // 64), 0, 300
        for _ in range(pairs):
            common_, own = rng.integers(0, 2**63, 400, dtype=np.uint64), rng.integers(0, 2**63, (2, 40), dtype=np.uint64)  # 400 of 480: 0.83
            a, b = (simhash.slices_of(simhash.long_print(np.unique(np.concatenate([common_, x])), words)[None], bits, slices)[0] for x in own)
            met += bool((np.bitwise_count(a ^ b) <= radius).any())
        assert met >= 0.99 * pairs, (n, met)
