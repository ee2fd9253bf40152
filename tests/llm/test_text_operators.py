"""Encoding, counting, fingerprints, lines and leaks against plain versions of the same."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veritally.llm import bpe, common, decontam, graph, lines, simhash, token_counts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a", "a<|endoftext|> b", " \n\t x", "\x1c a\x85b​", "a" * 300, "é 東京都 𝕏  　x", "it's 123 we'll", "x" * 3000 + " " * 200, "<s>▁ ▁▁a</s>", "a\x00b\nc\r\n", "ABC def GHI", " ".join(f"many{i % 700}" for i in range(20_000))]
DOCS = "doc_id long, text string, n_tokens string, other int"


def odd_rows():
    """Texts of every kind, a repeated row, a null id, and columns whose names clash with results."""
    rows = [(i, t, "mine", i) for i, t in enumerate(ODD)]
    return [*rows, rows[3], (None, "no id here at all", None, None)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_automaton_follows_the_library(library):
    dfa = bpe.automaton(common.vocabulary_bytes(VOCABULARY))

    @settings(max_examples=150, deadline=None)
    @given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("the and ing'll 12\n\t ")), max_size=60))
    def check(text):
        ids = library.encode(text, add_special_tokens=False).ids
        assert dfa.encode(text) == ids
        assert dfa.decode(ids) == library.decode(ids, skip_special_tokens=False) == text

    check()


def test_encode_decode(spark, library):
    docs = spark.createDataFrame(odd_rows(), DOCS)
    out = bpe.encode_decode(docs, add=tuple(bpe.COLUMNS)).collect()
    assert len(out) == len(odd_rows()) and set(out[0].asDict()) == {"doc_id", "text", "other", *bpe.COLUMNS}
    for r in out:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        assert r["n_tokens"] == len(ids) and bytes(r["bpe_ids"]) == raw and r["ids_sha256"] == hashlib.sha256(raw).hexdigest()
        assert r["bpe_text"] == (r["text"] or "") and r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.encode_decode(docs.limit(0)).collect() == []


def test_word_store_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 5)
    dfa = bpe.Automaton(common.vocabulary_bytes(VOCABULARY))
    text = " ".join(f"word{i}" for i in range(50))
    first = dfa.encode(text)
    assert dfa.encode(text) == first and dfa.decode(first) == text


def test_token_counts(spark, monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = odd_rows() + [(100 + i, "the same word again " * i, "", 0) for i in range(120)]
    docs = spark.createDataFrame(rows, DOCS)
    got = token_counts.token_counts(docs, limit=100).collect()
    want = [(i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 100) for i, t, _, _ in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert token_counts.token_counts(docs.limit(0)).collect() == []


def test_pieces_of_any_text():
    p = token_counts.Pieces(common.vocabulary_bytes(MODEL))

    @settings(max_examples=200, deadline=None)
    @given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("the ▁ 12\n\t ")), max_size=50))
    def check(text):
        assert sum(p.count(p.words(text))) == len(p.sp.encode(text))

    check()


def plain_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(9)) for _ in range(80)) for _ in range(12)]
    texts = [*ODD, *base, *base[:4], *(b.replace("alpha1", "ALPHA1") for b in base[:3]), *(" ".join(b.split()[: 79 - k]) for b in base for k in range(3))]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[5], (None, base[0], "y"), (None, "only one of its kind in here", "z")], "doc_id long, text string, fingerprint string")
    prints = {i: plain_fingerprint(t) for i, t, _ in rows}
    want = components(list(prints), [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    for hot in (simhash.HOT, 1):  # dealt out whole, and by descendants
        got = simhash.near_duplicates(docs, hot=hot).collect()
        assert len(got) == len(rows) + 3
        for r in got:
            if r["doc_id"] is not None:
                assert (r["fingerprint"], r["component_id"]) == (f"{prints[r['doc_id']]:016x}", want[r["doc_id"]])
        assert sorted([r["component_id"] for r in got if r["doc_id"] is None], key=str) == sorted([want[texts.index(base[0])], None], key=str)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_trie_join_finds_all_links():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [c ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for c in centres for a, b in rng.integers(0, 40, (60, 2))]
    fps = np.unique((np.array(near, np.uint64) & np.uint64((1 << 43) - 1)) | np.uint64(5 << 43))
    ids = range(len(fps))
    want = components(ids, [(i, int(j)) for i in ids for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2) if i < j])
    assert components(ids, simhash.trie_join(fps, 2, 21)) == want


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(60)]
    pairs = [*chain, *[(200 + rng.randrange(40), 200 + rng.randrange(40)) for _ in range(25)], (500, 500), (None, 3), (900, 800), (900, 800)]
    got = {r["node"]: r["root"] for r in graph.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    assert got == components({x for p in real for x in p}, real)
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def plain_dedup(rows, least):
    """Characters of each text (in order of id) that lie in a run of pieces, of ``least`` words or more, that stands earlier."""
    seen, out = set(), {}
    for i, t in rows:
        starts, ends, hashes, words = lines.pieces(t)
        gone = set()
        for s in range(len(hashes)):
            total = 0
            for e in range(s, len(hashes)):
                total += words[e]
                if total >= least:
                    run = tuple(hashes[s : e + 1])
                    if run in seen:
                        gone.update(range(starts[s], ends[e]))
                    seen.add(run)
        out[i] = gone
    return out


def left_of(text, gone):
    """The words that are left, in order."""
    return "".join(c if k not in gone else " " for k, c in enumerate(text)).split()


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 2, 3, 4, 12, 30]))) + rng.choice(["", ".", "!"]) for _ in range(25)]
    blocks = [[rng.choice(pool) for _ in range(rng.randrange(1, 6))] for _ in range(8)]
    texts = []
    for i in range(40):
        own = [f"line {i} {k} " + " ".join(f"u{i}x{k}x{j}" for j in range(rng.randrange(9))) for k in range(3)]
        parts = [*blocks[rng.randrange(8)], own[0], *blocks[rng.randrange(8)], *(["", "  "] if i % 3 else []), *own[1:]]
        texts.append(rng.choice(["\n", " "]).join(x.upper() if i % 5 == 0 else x for x in parts))
    rows = [*enumerate(texts), (50, texts[3]), (51, None), (52, ""), (53, "short"), (54, "short"), (55, "many words. " * 20_000)]
    docs = spark.createDataFrame([(i, t, len(t or ""), 7, "x") for i, t in [*rows, (None, texts[3])]], "doc_id long, text string, n_chars long, start int, runs string")
    got = {r["doc_id"]: r for r in lines.dedup(docs).collect()}
    assert got[None]["text"] == texts[3] and got[51]["text"] is None and got[52]["text"] == "" and got[54]["text"] == "short"
    assert 50 not in got  # a copy of an earlier document
    want = plain_dedup([(i, t) for i, t in rows if t and i != 55], lines.RUN_WORDS)
    assert any(want.values())
    for i, gone in want.items():
        text = dict(rows)[i]
        assert (got[i]["text"].split() if i in got else []) == left_of(text, gone), i
        if i in got:
            assert got[i]["n_chars"] == len(got[i]["text"]) and (got[i]["start"], got[i]["runs"]) == (7, "x")
            assert gone or got[i]["text"] == text
    assert len(got[55]["text"].split()) < 100
    assert lines.dedup(docs.limit(0)).collect() == []


def test_line_dedup_against_every_earlier_holder(spark):
    """The run L, b, c stands in document 3, not in the first holders of L or of L, b."""
    rows = [(1, "one two three four five six seven eight nine ten"), (2, "b b b"), (3, "b b b\nc c c"), (4, "b b b\nc c c")]
    docs = spark.createDataFrame([(i, t if i == 1 else f"one two three four five six seven eight nine ten\n{t}") for i, t in rows], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in lines.dedup(docs).collect()) == [(1, rows[0][1]), (2, "b b b"), (3, "c c c")]


def test_line_dedup_in_mid_line(spark):
    """A passage of over 50 words without line ends, between words of the documents' own."""
    rng = random.Random(5)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(70))
    docs = [(i, " ".join(f"d{i}x{rng.randrange(10**6)}" for _ in range(60)) + " " + passage + " " + " ".join(f"e{i}x{k}" for k in range(40))) for i in range(6)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0] == docs[0][1]
    for i in range(1, 6):
        kept = got[i].split()
        assert sum(w.startswith("p") for w in kept) < 35 and sum(w[0] in "de" for w in kept) == 100


def test_line_dedup_within_a_text(spark):
    long = " ".join(f"a{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"{long}\none\n{long}\ntwo"), (1, f"{long}\none\n{long}\ntwo"), (2, f"x\n{long}")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in lines.dedup(docs).collect())
    assert got == [(1, f"{long}\none\ntwo"), (1, f"{long}\none\ntwo"), (2, "x")]


def plain_leaks(text, items, threshold=0.8):
    """(item, best similarity) over all windows of the item's size."""
    words = re.findall(r"\w+", (text or "").lower())
    out = {}
    for item, body in items:
        w = re.findall(r"\w+", (body or "").lower())
        if not w or len(w) > len(words):
            continue
        k = min(5, len(w))
        bag = lambda x, k=k: Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1))
        mine = bag(w)
        best = max(decontam.similarity(mine, bag(words[s : s + len(w)])) for s in range(len(words) - len(w) + 1))
        if best >= threshold:
            out[item] = best
    return out


def test_leaks(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(6, 60)))) for i in range(25)]
    items += [(100, items[0][1]), (101, "tiny item"), (102, ""), (103, None), (104, "!!!")]
    docs = [(900, None), (901, ""), (902, "of no interest")]
    for i in range(60):
        w = items[rng.randrange(25)][1].upper().split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = "changed"
        host = [rng.choice(vocabulary) for _ in range(rng.randrange(80))]
        docs.append((i, " ".join([*host, *w, *host[::-1]]) + (" tiny, item" if i % 9 == 0 else "")))
    docs.append((None, items[1][1]))
    frame = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.leaks(frame, bench).collect()
    best = {}
    for r in got:
        k = (r["doc_id"], r["item_id"])
        best[k] = max(best.get(k, 0), r["similarity"])
    want = {(i, item): s for i, t in docs for item, s in plain_leaks(t, items).items()}
    assert best == pytest.approx(want)
    left = {r["doc_id"] for r in decontam.decontaminate(frame, bench).collect()}
    assert left == {i for i, _ in docs} - {k[0] for k in want if k[0] is not None}
    assert decontam.leaks(frame, bench.limit(0)).collect() == [] and decontam.leaks(frame.limit(0), bench).collect() == []


def test_leaks_in_parts(spark, monkeypatch):
    bench = spark.createDataFrame([(i, f"item {i} " + " ".join(f"w{i}x{k}" for k in range(12))) for i in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before item {i} " + " ".join(f"w{i}x{k}" for k in range(12)) + " after") for i in range(9)], "doc_id long, text string")
    monkeypatch.setattr(decontam, "PASS_BYTES", 100)
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()) == [(i, i) for i in range(9)]


@pytest.mark.parametrize("others", [0, 3000])
def test_radius_guarantee(others):
    """Whatever lies within the radius is found, beside few items and beside many."""
    rng, numbers = random.Random(3), np.random.default_rng(1)
    size = decontam.Size(12, [(i, numbers.integers(1, 1 << 63, 12, dtype=np.uint64)) for i in range(1 + others)], 16)
    for _ in range(200):
        flips = rng.sample(range(64), rng.randrange(20))
        f = size.prints[0]
        for b in flips:
            f ^= 1 << b
        want = [i for i, x in enumerate(size.prints) if (x ^ f).bit_count() <= 16]
        assert size.near(f) == want and (0 in want) == (len(flips) <= 16)


def test_fingerprints_depend_on_the_window_alone():
    item = "one item of the benchmark with words of its own and nothing else"
    alone = decontam.Benchmark([(1, item)])
    beside = decontam.Benchmark([(0, "of words the benchmark another item"), (1, item), (2, "nothing else but one")])
    find = lambda b: next(s for s in b.sizes if s.words == len(item.split())).prints
    assert find(alone) == find(beside)


def test_recall_of_fingerprints():
    """Of windows with a weighted similarity from 0.8 to 0.85 the radius reaches nearly all."""
    rng = random.Random(6)
    met = []
    while len(met) < 400:
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 200))]
        other = list(words)
        for _ in range(max(1, len(words) // 45)):
            other[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        a, b = (decontam.shingle_hashes(np.array([decontam.word_hash(w) for w in x], np.uint64), 5) for x in (words, other))
        if 0.8 <= decontam.similarity(Counter(a.tolist()), Counter(b.tolist())) <= 0.85:
            met.append((decontam.simhash(a) ^ decontam.simhash(b)).bit_count() <= decontam.RADIUS)
    assert np.mean(met) > 0.97


def test_sums_are_as_short_as_what_they_hold():
    """Sums by place come back as they were, and take bytes by the places that have any."""
    rng = np.random.default_rng(4)
    whole = np.zeros(token_counts.BATCH_DOCS, np.int64)
    want = whole.copy()
    for n in (0, 1, 17, 2000, 2731, 4096):
        total = np.zeros(token_counts.BATCH_DOCS)
        total[rng.choice(token_counts.BATCH_DOCS, n, replace=False)] = rng.integers(1, 2**31 - 1, n)
        packed = token_counts.packed_sums(total)
        assert len(packed) <= 1 + min(6 * n, 4 * token_counts.BATCH_DOCS)
        token_counts.add_sums(whole, packed)
        want += total.astype(np.int64)
    assert (whole == want).all()
