"""Byte-pair encoding and decoding with a tokenization automaton.

The merges are compiled into one deterministic automaton over tokens. It starts as a single state with a loop for each
byte token. The gadget for a merge (u, v) -> w splits the state that u leads to: the copy has no arc v any more, so no
path reads u and then v; and w leads from each state that has an arc u to where v led. When all merges have been
applied, a byte string has exactly one path, and the labels of its arcs are its tokens in the order that repeated
lowest-rank merging gives. All arcs with one label share their target, so the automaton is ``goto[token]`` and a bit
table of the arcs that a state lacks.

Every prefix of a string has one path as well, so encoding keeps one state for each position of a pre-split word and
follows the arcs of the pieces that match there. Decoding emits the labels of arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veritally.llm import common

#: White space as Unicode lists it, and the pattern that splits text before the merges. Fixed values of the file format.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
WORDS_KEPT = 200_000  #: encoded words that a worker keeps at a time; others are encoded anew


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: printable bytes for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """The compiled merges of one byte-level vocabulary file."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        if len({w for _, _, w in rules}) < len(rules):
            raise ValueError("two merges make one token; the automaton needs a label for each")
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.label = [b""] * self.size
        for token, i in vocab.items():
            self.label[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.label[i] = token.encode()
        start = [vocab[c] for c in letters if c in vocab]
        self.goto, self.lacks = self._compile(start, rules)
        self.branch: dict[int, int] = {}  # node << 8 | byte -> node
        self.ends: list[int] = [-1]
        for i in {*start, *(w for _, _, w in rules)}:
            node = 0
            for b in self.label[i]:
                if (key := node << 8 | b) not in self.branch:
                    self.branch[key] = len(self.ends)
                    self.ends.append(-1)
                node = self.branch[key]
            self.ends[node] = i
        self.words = regex.compile(SPLIT)
        self.splits = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {s: array("I", [i]).tobytes() for s, i in self.special.items()}

    def _compile(self, start: list[int], rules: list[tuple[int, int, int]]) -> tuple[list[int], memoryview]:
        goto, users, states = [0] * self.size, [len(start)], 1
        bits = np.zeros((len(rules) + 1, self.size + 7 >> 3), np.uint8)  # of each state, the arcs it lacks; pages come with use
        for u, v, w in rules:
            old, after = goto[u], goto[v]
            if bits[old, v >> 3] >> (v & 7) & 1:  # earlier merges never leave this pair
                bits[:states, w >> 3] |= np.uint8(1 << (w & 7))
                continue
            if users[old] == 1 and u != v:
                new = old  # nothing else leads there, so the copy can take its place
            else:
                new, states = states, states + 1
                bits[new] = bits[old]
                users[old] -= 1
                users.append(1)
                goto[u] = new
            bits[new, v >> 3] |= np.uint8(1 << (v & 7))
            bits[:states, w >> 3] |= (bits[:states, u >> 3] >> np.uint8(u & 7) & np.uint8(1)) << np.uint8(w & 7)
            goto[w] = after
            users[after] += 1
        return goto, memoryview(bits[:states].reshape(-1))

    def encode_word(self, word: bytes) -> list[int]:
        n = len(word)
        state, last = [-1] * (n + 1), [-1] * (n + 1)
        state[0] = 0
        branch, ends, goto, lacks, wide = self.branch.get, self.ends, self.goto, self.lacks, self.size + 7 >> 3
        for i in range(n):
            if state[i] < 0:
                continue
            row, node = wide * state[i], 0
            for j in range(i, n):
                node = branch(node << 8 | word[j])
                if node is None:
                    break
                t = ends[node]
                if t >= 0 and not lacks[row + (t >> 3)] >> (t & 7) & 1:
                    state[j + 1], last[j + 1] = goto[t], t
        if state[n] < 0:
            raise ValueError("a byte of the text is not in the vocabulary")
        out = []
        while n:
            out.append(last[n])
            n -= len(self.label[last[n]])
        return out[::-1]

    def packed(self, text: str) -> bytes:
        """Ids of a whole text as unsigned 32-bit little-endian integers."""
        known = self.known
        words = []
        for part in self.splits.split(text) if self.splits else (text,):
            if part in self.special:
                words.append(part)
            else:
                words += self.words.findall(part)
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        if len(known) > WORDS_KEPT:
            self.known = known = {s: known[s] for s in self.special}
        own, out = {}, []
        for w in words:
            ids = known.get(w) or own.get(w)
            if ids is None:
                ids = array("I", self.encode_word(w.encode())).tobytes()
                if len(w) <= 64:
                    known[w] = ids
                else:
                    own[w] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return list(array("I", self.packed(text)))

    def decode(self, ids) -> str:
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "replace")


def automaton(file: bytes) -> Automaton:
    """The automaton of a file; a process keeps the last."""
    return common.kept("bpe", hashlib.sha256(file).hexdigest(), lambda: Automaton(file))


#: What encode_decode can add to the columns of its input.
COLUMNS = {
    "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
    "bpe_ids": T.BinaryType(),
    "bpe_text": T.StringType(),
}


def encode_decode(docs: DataFrame, text: str = "text", add: tuple[str, ...] = ("n_tokens", "ids_sha256", "decoded_sha256"), vocabulary: str = "byte_bpe_50k.json", drop: tuple[str, ...] = ()) -> DataFrame:
    """Encode each whole text, decode the ids, and add what ``add`` names (see COLUMNS).

    ``bpe_ids`` are the ids as little-endian unsigned 32-bit integers, ``bpe_text`` is the decoded text. A null text
    counts as empty: no tokens, the hash of no bytes. Repeated rows and null ids each give a row of their own. A column
    of the input that has the name of an added one is replaced; ``drop`` names input columns to leave out. There is no
    shuffle, so a task's memory is one batch of texts and a bounded store of encoded words.
    """
    file = docs.sparkSession.sparkContext.broadcast(common.vocabulary_bytes(vocabulary))
    kept = [f for f in docs.schema.fields if f.name not in add and f.name not in drop]
    schema = T.StructType([*kept, *(T.StructField(c, COLUMNS[c]) for c in add)])
    names = [f.name for f in kept]
    place = names.index(text) if text in names else len(names)
    source = docs.select(*[docs[n] for n in names], *([] if text in names else [docs[text]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dfa = automaton(file.value)
        label = dfa.label.__getitem__
        for batch in common.slices(batches):
            got: dict[str, list] = {c: [] for c in add}
            for t in batch.column(place).to_pylist():
                packed = dfa.packed(t or "")
                raw = b"".join(map(label, array("I", packed)))
                for c, out in got.items():
                    if c == "n_tokens":
                        out.append(len(packed) // 4)
                    elif c == "ids_sha256":
                        out.append(hashlib.sha256(packed).hexdigest())
                    elif c == "decoded_sha256":
                        out.append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
                    elif c == "bpe_ids":
                        out.append(packed)
                    else:
                        out.append(raw.decode("utf-8", "replace"))
            kinds = {"n_tokens": pa.int64(), "bpe_ids": pa.binary()}
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(pa.array(v, kinds.get(c, pa.string())) for c, v in got.items())], names=[*names, *add])

    return source.mapInArrow(run, schema)
