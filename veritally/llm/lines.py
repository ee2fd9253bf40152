"""Line dedup: winnowing over hashes of lines, matches extended both ways, later repeated runs deleted.

A text is cut into pieces: its lines, and lines of more than LONG words after those sentence ends that the letters before
them choose; what is then still longer, after all sentence ends, and over twice as long, after words that their hash chooses. So a passage in the middle of a line is cut
alike wherever it stands. Pieces are hashed in lower case with blanks collapsed. From each piece on, a window is the shortest stretch ahead that has ``run_words`` words
or more, and the shortest one back; its minimum is its fingerprint, so two texts that share a window share a fingerprint.
Pieces of more words count as the smaller ones and equal ones go by hash, so that short, common pieces are seldom chosen.
Positions are joined by fingerprint, and those whose fingerprint stands nowhere else are done with. The others
are extended ahead and back to their windows: a run of pieces with ``run_words`` words or more repeats an earlier one
exactly where the windows that cover it do, so each window is held against its first occurrence anywhere, and what
windows that stand earlier cover together are the maximal repeated runs. Their later occurrences go.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm import common

RUN_WORDS = 10
LONG = 24  #: words beyond which a line is cut at chosen sentence ends, and what lies between those at all; beyond twice as many a piece is cut between words
LINE = re.compile(r"\n\s*")
SENTENCE = re.compile(r"[.!?]\s+")
WORD = re.compile(r"\S+\s*")
ODD = re.compile(r"  |[^\S \n]")
BASE = 0x9E3779B97F4A7C15  #: odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)


def pieces(text: str | None) -> tuple[list[int], list[int], list[int], list[int]]:
    """First and last character (exclusive), hash and number of words of each piece that has words; they tile the text."""
    starts, ends, hashes, words = [], [], [], []
    if not text:
        return starts, ends, hashes, words
    digest = xxhash.xxh64_intdigest
    low = text.lower()
    plain = len(low) == len(text) and not ODD.search(low)  # words are parted by single blanks

    def words_in(a: int, b: int) -> tuple[str, int]:
        if plain:
            whole = low[a:b].strip()
            return whole, whole.count(" ") + 1 if whole else 0
        own = text[a:b].lower().split()
        return " ".join(own), len(own)

    def add(a: int, b: int, whole: str, n: int) -> None:
        if n:
            starts.append(a)
            ends.append(b)
            hashes.append(digest(whole.encode()))
            words.append(n)

    at = 0
    for end in (*(m.end() for m in LINE.finditer(text)), len(text)):
        whole, n = words_in(at, end)
        if n <= LONG:
            add(at, end, whole, n)
            at = end
            continue
        for cut in (*(m.end() for m in SENTENCE.finditer(text, at, end) if not zlib.crc32(text[max(at, m.start() - 8) : m.start()].lower().encode()) & 1), end):
            whole, n = words_in(at, cut)
            if n <= LONG:
                add(at, cut, whole, n)
                at = cut
                continue
            for part in (*(m.end() for m in SENTENCE.finditer(text, at, cut)), cut):
                whole, n = words_in(at, part)
                if n > 2 * LONG:
                    for m in WORD.finditer(text, at, part):
                        if m.end() < part and not zlib.crc32(m.group().lower().strip().encode()) & 7:
                            add(at, m.end(), *words_in(at, m.end()))
                            at = m.end()
                    whole, n = words_in(at, part)
                add(at, part, whole, n)
                at = part
        at = end
    return starts, ends, hashes, words


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 to n, and its inverse to them, modulo 2**64."""
    out = []
    for b in (BASE, INVERSE):
        x = np.full(n + 1, b, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def windows(hashes: np.ndarray, words: np.ndarray, sizes: np.ndarray, run_words: int = RUN_WORDS) -> tuple[np.ndarray, ...]:
    """(text, first piece, last piece exclusive, minimum, hash) of all windows of the texts; (text, minimum) of its positions.

    ``sizes`` is the number of pieces of each text; hashes (unsigned) and words are those of all texts, one after another.
    """
    n = len(hashes)
    ends = np.cumsum(sizes)
    first, last = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    total = np.concatenate(([0], np.cumsum(words)))
    ahead = np.searchsorted(total, total[:-1] + run_words)
    back = np.searchsorted(total, total[1:] - run_words, "right") - 1
    s = np.concatenate([np.arange(n)[ahead <= last], back[back >= first]])
    e = np.concatenate([ahead[ahead <= last], np.arange(1, n + 1)[back >= first]])
    key = np.unique(s * np.int64(n + 1) + e)
    s, e = key // (n + 1), key % (n + 1)
    order = (255 - np.minimum(words, 255)).astype(np.uint64) << np.uint64(56) | hashes >> np.uint64(8)
    low, at = order[s], s.copy()
    for k in range(1, int((e - s).max(initial=1))):
        more = np.flatnonzero(s + k < e)
        more = more[order[s[more] + k] < low[more]]
        at[more] = s[more] + k
        low[more] = order[at[more]]
    with np.errstate(over="ignore"):
        up, down = powers(int(sizes.max(initial=0)))
        place = np.arange(n) - first
        run = np.concatenate(([np.uint64(0)], np.cumsum((hashes ^ hashes >> np.uint64(29)) * up[place], dtype=np.uint64)))
        x = (run[e] - run[s]) * down[s - first[s]] + (e - s).astype(np.uint64)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    chosen = np.unique(at)
    return text[s], s, e, low, x ^ x >> np.uint64(31), text[chosen], order[chosen]


def repeated_runs(docs: DataFrame, run_words: int = RUN_WORDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, mark (hash of the text), and runs: (start, end) characters of windows that stand earlier, as an array.

    Earlier means a smaller id, or an earlier place of the same text; of texts that share an id, the one with the smaller
    hash counts as the earlier. Rows alike in id and text are one document.
    """
    source = docs.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).cast("long"), F.xxhash64(text), F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.kept("lines", None, lambda: None)  # memory that other operators hold in this worker
        for batch in common.slices(batches):
            cut = [pieces(t) for t in batch.column(2).to_pylist()]
            a, b, h, w = (np.array([x for c in cut for x in c[k]], kind) for k, kind in enumerate((np.int32, np.int32, np.uint64, np.int64)))
            of, s, e, low, whole, holder, chosen = windows(h, w, np.array([len(c[0]) for c in cut], np.int64), run_words)
            cuts, cuts2 = (pa.array(np.concatenate(([0], np.cumsum(np.bincount(x, minlength=batch.num_rows)))).astype(np.int32)) for x in (of, holder))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (a[s], b[e - 1], low.view(np.int64), whole.view(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *lists, pa.ListArray.from_arrays(cuts2, pa.array(chosen.view(np.int64)))], names=["doc", "mark", "start", "end", "own", "window", "prints"])

    found = common.staged(source.mapInArrow(run, "doc long, mark long, start array<int>, end array<int>, own array<long>, window array<long>, prints array<long>"), "windows")
    # keys that stand once are done with; what the others are joined to is staged, so that Spark sees its size and splits hot keys
    prints = found.select(F.explode("prints").alias("own"))
    many = common.staged(prints.groupBy("own").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("own"), "fingerprints", compact=True)
    hits = found.select("doc", "mark", F.inline(F.arrays_zip("own", "window", "start", "end"))).join(many, "own")
    hits = common.staged(hits.select("doc", "mark", "start", "end", "window"), "hits")
    common.discard(found)
    at = F.struct("doc", "mark", "start")
    firsts = hits.groupBy("window").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").select("window", "first")
    firsts = common.staged(firsts, "firsts", compact=True)
    later = hits.join(firsts, "window").where(at > F.col("first")).select("doc", "mark", "start", "end")
    return later.groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "end")).alias("runs"))


def without(text: str, runs: list[tuple[int, int]]) -> str:
    """``text`` without the characters of ``runs`` (start, end). A run that begins in mid-line leaves its line end there."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b in sorted(runs):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in merged:
        out.append(text[at:a])
        gone = text[a:b]
        if a and text[a - 1] != "\n" and "\n" in gone[len(gone.rstrip()) :]:
            out.append("\n")
        at = b
    out.append(text[at:])
    left = "".join(out)
    return left.rstrip() if at == len(text) and not text[-1].isspace() else left


def dedup(docs: DataFrame, run_words: int = RUN_WORDS, id_col: str = "doc_id", text: str = "text", drop_emptied: bool = True) -> DataFrame:
    """``docs`` with later repeated runs deleted from ``text``; all columns are kept, in order, whatever their names.

    A column n_chars gets the new length where a text changed. A document of which nothing but blanks is left is dropped if
    ``drop_emptied`` is true: it is a copy, whole, of what stands earlier. Rows with a null id or text stay as they are and
    are not compared; texts with fewer words than ``run_words`` have no window and stay. Rows alike in id and text are one
    document: each keeps what the first does. An empty table gives an empty table.
    """
    found = repeated_runs(docs, run_words, id_col, text)
    names, rows = docs.columns, docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("mark"), F.struct(*docs.columns).alias("row"))
    joined = rows.join(found, ["doc", "mark"], "left").select("row", "runs")
    at = names.index(text)
    size = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            columns, cuts = batch.column(0).flatten(), batch.column(1)
            some = np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False))
            if len(some):
                taken = pa.array(some)
                changed = [without(t, [(r["start"], r["end"]) for r in runs]) for t, runs in zip(columns[at].take(taken).to_pylist(), cuts.take(taken).to_pylist(), strict=True)]
                mask = pa.array(np.isin(np.arange(batch.num_rows), some))
                columns[at] = pc.replace_with_mask(columns[at], mask, pa.array(changed, columns[at].type))
                if size is not None:
                    columns[size] = pc.replace_with_mask(columns[size], mask, pa.array([len(t) for t in changed], columns[size].type))
                if drop_emptied:
                    empty = some[[not t.strip() for t in changed]]
                    columns = [c.filter(pa.array(~np.isin(np.arange(batch.num_rows), empty))) for c in columns]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, docs.schema)
