"""Token counts without token ids: pieces are counted once for each distinct pre-token of the corpus.

A pre-token is a stretch of text that no merge can cross: a run of blanks with the letters that follow, or a single
character that the vocabulary has in no longer piece. Batches of documents are turned into pre-tokens with frequencies
by document, dealt into buckets by pre-token. There each distinct pre-token is counted by the library when first met,
joined to its frequencies in all batches, and frequencies times pieces are summed for each document.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from veritally.llm import common

BATCH_DOCS, BATCH_CHARS = 4096, 16_000_000  #: a batch of documents ends at either; a place in it takes 12 bits
HELD = 256  #: batches whose sums a task holds before it hands them on
KNOWN = 1_000_000  #: pre-tokens whose pieces a task remembers; a bucket with more has some counted again


class Pieces:
    """Pre-tokens of texts, and the number of pieces of a pre-token."""

    def __init__(self, model: bytes):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size()) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece holds a blank after a letter; texts can't be cut at blanks")
        joined = sorted({c for p in pieces if len(p) > 1 for c in p} - {"▁"})
        if "\n" in joined or self.sp.encode(" a b") != [*self.sp.encode(" a"), *self.sp.encode("b")]:
            raise ValueError("the model changes texts in a way that the cuts don't allow for")
        inner = "[" + "".join(map(re.escape, joined)) + "]"
        self.cuts = re.compile(f"[ ▁]+{inner}*|{inner}+|[^ ▁]", re.DOTALL)
        self.lead = len(self.sp.encode("\n"))

    def words(self, text: str) -> list[str]:
        return self.cuts.findall(" " + text) if text else []

    def count(self, words: list[str]) -> list[int]:
        """A line feed before the word stands alone, and keeps off the blank that the library puts before a text."""
        return [len(x) - self.lead for x in self.sp.encode(["\n" + w for w in words], num_threads=1)]


def pieces(model: bytes) -> Pieces:
    return common.kept("pieces", model, lambda: Pieces(model))


def _packed(tokens: list[bytes], posts: list[np.ndarray]) -> tuple[bytes, bytes, bytes, bytes]:
    """Lengths and bytes of tokens; numbers of posts and posts; all compressed."""
    parts = np.array([len(x) for x in tokens], "<u4").tobytes(), b"".join(tokens), np.array([len(x) for x in posts], "<u4").tobytes(), b"".join(x.tobytes() for x in posts)
    return tuple(map(zstandard.ZstdCompressor(level=3).compress, parts))


SCHEMA = "batch long, bucket int, lengths binary, tokens binary, times binary, posts binary, ids array<{}>, sizes array<long>"


def postings(docs: DataFrame, model, buckets: int, id_col: str, text: str) -> DataFrame:
    """Of each batch of documents a row with ids and sizes, and a row for each bucket of its pre-tokens.

    A pre-token's bucket is a hash of it; of one that an eighth of the batch has, a hash of it and the batch, so that no
    bucket takes all there is of a frequent word. A post is 16 bits: the document's place in the batch, and a frequency
    up to 15; higher ones take several posts.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def emit(batch_id: int, ids: list[pa.Array], sizes: list[int], codes: list[np.ndarray], seen: dict[str, int]) -> Iterator[pa.RecordBatch]:
        flat = pa.concat_arrays(ids)
        own = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
        names = ["batch", "bucket", "lengths", "tokens", "times", "posts", "ids", "sizes"]
        one = lambda x: pa.array([x], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([batch_id]), pa.array([zlib.crc32(str(batch_id).encode()) % buckets], pa.int32()), *[one(None)] * 4, own, pa.array([sizes], pa.list_(pa.int64()))], names=names)
        at = np.repeat(np.arange(len(codes), dtype=np.int64), [len(c) for c in codes])
        keys, freq = np.unique(np.concatenate(codes).astype(np.int64) << 12 | at, return_counts=True)
        times = -(-freq // 15)
        keys, full = np.repeat(keys, times), np.repeat(freq, times)
        nth = np.arange(len(keys)) - np.repeat(np.cumsum(times) - times, times)
        posts = ((keys & 4095) | np.minimum(15, full - 15 * nth) << 12).astype("<u2")
        cuts = np.searchsorted(keys >> 12, np.arange(len(seen) + 1))
        many = np.diff(cuts) > max(64, len(codes) // 8)
        raw = [w.encode() for w in seen]
        salt = batch_id & 0xFFFFFFFF ^ batch_id >> 32
        bucket = np.array([zlib.crc32(w, salt if m else 0) % buckets for w, m in zip(raw, many.tolist(), strict=True)], np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for k in np.unique(bucket).tolist():
            part = order[ends[k] : ends[k + 1]]
            spans = [posts[cuts[i] : cuts[i + 1]] for i in part.tolist()]
            blobs = _packed([raw[i] for i in part.tolist()], spans)
            yield pa.RecordBatch.from_arrays([pa.array([batch_id]), pa.array([k], pa.int32()), *map(one, blobs), pa.nulls(1, own.type), pa.nulls(1, pa.list_(pa.int64()))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, nth, base = pieces(model.value).words, 0, TaskContext.get().partitionId() << 32
        ids, sizes, codes, chars, seen = [], [], [], 0, defaultdict()
        seen.default_factory = seen.__len__
        for part in common.slices(batches):
            for i, t in enumerate(part.column(1).to_pylist()):
                t = t or ""
                ids.append(part.column(0).slice(i, 1))
                sizes.append(len(t.encode()))
                codes.append(np.array([seen[w] for w in words(t)], np.int32))
                chars += len(t)
                if len(ids) == BATCH_DOCS or chars >= BATCH_CHARS:
                    yield from emit(base + nth, ids, sizes, codes, seen)
                    nth += 1
                    ids, sizes, codes, chars = [], [], [], 0
                    seen.clear()
        if ids:
            yield from emit(base + nth, ids, sizes, codes, seen)

    return docs.select(id_col, text).mapInArrow(run, SCHEMA.format(kind))


def packed_sums(total: np.ndarray) -> bytes:
    """Sums by place in a batch: places (2 bytes) and sums (4) of those that have any, or all sums where that is shorter."""
    some = np.flatnonzero(total)
    if 6 * len(some) >= 4 * len(total):
        return b"\1" + total.astype("<i4").tobytes()
    return b"\0" + some.astype("<u2").tobytes() + total[some].astype("<i4").tobytes()


def add_sums(total: np.ndarray, packed: bytes) -> None:
    """Adds what ``packed_sums`` gave to ``total``."""
    if packed[0]:
        total += np.frombuffer(packed, "<i4", offset=1)
    elif n := (len(packed) - 1) // 6:
        total[np.frombuffer(packed, "<u2", n, 1)] += np.frombuffer(packed, "<i4", n, 1 + 2 * n)


def sums(posts: DataFrame, model) -> DataFrame:
    """Join pre-tokens to their numbers of pieces, and sum pieces times frequency for each document of a batch.

    All rows of a bucket meet in one task; it has the library count a pre-token when it first meets it. Rows with
    documents' ids pass through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, known, held = pieces(model.value), {}, {}
        kind, unpack = None, zstandard.ZstdDecompressor().decompress

        def out() -> pa.RecordBatch:
            n = len(held)
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([packed_sums(v) for v in held.values()], pa.binary()), pa.nulls(n, kind[0]), pa.nulls(n, kind[1])], names=["batch", "sums", "ids", "sizes"])

        for part in batches:
            kind = part.schema.field("ids").type, part.schema.field("sizes").type
            own = part.filter(part.column("ids").is_valid())
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([own.column("batch"), pa.nulls(own.num_rows, pa.binary()), own.column("ids"), own.column("sizes")], names=["batch", "sums", "ids", "sizes"])
            for r in part.select(["batch", "lengths", "tokens", "times", "posts"]).to_pylist():
                if r["tokens"] is None:
                    continue
                raw = {c: unpack(r[c]) for c in ("lengths", "tokens", "times", "posts")}
                lengths = np.frombuffer(raw["lengths"], "<u4")
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                tokens = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(raw["tokens"])).to_pylist()
                if new := list(set(tokens).difference(known)):
                    if len(known) > KNOWN:
                        known.clear()
                        new = list(set(tokens))
                    known.update(zip(new, p.count(new), strict=True))
                n = np.repeat(np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens)), np.frombuffer(raw["times"], "<u4"))
                posts = np.frombuffer(raw["posts"], "<u2")
                if r["batch"] not in held and len(held) == HELD:
                    yield out()
                    held.clear()
                total = np.bincount(posts & 4095, (posts >> 12) * n, BATCH_DOCS).astype("<i4")
                held[r["batch"]] = held[r["batch"]] + total if r["batch"] in held else total
        if held:
            yield out()

    ids = posts.schema["ids"].dataType.simpleString()
    return posts.mapInArrow(run, f"batch long, sums binary, ids {ids}, sizes array<long>")


def token_counts(docs: DataFrame, limit: int = 4096, id_col: str = "doc_id", text: str = "text", vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each whole text.

    Null texts count as empty: no bytes, no tokens. Each input row gives one row, also when rows or ids repeat or the
    id is null; other columns are not carried on. No ids of tokens are made. A frequent word is spread over buckets by
    batch, so its documents are never gathered in one place; it is counted once in each task that has a share of it.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(common.vocabulary_bytes(vocabulary))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # the more tasks, the more buckets
    posts = common.staged(postings(docs, model, buckets, id_col, text), "postings")
    both = sums(posts.repartition("bucket"), model)

    def finish(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, own = np.zeros(BATCH_DOCS, np.int64), None
        for part in parts:
            for blob in part.column("sums"):
                if blob.is_valid:
                    add_sums(total, blob.as_py())
            for i in range(part.num_rows):
                if part.column("ids")[i].is_valid:
                    own = part.column("ids")[i].values, part.column("sizes")[i].values
        n = total[: len(own[0])]
        yield pa.RecordBatch.from_arrays([own[0], own[1], pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    return both.groupBy("batch").applyInArrow(finish, f"{id_col} {id_type}, n_bytes long, n_tokens long, over_limit boolean")
