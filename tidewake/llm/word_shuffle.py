"""A global shuffle of distinct pre-tokens, for work that depends on the pre-token alone.

One pass splits whole texts. A task gathers documents into blocks of about ``BLOCK`` bytes of text and explodes each block
into (1) its distinct words, dealt over buckets by a hash of the whole word, each with its slot number, and (2) its documents as
slots in order of position, or as slots with frequencies. In a bucket's task every distinct word of the corpus is worked on
once and the results take the slots' place; they return to their block, where documents are put together again from their
slots. A frequent word is one entry for each block, so no word is hot; texts never move, and slots, ranked by frequency and
compressed, move as about a byte and a half for each pre-token.

The bytes of the texts, summed up first, give the number of buckets (one for each ``BUCKET`` bytes, ``FAN`` at most) and of the
partitions that blocks return to. So a block sends ``FAN`` packets at most, packets grow with the input, and blocks keep out of
each other's way. A bucket's task remembers up to ``KNOWN`` words and begins anew beyond that: memory is bounded, and in a
bucket with more distinct words than that some are worked on again, with the same result.

A block's id is a hash of its content: a task that runs again over other rows makes other blocks, and a block whose words
don't all return stops the query instead of giving wrong rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import gcd

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import bound_batches, pack, unpack

#: Bytes of text in a block, and pre-tokens in a row of its documents, about.
BLOCK, ROW = 16 << 20, 1 << 17
#: Bytes of text for each bucket of words, the most buckets that a block deals its words to, and words that a bucket's task remembers.
BUCKET, FAN, KNOWN = 32 << 20, 2048, 1 << 20
WORDS, DOCS = 0, 1
ROWS = "spot int, home int, blk binary, kind int, seq int, data binary"
_NAMES = ["spot", "home", "blk", "kind", "seq", "data"]
_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]


class _Slots(dict):
    def __missing__(self, word: str) -> int:
        self[word] = slot = len(self)
        return slot


@dataclass(frozen=True)
class Deal:
    """How many buckets words go to, and how many partitions blocks return to."""

    buckets: int
    homes: int

    @classmethod
    def of(cls, docs: DataFrame, text_col: str) -> Deal:
        """By the bytes of the texts: one pass over them in the JVM."""
        size = docs.select(F.sum(F.octet_length(F.col(text_col).cast("binary")))).first()[0] or 0
        return cls(min(FAN, 1 + size // BUCKET), 1 + 3 * (1 + size // BLOCK))

    def home(self, task: int, k: int) -> int:
        """The partition of a task's k-th block: steps by the golden section keep tasks apart."""
        step = max(1, round(0.618 * self.homes))
        while gcd(step, self.homes) > 1:
            step += 1
        return (task * step + k) % self.homes


class _Block:
    def __init__(self, buckets: int, home: int, counted: bool):
        self.buckets, self.home, self.counted = buckets, home, counted
        self.slots, self.docs, self.size = _Slots(), [], 0

    def add(self, doc_id: int | None, size: int, words: list[str], extra: int) -> None:
        found = np.fromiter(map(self.slots.__getitem__, words), np.uint32, len(words))
        n = None
        if self.counted:
            found, n = np.unique(found, return_counts=True)
        self.docs.append((doc_id, size, extra, found, n))
        self.size += size

    def rows(self) -> Iterator[tuple]:
        words = [w.encode("utf-8", "surrogatepass") for w in self.slots]
        seen = np.zeros(len(words), np.int64)
        for *_, found, n in self.docs:
            np.add.at(seen, found, 1 if n is None else n)
        # by frequency, then by word: similar words are neighbours and compress well
        by_word = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        order = by_word[np.argsort(-seen[by_word], kind="stable")]
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        parts = []
        at = 0
        while at < len(self.docs):
            to, held = at, 0
            while to < len(self.docs) and (to == at or held + len(self.docs[to][3]) <= ROW):
                held += len(self.docs[to][3])
                to += 1
            parts.append(self._documents(self.docs[at:to], rank))
            at = to
        blk = xxhash.xxh3_128_digest(b"".join(parts) + b"\0".join(words))
        spots: list[list[int]] = [[] for _ in range(self.buckets)]
        for slot in order.tolist():
            spots[xxhash.xxh3_64_intdigest(words[slot]) % self.buckets].append(slot)
        for spot, mine in enumerate(spots):
            if mine:
                own = [words[s] for s in mine]
                yield spot, self.home, blk, WORDS, 0, pack(np.diff(rank[mine], prepend=np.uint32(0)), np.fromiter(map(len, own), np.uint32, len(own)), b"".join(own))
        for seq, data in enumerate(parts):
            yield (self.home + seq) % self.buckets, self.home, blk, DOCS, seq, np.uint32(len(words)).tobytes() + data

    def _documents(self, docs: list[tuple], rank: np.ndarray) -> bytes:
        ids = np.array([d[0] or 0 for d in docs], "<i8").tobytes()
        nulls = np.array([d[0] is None for d in docs], np.uint8)
        found, counts = [], []
        for *_, f, n in docs:
            f = rank[f]
            if n is not None:
                by = np.argsort(f)
                f = np.diff(f[by].astype(np.int64), prepend=0).astype(np.uint32)
                counts.append(n[by].astype(np.uint32))
            found.append(f)
        arrays = [np.array([d[k] for d in docs], np.uint32) for k in (1, 2)] + [np.array([len(f) for f in found], np.uint32), np.concatenate(found)]
        return pack(ids, nulls, *arrays, *([np.concatenate(counts)] if counts else []))


def blocks(docs: DataFrame, split: Callable[[str], tuple[list[str], int]], deal: Deal, counted: bool, id_col: str, text_col: str) -> DataFrame:
    """Rows (ROWS) of every text. split gives a text's words and a number to carry along; counted: slots with frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        block = _Block(deal.buckets, deal.home(task, k), counted)
        for b in batches:
            for doc_id, raw in zip(b.column("doc_id"), b.column("text"), strict=True):
                raw = raw.as_py() or b""
                words, extra = split(raw.decode("utf-8", "replace"))
                block.add(doc_id.as_py(), len(raw), words, extra)
                if block.size >= BLOCK:
                    yield from _batches(block.rows())
                    k += 1
                    block = _Block(deal.buckets, deal.home(task, k), counted)
        if block.docs:
            yield from _batches(block.rows())

    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, ROWS)


def _batches(rows: Iterator[tuple], size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += len(r[5])
        if n >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES, strict=True)], _NAMES)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES, strict=True)], _NAMES)


def work(rows: DataFrame, each: Callable[[list[bytes]], list[np.ndarray]], deal: Deal) -> DataFrame:
    """rows with the words of each bucket replaced by what ``each`` gives for them, arrays of numbers; each sees a word of the corpus once (see KNOWN).

    A bucket is a partition of its own, so that buckets don't pile up by chance; documents pass through, spread by their block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}
        for b in batches:
            out = []
            for spot, home, blk, kind, seq, data in zip(*(b.column(c).to_pylist() for c in _NAMES), strict=True):
                if kind == WORDS:
                    slots, lens, text = unpack(data)
                    ends = np.cumsum(lens.astype(np.int64))
                    words = [text[i:j] for i, j in zip((ends - lens).tolist(), ends.tolist(), strict=True)]
                    if len(known) > KNOWN:
                        known.clear()
                    new = [w for w in words if w not in known]
                    known.update(zip(new, each(new), strict=True))
                    got = [known[w] for w in words]
                    data = pack(slots, np.array([len(g) for g in got], np.uint32), np.concatenate(got))
                out.append((spot, home, blk, kind, seq, data))
            yield from _batches(iter(out))

    return rows.repartitionById(deal.buckets, F.col("spot")).mapInArrow(run, ROWS)


class Words:
    """What has come back for the words of a block: values one after another, by slot."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # steps of slots, numbers of values, values

    def close(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each of the n slots its number of values, and all values in the slots' order."""
        if not self.parts:
            slots, lens, values = (np.zeros(0, np.uint32) for _ in range(3))
        else:
            steps, lens, values = zip(*self.parts, strict=True)
            slots, lens, values = np.concatenate([np.cumsum(s, dtype=np.int64) for s in steps]), np.concatenate(lens), np.concatenate(values)
        order = np.argsort(slots, kind="stable")
        kept = np.ones(len(order), bool)  # a block that two tasks made alike comes twice
        kept[1:] = slots[order][1:] != slots[order][:-1]
        order = order[kept]
        if len(order) != n:
            raise RuntimeError("words of a block are missing: its input changed between two runs of a task")
        lens = lens.astype(np.int64)
        starts = (np.cumsum(lens) - lens)[order]
        lens = lens[order]
        at = np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
        return lens, values[at]


def finish(rows: DataFrame, put: Callable[[np.ndarray, np.ndarray], Callable[[list], Iterator[tuple]]], deal: Deal, names: list[str], types: list[pa.DataType], schema: str) -> DataFrame:
    """put(lens, values) of a block's words gives a function from the unpacked arrays of some of its documents to result rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blk, words, made = None, Words(), None
        for b in batches:
            out: list[tuple] = []
            for mine, kind, data in zip(b.column("blk"), b.column("kind").to_pylist(), b.column("data"), strict=True):
                if mine.as_py() != blk:
                    blk, words, made = mine.as_py(), Words(), None
                raw = data.as_py()
                if kind == WORDS:
                    words.parts.append(tuple(unpack(raw)))
                    continue
                if made is None:
                    made = put(*words.close(int(np.frombuffer(raw, "<u4", 1)[0])))
                    words = Words()
                out += made(unpack(raw[4:]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return rows.repartitionById(deal.homes, F.col("home")).sortWithinPartitions("blk", "kind", "seq").mapInArrow(run, schema)
