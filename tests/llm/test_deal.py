"""The word shuffle's packets, partitions and memory."""

import numpy as np
import public_tokenizers
import pytest

from tests.llm import brute
from tidewake.llm import bpe, word_shuffle
from tidewake.llm.word_shuffle import WORDS, Deal, _Block


def packets(texts, deal, size):
    """What blocks of about ``size`` bytes send: packets of words for each block."""
    out, block = [], _Block(deal.buckets, 0, False)
    for k, t in enumerate(texts):
        block.add(k, len(t), t.split(), 0)
        if block.size >= size:
            out.append(list(block.rows()))
            block = _Block(deal.buckets, 0, False)
    return [[r for r in rows if r[3] == WORDS] for rows in out]


def test_packets_grow_with_the_input(monkeypatch):
    """Beyond FAN buckets a block's packets stay the same, so four times the text makes four times the packets."""
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 200) % 5000) for _ in range(800)]
    counts = []
    for n in (200, 800):
        sent = packets(texts[:n], Deal(8, 1), 20_000)
        assert max(map(len, sent)) <= 8
        counts.append(sum(map(len, sent)) / sum(map(len, texts[:n])))
    assert counts[0] == pytest.approx(counts[1], rel=0.05)


def test_words_that_begin_alike_spread():
    texts = [" ".join(f"samestart{k}" for k in range(4000))]
    sizes = [len(r[5]) for r in packets(texts, Deal(16, 1), 1)[0]]
    assert len(sizes) == 16 and max(sizes) < 2 * min(sizes)


def test_buckets_and_partitions_follow_the_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "x" * 1000) for k in range(64)] + [(99, None)], "doc_id long, text string")
    monkeypatch.setattr(word_shuffle, "BUCKET", 8000)
    monkeypatch.setattr(word_shuffle, "BLOCK", 4000)
    assert Deal.of(docs, "text") == Deal(9, 52)
    monkeypatch.setattr(word_shuffle, "FAN", 4)
    assert Deal.of(docs, "text").buckets == 4 and Deal.of(docs.where("false"), "text") == Deal(1, 4)


@pytest.mark.parametrize("tasks, blocks", [(5, 4), (32, 2), (17, 1), (1, 50)])
def test_blocks_keep_out_of_each_others_way(tasks, blocks):
    deal = Deal(1, 1 + 3 * tasks * blocks)
    held = np.bincount([deal.home(t, k) for t in range(tasks) for k in range(blocks)], minlength=deal.homes)
    assert held.max() <= 2 and (held > 1).sum() <= tasks * blocks // 4


def test_a_task_that_forgets_words_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(brute.awkward(3000), brute.SCHEMA).repartition(3, "n")
    path = public_tokenizers.path(bpe.RANKS)
    want = sorted(map(repr, bpe.encode(docs, path).collect()))
    seen = []

    def each(words):
        seen.append(len(words))
        return [np.array([len(w)], np.uint32) for w in words]

    class Frame:  # what a bucket's task runs, without Spark
        def repartitionById(self, *_):
            return self

        def mapInArrow(self, run, _):
            self.run = run
            return self

    monkeypatch.setattr(word_shuffle, "KNOWN", 10)
    monkeypatch.setattr(word_shuffle.F, "col", lambda c: c)
    made = word_shuffle.work(Frame(), each, Deal(1, 1))
    blocks = []
    for own in ("a b c d e f g h i j k l", "a b c", "x y z a"):
        block = _Block(1, 0, False)
        block.add(1, 9, own.split(), 0)
        blocks += list(word_shuffle._batches(block.rows()))
    rows = [r for b in made.run(iter(blocks)) for r in b.to_pylist() if r["kind"] == WORDS]
    assert seen == [12, 3, 3] and [word_shuffle.unpack(r["data"])[2].tolist() for r in rows] == [[1] * 12, [1] * 3, [1] * 4]
    monkeypatch.undo()
    assert want == sorted(map(repr, bpe.encode(docs, path).collect()))
