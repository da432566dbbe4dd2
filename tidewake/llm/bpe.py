"""Byte-level BPE encoding and decoding, and token counts, by the global shuffle of distinct pre-tokens."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.common import table
from tidewake.llm.word_shuffle import Deal, blocks, finish, work

RANKS = "byte_bpe_50k.tiktoken"
COUNTER = "byte_bpe_50k.json"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_CODERS: dict = {}


def _coder(sent, pattern: str):
    """A tiktoken encoding of the broadcast ranks, made once in each worker."""
    key = ("tiktoken", sent.value[0], pattern)
    if key not in _CODERS:
        import tiktoken

        _CODERS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=sent.value[1], special_tokens={})
    return _CODERS[key]


@lru_cache(maxsize=8)
def _pattern(pattern: str):
    return regex.compile(pattern)


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids array<int>]) of every row.

    ids are those of the tiktoken library for the rank file at ``path`` and the pattern that splits text, without special
    tokens; decoded_sha256 is that of the bytes that the ids stand for in the token-byte table. A null text is empty; bytes
    that are no UTF-8 become U+FFFD. Repeated rows and null ids give a row each. Other columns are not read. The rank file is
    read by the driver and sent to the executors once: it is as large as the vocabulary.
    """
    ranks = load_ranks(path)
    name = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast((name, ranks))

    def split(text: str) -> tuple[list[str], int]:
        return _pattern(pattern).findall(text), 0

    def each(words: list[bytes]) -> list[np.ndarray]:
        coder = _coder(sent, pattern)
        return [np.array(coder.encode_ordinary(w.decode("utf-8", "surrogatepass")), np.uint32) for w in words]

    def put(lens: np.ndarray, values: np.ndarray) -> Callable[[list], Iterator[tuple]]:
        ends, flat = np.cumsum(lens * 4).tolist(), values.astype("<u4").tobytes()
        of = [flat[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
        piece = _bytes(sent)

        def made(arrays: list) -> Iterator[tuple]:
            ids, nulls, _, _, sizes, slots = arrays
            at = 0
            for doc, null, n in zip(np.frombuffer(ids, "<i8").tolist(), nulls.tolist(), sizes.tolist(), strict=True):
                own = b"".join(map(of.__getitem__, slots[at : at + n].tolist()))
                at += n
                tokens = np.frombuffer(own, "<u4").tolist()
                back = hashlib.sha256(b"".join(map(piece.__getitem__, tokens))).hexdigest()
                row = (None if null else doc, len(tokens), hashlib.sha256(own).hexdigest(), back)
                yield (*row, tokens) if with_ids else row

        return made

    names, types = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        names, types, schema = [*names, "ids"], [*types, pa.list_(pa.int32())], schema + ", ids array<int>"
    deal = Deal.of(docs, text_col)
    rows = work(blocks(docs, split, deal, False, id_col, text_col), each, deal)
    return finish(rows, put, deal, names, types, schema)


def _bytes(sent) -> list[bytes]:
    """The token-byte table: the bytes of each id."""
    key = ("bytes", sent.value[0])
    if key not in _CODERS:
        out = [b""] * (max(sent.value[1].values(), default=-1) + 1)
        for piece, rank in sent.value[1].items():
            out[rank] = piece
        _CODERS[key] = out
    return _CODERS[key]


def decode(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text binary) of rows with arrays of ids. Null or empty arrays give no bytes; an unknown id stops the query."""
    ranks = load_ranks(path)
    sent = coded.sparkSession.sparkContext.broadcast((hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest(), ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = _bytes(sent)
        for b in batches:
            texts = [b"".join([piece[i] for i in x.as_py() or ()]) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "text"])

    return coded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {coded.schema[id_col].dataType.simpleString()}, text binary")


def count_tokens(docs: DataFrame, path: str, limit: int = 512, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, as the tokenizers library counts with the file at ``path``.

    The file must be byte-level BPE without a normalizer. Its added tokens are cut out of texts first and count one each;
    the pieces of any other pre-token are counted once in the corpus, and a document sums its pre-tokens' counts times their
    frequencies. A null text is empty; repeated rows and null ids give a row each. Other columns are not read.
    """
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    told = json.loads(spec)
    if told.get("normalizer") or told["pre_tokenizer"].get("type") != "ByteLevel" or told["pre_tokenizer"].get("add_prefix_space") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"]):
        raise ValueError("only plain byte-level BPE files are supported")
    special = "|".join(re.escape(t["content"]) for t in sorted(told["added_tokens"], key=lambda t: -len(t["content"])))
    sent = docs.sparkSession.sparkContext.broadcast((hashlib.sha256(spec.encode()).hexdigest(), spec))

    def split(text: str) -> tuple[list[str], int]:
        parts = re.split(special, text) if special else [text]
        find = _pattern(pattern).findall
        return [w for p in parts for w in find(p)] if len(parts) > 1 else find(text), len(parts) - 1

    def each(words: list[bytes]) -> list[np.ndarray]:
        coder, out = _counter(sent), []
        for at in range(0, len(words), 2000):
            got = coder.encode_batch([w.decode("utf-8", "surrogatepass") for w in words[at : at + 2000]], add_special_tokens=False)
            out += [np.array([len(g.ids)], np.uint32) for g in got]
        return out

    def put(_: np.ndarray, pieces: np.ndarray) -> Callable[[list], Iterator[tuple]]:
        pieces = pieces.astype(np.int64)

        def made(arrays: list) -> Iterator[tuple]:
            ids, nulls, sizes, extras, lens, slots, *counts = arrays
            at = 0
            for doc, null, size, extra, n in zip(np.frombuffer(ids, "<i8").tolist(), nulls.tolist(), sizes.tolist(), extras.tolist(), lens.tolist(), strict=True):
                own = np.cumsum(slots[at : at + n].astype(np.int64))
                total = extra + int(pieces[own] @ counts[0][at : at + n].astype(np.int64)) if n else extra
                at += n
                yield None if null else doc, size, total, total > limit

        return made

    deal = Deal.of(docs, text_col)
    rows = work(blocks(docs, split, deal, True, id_col, text_col), each, deal)
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    return finish(rows, put, deal, ["doc_id", "n_bytes", "n_tokens", "over_limit"], types, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def _counter(sent):
    key = ("tokenizers", sent.value[0])
    if key not in _CODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        coder = Tokenizer.from_str(sent.value[1])
        coder.no_padding()
        coder.no_truncation()
        _CODERS[key] = coder
    return _CODERS[key]


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(COUNTER))
