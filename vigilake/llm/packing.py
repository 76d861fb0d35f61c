"""Lexical retrieval packing: documents fill token windows beside their nearest unused neighbours by BM25.

Whole windows of a long document stand by themselves; what is left of each document (under one window) is dealt out by
its most telling token, so that alike documents land in one shard. A shard is a bounded number of documents with an
inverted index over all their tokens. Each seed asks the index for its unused neighbours, best first, until its window
is full; the neighbour that no longer fits is cut, and its rest is the next seed. So windows have no padding, and the
last tokens of a shard go into windows whose lengths are powers of two.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import cache, cached_property
from pathlib import Path

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm.storage import written

WINDOW = 2048
#: Documents of one shard's index.
SHARD_DOCS = 512
#: BM25's usual constants.
K1, B = 1.2, 0.75
#: The pattern by which a byte-level BPE of this kind splits text before its merges, written without steps back, in which
#: it gives the same pieces in less time.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

PIECE_SCHEMA = (
    "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
_ROWS = "kind int, doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, ids binary, top int"


def _byte_ranks(path: str) -> dict[bytes, int] | None:
    """Token bytes -> id of a byte-level BPE file, or None if it changes or splits texts otherwise than by PIECES, or its
    merges don't run in the order of the ids."""
    file = json.loads(Path(path).read_text())
    model, split = file["model"], file.get("pre_tokenizer") or {}
    as_bytes = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    plain_bpe = model.get("type", "BPE") == "BPE" and not any(
        model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")
    )
    if file.get("normalizer") or not as_bytes or not plain_bpe:
        return None
    # each byte is written as a letter: printable ones as they are, the others from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*plain}))}
    vocab, merges = model["vocab"], [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    made = [vocab[m.replace(" ", "")] for m in merges]
    if made != sorted(set(made)):
        return None
    return {bytes(letters[c] for c in token): k for token, k in vocab.items() if all(c in letters for c in token)}


class _Encoder:
    """Ids as the `tokenizers` library gives them for the file.

    A byte-level BPE's merges are run by tiktoken, from the same file's vocabulary and to the same ids, in a fifth of
    the time; texts that spell a special token, and files of another kind, go to `tokenizers`.
    """

    def __init__(self, path: str):
        self.path = path
        self.special = [t["content"] for t in json.loads(Path(path).read_text()).get("added_tokens", ())]
        ranks = _byte_ranks(path)
        for s in self.special:
            ranks and ranks.pop(s.encode(), None)
        self.fast = ranks and tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def whole(self):
        """The library's own tokenizer; it takes memory, and few workers meet a text that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> np.ndarray:
        if not self.fast or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


@cache
def encoder(path: str) -> _Encoder:
    """One encoder for each worker and file."""
    return _Encoder(path)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def _cut_documents(tokenizer: str, end_id: int, window: int) -> Callable:
    """Kind 0: whole windows, with their sequence; kind 1: the rest of a document, with its ids; kind 2: for a part of
    the table, how many documents hold each token."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, sequence = encoder(tokenizer), (1 << 62) | (TaskContext.get().partitionId() << 36)
        held, last = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id))
                n = len(ids)
                most, places = int(ids.max()), np.arange(n)
                if most >= len(held):
                    held, last = (np.pad(x, (0, most + 1 - len(x))) for x in (held, last))
                last[ids] = places
                held[ids[last[ids] == places]] += 1  # each token where it stands last
                whole = n - n % window
                for start in range(0, whole, window):
                    rows.append((0, doc_id, start, window, _crc(ids[start : start + window]), n, sequence, None, None))
                    sequence += 1
                if whole < n:
                    rows.append((1, doc_id, whole, n - whole, None, n, None, ids[whole:].astype("<u4").tobytes(), None))
            yield _frame(rows)
        some = np.flatnonzero(held)
        if len(some):
            counts = np.column_stack([some, held[some]]).astype("<i8")
            yield _frame([(2, None, None, None, None, None, None, counts.tobytes(), None)])

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["kind", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "ids", "top"]
    longs = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "top"]
    return pd.DataFrame(rows, columns=names, dtype=object).astype(dict.fromkeys(longs, "Int64"))


def _token_counts(rows: DataFrame) -> dict[int, int]:
    """Token -> documents that hold it, over all documents; as many entries as the vocabulary has at most."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["ids"]:
                pair = np.frombuffer(data, "<i8").reshape(-1, 2)
                yield pd.DataFrame({"token": pair[:, 0], "n": pair[:, 1]})

    counts = rows.where("kind = 2").select("ids").mapInPandas(spread, "token long, n long")
    return {r["token"]: r["n"] for r in counts.groupBy("token").agg(F.sum("n").alias("n")).collect()}


class Index:
    """An inverted index with BM25 weights over the tokens of a shard's documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray):
        parts = [np.unique(ids, return_counts=True) for ids in docs]
        self.terms = [t for t, _ in parts]
        token = np.concatenate(self.terms)
        tf = np.concatenate([c for _, c in parts]).astype(np.float64)
        doc = np.repeat(np.arange(len(docs)), [len(t) for t in self.terms])
        length = np.array([len(ids) for ids in docs], np.float64)
        norm = K1 * (1 - B + B * length / length.mean())
        order = np.argsort(token, kind="stable")
        self.doc = doc[order]
        self.weight = (idf[token] * tf * (K1 + 1) / (tf + norm[doc]))[order]
        self.known, first = np.unique(token[order], return_index=True)
        self.first = np.append(first, len(token))

    def scores(self, query: np.ndarray) -> np.ndarray:
        """BM25 of every document of the shard for the distinct tokens `query`, each of which is in the index."""
        at = np.searchsorted(self.known, query)
        lo, n = self.first[at], self.first[at + 1] - self.first[at]
        rows = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
        return np.bincount(self.doc[rows], self.weight[rows], len(self.terms))


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences, each a list of (document number, first id, end id), that hold every id of `docs` once.

    All but the last few are full; those have lengths that are powers of two.
    """
    index = Index(docs, idf)
    unused = np.ones(len(docs), bool)
    ahead = 0  # documents before it are used
    seed, start, piece, room = -1, 0, [], window
    while True:
        if seed < 0:
            while ahead < len(docs) and not unused[ahead]:
                ahead += 1
            if ahead == len(docs):
                break
            seed, start, unused[ahead] = ahead, 0, False
        here = min(room, len(docs[seed]) - start)
        piece.append((seed, start, start + here))
        room -= here
        rest = start + here if start + here < len(docs[seed]) else -1
        if room:  # neighbours of the seed, best first, until the window is full
            scores = index.scores(index.terms[seed])
            scores[~unused] = -1
            best = np.argsort(-scores, kind="stable")[: int(unused.sum())]
            for k in best.tolist():
                here = min(room, len(docs[k]))
                piece.append((k, 0, here))
                unused[k] = False
                room -= here
                if not room:
                    rest = here if here < len(docs[k]) else -1
                    seed = k
                    break
        if room:
            break
        yield piece
        piece, room = [], window
        seed, start = (seed, rest) if rest >= 0 else (-1, 0)
    yield from _powers_of_two(piece)


def _powers_of_two(piece: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    left = sum(b - a for _, a, b in piece)
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        made = []
        while room:
            k, a, b = piece.pop(0)
            made.append((k, a, min(b, a + room)))
            room -= made[-1][2] - a
            if made[-1][2] < b:
                piece.insert(0, (k, made[-1][2], b))
        yield made


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    end_id: int = 1,
    shard_docs: int = SHARD_DOCS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents' ids (those of the text by the `tokenizers` file `tokenizer`, then `end_id`): doc_id,
    start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one `end_id`. Repeated rows and rows with equal or null ids are documents each. An empty
    table gives no pieces. Other columns aren't returned. Document frequencies cover all documents. The rows before
    packing are written once, so that a lost executor's work comes out the same again.
    """
    id_type = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = texts.mapInPandas(_cut_documents(tokenizer, end_id, window), _ROWS.format(id=id_type))
    rows = written(rows, "cut")
    counts = _token_counts(rows)
    idf = np.zeros(max(counts, default=0) + 1)
    n = counts.get(end_id, 0)  # every document has it
    for token, df in counts.items():
        idf[token] = np.log(1 + (n - df + 0.5) / (df + 0.5))
    # a token of one document alone finds no neighbour
    telling = np.where(np.isin(np.arange(len(idf)), [t for t, df in counts.items() if df > 1]), idf, -1)
    shared = docs.sparkSession.sparkContext.broadcast((idf, telling))

    @F.pandas_udf("int")
    def top(column: pd.Series) -> pd.Series:
        tell = shared.value[1]
        found = (np.frombuffer(data, "<u4") for data in column)
        return pd.Series([int(ids[np.argmax(tell[ids])]) for ids in found], dtype="int32")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sequence = TaskContext.get().partitionId() << 36
        held, n = [], 0

        def shard(part: pd.DataFrame) -> pd.DataFrame:
            nonlocal sequence
            ids = [np.frombuffer(data, "<u4") for data in part["ids"]]
            first, total, names = part["start"].tolist(), part["doc_tokens"].tolist(), part["doc_id"].tolist()
            out = []
            for pieces in pack_shard(ids, shared.value[0], window):
                offset = 0
                for k, a, b in pieces:
                    out.append((names[k], first[k] + a, b - a, _crc(ids[k][a:b]), total[k], sequence, offset))
                    offset += b - a
                sequence += 1
            columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pd.DataFrame(out, columns=columns)

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n < shard_docs:
                continue
            both = pd.concat(held, ignore_index=True)
            whole = n - n % shard_docs
            for at in range(0, whole, shard_docs):
                yield shard(both.iloc[at : at + shard_docs])
            held, n = [both.iloc[whole:]], n - whole
        if n:
            yield shard(pd.concat(held, ignore_index=True))

    rests = rows.where("kind = 1").select("doc_id", "start", "doc_tokens", "ids", top("ids").alias("top"))
    # the hash splits a token that very many documents share
    dealt = rests.repartitionByRange("top", F.xxhash64("ids", "doc_id")).sortWithinPartitions("top", F.xxhash64("ids", "doc_id"))
    pieces = dealt.drop("top").mapInPandas(packed, PIECE_SCHEMA.format(id=id_type))
    alone = rows.where("kind = 0").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset")
    )
    return pieces.unionByName(alone).withColumnRenamed("doc_id", id_col)
