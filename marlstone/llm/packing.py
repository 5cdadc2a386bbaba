"""Packing token sequences into windows: order-preserving dynamic programming with a monotone queue.

The documents of a partition, each followed by an end id, form one stream. Cuts may stand at ends of documents (free), at ends of
sentences, and elsewhere at every GRID-th token, for a penalty in tokens of padding: a cut inside a sentence truncates it, so it is only
worth a lot of padding. best(j) = min over i of best(i) + padding of window (i, j] + penalty of j + WINDOW_COST, where the window holds at
most `size` tokens. As padding is size - (P[j] - P[i]), best(j) + P[j] = size + penalty(j) + WINDOW_COST + the least best(i) + P[i] within
reach: a sliding minimum, kept in a monotone queue. A window of a power of two of LEAST_SHORT tokens or more needs no padding: for each such
length that ends at j and begins at a cut, best(i) + P[i] + length + penalty(j) + WINDOW_COST competes. Blocks of the stream are solved one
after the other, so memory is bounded by a block and the longest document, and nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches

SIZE = 1024
GRID = 32
SENTENCE_PENALTY, MIDDLE_PENALTY, WINDOW_COST = 4, 36, 1
LEAST_SHORT = 32
BLOCK = 1 << 18
END_ID = 0

_PIECES = T.StructType(
    [T.StructField("doc_id", T.LongType())] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens")] + [T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
)


def best_cuts(positions: list[int], penalties: list[int], size: int, short: list[list[tuple[int, int]]] | None = None) -> tuple[list[int], list[int]]:
    """positions[0] is the start; neighbours are at most `size` apart. short[j]: the (place, length) of windows that end at j and need no
    padding. Returns each position's best predecessor, and best + position."""
    n = len(positions)
    prev, total = [0] * n, [0] * n
    queue, head = [0], 0
    total[0] = positions[0]
    for j in range(1, n):
        low = positions[j] - size
        while positions[queue[head]] < low:
            head += 1
        i = queue[head]
        v = total[i] + size
        if short is not None:
            for k, length in short[j]:
                if total[k] + length < v:
                    i, v = k, total[k] + length
        v += penalties[j]
        prev[j], total[j] = i, v
        while len(queue) > head and total[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    return prev, total


def short_windows(at: np.ndarray, size: int) -> list[list[tuple[int, int]]]:
    """For each position of `at`, the windows of a power of two of tokens (LEAST_SHORT or more, below size) that end there and begin at one."""
    out: list[list[tuple[int, int]]] = [[] for _ in at]
    length = LEAST_SHORT
    while length < size:
        k = np.minimum(np.searchsorted(at, at - length), len(at) - 1)
        for j in np.flatnonzero(at[k] == at - length).tolist():
            out[j].append((int(k[j]), length))
        length *= 2
    return out


def plan_windows(ids: np.ndarray, ends: np.ndarray, sentence: np.ndarray, size: int, last: bool) -> np.ndarray:
    """Window bounds from 0 on over a stream of ids whose documents end at `ends`. Unless it is the last block, the rest behind the last
    bound waits for the next one. What the last full window leaves is split at powers of two, which need no padding."""
    n = len(ids)
    cost = np.full(n + 1, -1, np.int64)
    step = min(GRID, size)
    cost[step::step] = MIDDLE_PENALTY
    cost[1:][sentence[ids]] = SENTENCE_PENALTY
    cost[ends] = 0
    cost[0] = cost[n] = max(cost[n], 0)
    at = np.flatnonzero(cost >= 0)
    positions, penalties = at.tolist(), (cost[at] + WINDOW_COST).tolist()
    prev, total = best_cuts(positions, penalties, size, short_windows(at, size))
    near = np.searchsorted(at, n - size)
    waste = np.array(total[near:]) - at[near:]
    j = near + int(len(waste) - 1 - np.argmin(waste[::-1]))
    bounds = []
    while j > 0:
        bounds.append(positions[j])
        j = prev[j]
    bounds = [0, *reversed(bounds)]
    if last:
        for bit in reversed(range((n - bounds[-1]).bit_length())):
            if (n - bounds[-1]) >> bit & 1:
                bounds.append(bounds[-1] + (1 << bit))
    return np.array(bounds, np.int64)


def gpt2_encoder(path: str):
    """Encodes texts to the ids that the tokenizers library gives for byte_bpe_50k.json, from the same vocabulary as ranks (several times as fast)."""
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    import public_tokenizers

    special = {"<|endoftext|>": len(ranks)}
    enc = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    sentence = np.zeros(len(ranks) + 1, bool)
    for token, i in ranks.items():
        sentence[i] = token.rstrip(b" ")[-1:] in (b".", b"!", b"?") or b"\n" in token
    return lambda text: enc.encode(text, allowed_special="all"), sentence


def _pack(tokenizer_path: str | None, size: int, with_ids: bool):
    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        if tokenizer_path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.tiktoken")
        else:
            path = tokenizer_path
        encode, sentence = gpt2_encoder(path)
        sequence = TaskContext.get().partitionId() << 40
        docs: list[list] = []  # id, ids of what isn't placed yet, tokens placed, all tokens
        waiting = 0

        def flush(last: bool):
            nonlocal docs, waiting, sequence
            ids = np.concatenate([d[1] for d in docs])
            ends = np.cumsum([len(d[1]) for d in docs])
            begins = np.concatenate(([0], ends[:-1]))
            bounds = plan_windows(ids, ends, sentence, size, last)
            done = int(bounds[-1])
            cut = np.union1d(bounds[:-1], begins[begins < done])
            stop = np.append(cut[1:], done)
            doc = np.searchsorted(begins, cut, side="right") - 1
            window = np.searchsorted(bounds, cut, side="right") - 1
            raw = memoryview(np.ascontiguousarray(ids).view(np.uint8))
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cut.tolist(), stop.tolist())]
            base = np.array([d[2] for d in docs])
            cols = [
                pa.array([docs[i][0] for i in doc.tolist()], pa.int64()),
                cut - begins[doc] + base[doc],
                stop - cut,
                np.array(crc, np.int64),
                np.array([d[3] for d in docs])[doc],
                sequence + window,
                cut - bounds[window],
                np.diff(bounds)[window],
            ]
            cols = [cols[0], *(pa.array(c.astype(np.int64)) for c in cols[1:])]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(cut, done), pa.int32()), pa.array(ids.view(np.int32))))
            else:
                cols.append(pa.nulls(len(cut), pa.list_(pa.int32())))
            sequence += len(bounds) - 1
            left = []
            for d, b, e in zip(docs, begins.tolist(), ends.tolist()):
                if e > done:
                    gone = max(0, done - b)
                    left.append([d[0], d[1][gone:], d[2] + gone, d[3]])
            docs, waiting = left, int(ends[-1]) - done
            out = pa.RecordBatch.from_arrays(cols, names=_PIECES.names)
            for lo in range(0, out.num_rows, 2000):
                yield out.slice(lo, 2000)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), END_ID], np.uint32)
                docs.append([i, ids, 0, len(ids)])
                waiting += len(ids)
                if waiting >= BLOCK:
                    yield from flush(False)
        if docs:
            yield from flush(True)

    return run


def pack(docs: DataFrame, size: int = SIZE, tokenizer_path: str | None = None, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, ids.

    Every id of every document (its tokens and END_ID) is in exactly one piece; a sequence's pieces lie gapless from offset 0. Sequences
    have at most `size` tokens and keep the order of the rows of a partition; a partition's sequences are its own.

    A null text is empty and is END_ID alone; a null doc_id is passed on. Repeated rows are packed as documents of their own. Extra columns
    are ignored. An empty table gives no rows. tokenizer_path names the vocabulary (byte_bpe_50k.tiktoken) if it isn't the installed one.
    with_ids=False leaves ids null.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return in_batches(rows, _pack(tokenizer_path, size, with_ids), _PIECES)
