"""Byte-level BPE encoding and decoding with a rank queue.

Pre-tokens are merged over a doubly linked list of their bytes. A queue holds, for every merge rank
that waits, a bucket of the list positions of its pairs; a three-level bitmap over the ranks (64 ranks
to a word) finds the lowest waiting rank by three find-first-set steps. Positions whose pair has
changed since they were put in are skipped when they come out. All new pre-tokens of a batch share one
list and one queue, so that each rank is one vectorised step for all of them; the work is near linear
in their bytes, however long a single one is.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, steps

#: Distinct pre-tokens that a worker remembers before it starts anew.
CACHE_WORDS = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Read a vocabulary file of lines ``base64(token) rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class RankQueue:
    """Buckets of positions by merge rank; pops the lowest rank with all its positions."""

    def __init__(self, n_ranks: int):
        words = n_ranks // 64 + 1
        self.low = [0] * words
        self.mid = [0] * (words // 64 + 1)
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        word = rank >> 6
        self.low[word] |= 1 << (rank & 63)
        self.mid[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Put each position under its own rank."""
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        ends = [*cuts.tolist(), len(ranks)]
        for rank, lo, hi in zip(ranks[[0, *cuts]].tolist(), [0, *ends], ends):
            self.push(rank, positions[lo:hi])

    def pop(self) -> tuple[int, list[np.ndarray]] | None:
        top = self.top
        if not top:
            return None
        high = (top & -top).bit_length() - 1
        mid = self.mid[high]
        word = (high << 6) + (mid & -mid).bit_length() - 1
        low = self.low[word]
        rank = (word << 6) + (low & -low).bit_length() - 1
        self.low[word] = low & (low - 1)
        if not self.low[word]:
            self.mid[high] = mid & (mid - 1)
            if not self.mid[high]:
                self.top = top & (top - 1)
        return rank, self.buckets.pop(rank)


class PairTable:
    """Rank that two adjacent tokens merge to, as two sorted arrays; -1 if they don't merge."""

    def __init__(self, ranks: dict[bytes, int]):
        found = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        self.keys = np.array(sorted(found), np.int64)
        self.merged = np.array([*map(found.__getitem__, self.keys.tolist()), -1], np.int64)
        self.keys = np.append(self.keys, np.iinfo(np.int64).max)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = left << 32 | right
        at = np.searchsorted(self.keys, pairs)
        return np.where(self.keys[at] == pairs, self.merged[at], -1)


class ByteBpe:
    """Encoder and decoder for one vocabulary and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([c])] for c in range(256)], np.int64)
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, pieces: list[bytes], leftmost: bool = False) -> list[tuple[int, ...]]:
        """Ids of each pre-token.

        All pieces lie in one linked list that has no link from one piece to the next. The lowest
        waiting rank overall is also the lowest of each piece that waits at it, so that one pass over
        the ranks merges all pieces as if each were alone. All positions of a rank merge at once; where
        that makes a pair of a rank that isn't higher, the order within the piece could matter, and
        the piece is merged again with one position, the leftmost, at a time (``leftmost``).
        """
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n = int(lengths.sum())
        token = np.append(self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)], -1)
        last = np.cumsum(lengths) - 1
        after = np.arange(1, n + 2)
        after[last] = n  # place n: no token
        before = np.arange(-1, n)
        before[last + 1] = n
        before[0] = n
        inner = np.ones(n, bool)
        inner[last] = False
        start = np.flatnonzero(inner)
        waits = np.full(n + 1, -1)  # rank of the pair that starts here
        waits[start] = self.pairs.look_up(token[start], token[start + 1])
        start = np.flatnonzero(waits >= 0)
        queue, again = self.queue, set()
        if len(start):
            queue.push_all(waits[start], start)
        while (item := queue.pop()) is not None:
            rank, parts = item
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[waits[at] == rank]
            if not len(at):
                continue
            if leftmost and len(at) > 1:
                at = np.unique(at)
                _, first = np.unique(np.searchsorted(last, at), return_index=True)
                if len(first) < len(at):
                    queue.push(rank, np.delete(at, first))
                at = at[first]
            right = after[at]
            if (waits[right] == rank).any() and not leftmost:  # pairs that overlap: the leftmost of each chain goes first
                at.sort()
                taken, gone = [], -1
                for i, j in zip(at.tolist(), after[at].tolist()):
                    if i != gone:
                        taken.append(i)
                        gone = j
                at = np.array(taken)
                right = after[at]
            stop = after[right]
            token[at] = rank
            token[right] = -1
            waits[right] = -1
            after[at] = stop
            before[stop] = at
            changed = np.concatenate([at, before[at]])
            changed = changed[changed < n]
            to = after[changed]
            new = np.where(to < n, self.pairs.look_up(token[changed], token[to]), -1)
            waits[changed] = new
            some = new >= 0
            if some.any():
                queue.push_all(new[some], changed[some])
                if not leftmost and new[some].min() <= rank:
                    again.update(np.searchsorted(last, changed[some & (new <= rank)]).tolist())
        alive = np.flatnonzero(token[:n] >= 0)
        ids = token[alive].tolist()
        ends = np.searchsorted(alive, last + 1).tolist()
        out = [tuple(ids[lo:hi]) for lo, hi in zip([0, *ends], ends)]
        if again:
            for k, ids in zip(sorted(again), self.merge([pieces[k] for k in sorted(again)], leftmost=True)):
                out[k] = ids
        return out

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts, each match of the pattern encoded by itself."""
        words = [self.find(text) for text in texts]
        known = self.cache
        new = list({w for own in words for w in own if w not in known})
        if new:
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new = list({w for own in words for w in own})
            pieces = [w.encode("utf-8") for w in new]
            whole = [self.ranks.get(p) for p in pieces]
            known.update((w, (r,)) for w, r in zip(new, whole) if r is not None)
            rest = [k for k, r in enumerate(whole) if r is None]
            known.update(zip((new[k] for k in rest), self.merge([pieces[k] for k in rest]) if rest else ()))
        return [list(chain.from_iterable(map(known.__getitem__, own))) for own in words]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode and decode every whole text; one row per document.

    Returns ``doc_id``, ``n_tokens`` long, ``ids_sha256`` (hex of the decimal ids joined by commas),
    ``decoded_sha256`` (hex of the bytes that the ids decode to) and, unless ``with_ids`` is false,
    ``token_ids`` array<int>.

    ``ranks`` is broadcast: its size is that of the vocabulary file, whatever the corpus. Null texts
    count as empty, and empty ones have no ids. Repeated rows each return a row; other columns,
    whatever their names, are not read. There is no shuffle: lost tasks are just run again.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(*shared.value)
        names = {i: str(i) for i in bpe.tokens}
        for batch in steps(batches):
            counts, digests, decoded = [], [], []
            all_ids = bpe.encode_all([t or "" for t in batch.column(1).to_pylist()])
            for ids in all_ids:
                counts.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            fields = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                fields.append("token_ids")
            yield pa.RecordBatch.from_arrays(columns, fields)

    narrow = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return narrow.mapInArrow(run, schema + (", token_ids array<int>" if with_ids else ""))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents under the multilingual public vocabulary."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ranks = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return encode_documents(docs, ranks, public_tokenizers.PATTERN, with_ids=False)
