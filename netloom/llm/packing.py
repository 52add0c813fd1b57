"""Packing documents into training sequences: several context sizes, gaps filled from shorter ones, balanced steps.

A document is tokenised whole and ends with an end token. What fills whole windows of the longest size is cut off;
the rest is routed to the smallest of the ``TIERS`` that holds it. Tiers are packed from the longest down: each
window starts with the longest piece left, and its gap takes the longest piece of the shorter tiers that fits, again
and again. Where none fits, a piece is cut; its rest goes back to the tier of its new length. So every window is full; the last
pieces of a batch, when nothing is left to fill with, are cut into powers of two. No sequence needs padding.

A task packs its own documents in batches of about ``BATCH_TOKENS`` tokens, so that it holds a batch (or one longer
document) and nothing is shuffled for it. Sequences then are sorted by tier and attention cost (sum of squared piece lengths)
over the whole table, and each ``STEP_TOKENS`` tokens of like cost make a step: workers that share a step get equal work.

Tokens are those of the ``tokenizers`` library, found once for each distinct piece of text between boundaries that its pattern can't
cross (of short pieces by ``tiktoken``, which gives the same ids faster).
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, numbered
from .common import bounded_batches, steps, table

#: Context sizes, longest first; the id that ends a document.
TIERS, END = (2048, 1024, 512, 256), 1
#: Tokens that a task packs at once, tokens of a step.
BATCH_TOKENS, STEP_TOKENS = 4 << 20, 1 << 19
#: Pieces that a worker remembers, about; characters of short pieces at most, and from which long ones are split before they are encoded.
REMEMBERED, SHORT_PIECE, LONG_PIECE = 1 << 20, 64, 1 << 16
#: UTF-8 bytes of text encoded at once.
BYTES_AT_ONCE = 8 << 20

#: A place in front of white space (as the pattern of byte-level vocabularies has it) that follows anything else.
BEFORE_SPACE = re.compile(r"(?<=\S)(?=[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000])")
#: Stands in front of spaces and line ends while texts are split there.
CUT, CUTS = "\0", re.compile("(?=[ \n])")


def _short_encoder(vocabulary: dict) -> Callable[[str], list[int]] | None:
    """A faster encoder of short pieces with the same ids, for vocabularies whose ids rise in the order of the merges; else None.

    Then the order of ids ranks the merges, which is what ``tiktoken`` goes by.
    """
    import public_tokenizers
    import tiktoken

    model, split = vocabulary.get("model", {}), vocabulary.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not vocabulary.get("normalizer")
    if model.get("type", "BPE") != "BPE" or not plain:
        return None
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    order = [model["vocab"][t] for t in merged]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    as_byte = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}
    single = [model["vocab"].get(c) for c in as_byte]
    if order != sorted(set(order)) or None in single or max(single) > min(order, default=256):
        return None
    ranks = {bytes(as_byte[c] for c in t): model["vocab"][t] for t in [*as_byte, *merged]}
    return tiktoken.Encoding("short", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Encoder:
    """Ids of whole texts by a byte-level vocabulary (the text of its ``tokenizers`` file).

    White space may start a pre-token but never follows anything else in one, so that texts may be cut in front of
    it. They are split at such spaces and line ends; every distinct piece is encoded once and then looked up.
    """

    def __init__(self, vocabulary: str, end: int = END):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True  # strings of special tokens are ordinary text
        self.short = _short_encoder(json.loads(vocabulary))
        self.end = end
        self._forget()

    def _forget(self) -> None:
        """Piece 0 is the end token; ``starts`` and ``sizes`` tell where the ids of a piece lie in ``flat``."""
        self.known: dict[str, int] = {}
        self.flat, self.n_flat = np.full(1 << 16, self.end, np.uint32), 1
        self.starts, self.sizes, self.n = np.zeros(1 << 12, np.int64), np.ones(1 << 12, np.int64), 1

    def _ids(self, texts: list[str]) -> list[list[int]]:
        if self.short is None:
            return self._long_ids(texts)
        ids = [self.short(t) if len(t) <= SHORT_PIECE else None for t in texts]
        if rest := [k for k, found in enumerate(ids) if found is None]:
            for k, found in zip(rest, self._long_ids([texts[k] for k in rest])):
                ids[k] = found
        return ids

    def _long_ids(self, texts: list[str]) -> list[list[int]]:
        cut = [BEFORE_SPACE.split(t) if len(t) > LONG_PIECE else [t] for t in texts]
        found = iter(self.tokenizer.encode_batch_fast([p for c in cut for p in c], add_special_tokens=False))
        return [next(found).ids if len(c) == 1 else [i for _ in c for i in next(found).ids] for c in cut]

    def _add(self, new: list[str]) -> None:
        """Encode the pieces ``new`` and note their numbers."""
        for lo in range(0, len(new), 4096):
            some = new[lo : lo + 4096]
            ids = self._ids(some)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            total = int(sizes.sum())
            if self.n_flat + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat), total), np.uint32)])
            if self.n + len(ids) > len(self.sizes):
                self.starts, self.sizes = (np.concatenate([x, np.empty(max(len(x), len(ids)), np.int64)]) for x in (self.starts, self.sizes))
            self.flat[self.n_flat : self.n_flat + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
            self.sizes[self.n : self.n + len(ids)] = sizes
            self.starts[self.n : self.n + len(ids)] = self.n_flat + np.cumsum(sizes) - sizes
            self.known.update(zip(some, range(self.n, self.n + len(ids))))
            self.n, self.n_flat = self.n + len(ids), self.n_flat + total

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end token, and the number of ids of each text; a null text is empty."""
        if self.n > REMEMBERED:
            self._forget()
        texts = pc.fill_null(texts, "")
        marked = pc.replace_substring(pc.replace_substring(texts, "\n", CUT + "\n"), " ", CUT + " ")
        parts = pc.split_pattern(marked, CUT)
        pieces = pc.list_flatten(parts).dictionary_encode()
        names, codes = pieces.dictionary.to_pylist(), pieces.indices.to_numpy(zero_copy_only=False)
        n_parts = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(n_parts)), n_parts)
        # what follows a piece that is empty or ends in white space belongs to it
        open_ = np.fromiter((not p or p[-1].isspace() for p in names), bool, len(names))
        odd = set(owner[open_[codes]].tolist()) | set(np.flatnonzero(pc.match_substring(texts, CUT).to_numpy(zero_copy_only=False)).tolist())
        own = {k: _rejoined(texts[k].as_py()) for k in sorted(odd)}
        self._add(sorted(set(names).union(*own.values()).difference(self.known)))
        number = self.known.__getitem__
        rows = np.fromiter(map(number, names), np.int64, len(names))[codes]
        if own:
            stays = ~np.isin(owner, list(own))
            rows = np.concatenate([rows[stays], *(np.fromiter(map(number, p), np.int64, len(p)) for p in own.values())])
            owner = np.concatenate([owner[stays], np.repeat(list(own), list(map(len, own.values())))])
            order = np.argsort(owner, kind="stable")
            rows, owner = rows[order], owner[order]
        found, rows = rows, np.zeros(len(rows) + len(n_parts), np.int64)
        rows[np.arange(len(found)) + owner] = found  # what is left behind each text is its end token
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[rows] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.diff(ends[rows == 0], prepend=0)


def _rejoined(text: str) -> list[str]:
    """Pieces of a text, cut in front of spaces and line ends that follow anything but white space."""
    out = [""]
    for part in CUTS.split(text):
        if out[-1] and not out[-1][-1].isspace():
            out.append(part)
        else:
            out[-1] += part
    return out


@lru_cache(1)
def encoder(vocabulary: str, end: int) -> Encoder:
    """One encoder for all tasks of a worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what runs side by side
    return Encoder(vocabulary, end)


def pack(sizes: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold documents of ``sizes`` tokens, each token once.

    A sequence has the length of a tier; only the last ones may be shorter powers of two.
    """
    longest = tiers[0]
    if list(tiers) != sorted(set(tiers), reverse=True) or any(t < 1 or t & (t - 1) for t in tiers):
        raise ValueError("tiers must be falling powers of two")
    out = [[(d, at, longest)] for d, n in enumerate(sizes) for at in range(0, n - n % longest, longest)]
    pool: list[list[tuple[int, int, int]]] = [[] for _ in range(longest)]
    for d in range(len(sizes) - 1, -1, -1):
        if rest := sizes[d] % longest:
            pool[rest].append((d, sizes[d] - rest, rest))
    held = sum(1 << n for n, pieces in enumerate(pool) if pieces)  # bit n: there are pieces of length n

    def take(n: int) -> tuple[int, int, int]:
        nonlocal held
        piece = pool[n].pop()
        if not pool[n]:
            held &= ~(1 << n)
        return piece

    while held:
        piece = take(held.bit_length() - 1)
        tier = min(t for t in tiers if t >= piece[2])
        window, gap = [piece], tier - piece[2]
        while gap and held:
            if fits := held & ((2 << gap) - 1):
                window.append(take(fits.bit_length() - 1))
                gap -= window[-1][2]
                continue
            above = held >> gap
            d, at, n = take(gap + (above & -above).bit_length() - 1)  # the shortest one that is too long
            window.append((d, at, gap))
            pool[n - gap].append((d, at + gap, n - gap))
            held |= 1 << (n - gap)
            gap = 0
        if not gap:
            out.append(window)
            continue
        room, part = 1 << ((tier - gap).bit_length() - 1), []  # nothing is left to fill with
        for d, at, n in window:
            while n:
                some = min(n, room - sum(p[2] for p in part))
                part.append((d, at, some))
                at, n = at + some, n - some
                if sum(p[2] for p in part) == room:
                    out.append(part)
                    gap += room
                    room, part = 1 << max((tier - gap).bit_length() - 1, 0), []
    return out


def _packed(vocabulary, end: int, tiers: tuple[int, ...], batch_tokens: int, kind: pa.DataType):
    """Over rows (doc_id, text): pieces of the task's documents."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, first = encoder(vocabulary.value, end).encode, TaskContext.get().partitionId() << 33
        docs, ids, held = [], [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal docs, ids, held, first
            sequences = pack([len(x) for x in ids], tiers)
            for lo in range(0, len(sequences), 4096):
                rows = []
                for k, pieces in enumerate(sequences[lo : lo + 4096], first + lo):
                    offset, tier, cost = 0, sum(p[2] for p in pieces), sum(p[2] ** 2 for p in pieces)
                    for d, at, n in pieces:
                        rows.append((docs[d], at, n, zlib.crc32(ids[d][at : at + n]), len(ids[d]), k, offset, tier, cost))
                        offset += n
                doc, *rest = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(doc, kind), *(pa.array(c, pa.int64()) for c in rest)], names)
            first, docs, ids, held = first + len(sequences), [], [], 0

        for batch in steps(batches, most=BYTES_AT_ONCE):
            flat, sizes = encode(batch.column(1))
            docs += batch.column(0).to_pylist()
            ids += np.split(flat.astype("<u4"), np.cumsum(sizes)[:-1])
            held += len(flat)
            if held >= batch_tokens:
                yield from packed()
        if ids:
            yield from packed()

    return run


def balanced(pieces: DataFrame, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """``pieces`` with the ``step`` of their sequence: sequences of a tier in order of attention cost, ``step_tokens`` tokens each.

    Steps are numbered in each tier; a tier's last one may be smaller.
    """
    order = numbered(pieces.filter("offset = 0").select("tier", "cost", "sequence_id"), "tier", "cost", "sequence_id")
    firsts = order.groupBy("tier").agg(F.min("n").alias("first"))  # a dozen rows: tiers and smaller powers of two
    step = F.expr(f"(n - first) div greatest({step_tokens} div tier, 1)")
    named = order.join(F.broadcast(firsts), "tier").select("sequence_id", step.alias("step"))
    return pieces.join(named, "sequence_id")


def pack_documents(docs: DataFrame, vocabulary: str, end: int = END, tiers: tuple[int, ...] = TIERS, batch_tokens: int = BATCH_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Pieces of every row of ``docs`` packed into sequences: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset``, ``tier`` (the sequence's length) and ``step``.

    ``vocabulary`` is the text of a ``tokenizers`` file. A null or empty text is a document of one token, its ``end``. Rows
    that repeat are documents of their own, as are null ids. An empty table gives an empty result. Only ``doc_id`` and
    ``text`` are read. Sequence ids are unique and rise within a task; they aren't consecutive.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    narrow = docs.select("doc_id", "text")
    kind = narrow.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    run = _packed(spark.sparkContext.broadcast(vocabulary), end, tiers, batch_tokens, to_arrow_type(kind))
    schema = f"doc_id {kind.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier bigint, cost bigint"
    pieces = materialize(narrow.mapInArrow(run, schema), "pieces")
    return balanced(pieces, step_tokens).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens that hold all documents."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return pack_documents(table(spark, sf_dir, "documents"), f.read())
