"""Best-fit decreasing packing of tokenised documents into sequences of 2048 tokens.

Pieces have whole lengths of 1 to 2048, so all that the packing depends on is how many there are of each: a histogram of
2048 counts, made by Spark. On it best-fit decreasing is run with a segment tree over the remaining capacities: the tightest
open bin is found in logarithmic time, and pieces of equal length that follow each other into equally filled bins are placed
in one step. This yields the same bins as placing document after document. The plan says, for each range of ranks among the
pieces of a length, which sequences and places they take; Spark ranks the pieces and looks their places up.

Null and empty texts are a single end token. Repeated rows are pieces of their own. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bucket_rank, id_type, settle, shared_table, spread

CAPACITY = 2048
END = 0
#: The tokenizer's vocabulary by name; its ids are those of ``byte_bpe_50k.json``.
VOCABULARY = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}
#: What the pattern takes for blanks, and how many of them in a row are kept from its matcher, which fails at a million.
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
LONG_RUN = 100_000


def encoder(vocabulary: str = VOCABULARY):
    """Function from a text to its list of ids. The ranks file holds the same vocabulary as the JSON file and is read faster."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    special = re.compile("(" + "|".join(map(re.escape, SPECIAL)) + ")")

    def ordinary(text: str) -> list[int]:
        if len(text) < LONG_RUN:
            return encoding.encode_ordinary(text)
        ids, at = [], 0
        for run in BLANKS.finditer(text):
            if run.end() - run.start() >= LONG_RUN:
                # The pattern splits here as well: a run is one piece, but for its last blank where a word follows.
                until = run.end() - (run.end() < len(text))
                ids += encoding.encode_ordinary(text[at : run.start()])
                ids += encoding._encode_single_piece(text[run.start() : until])
                at = until
        return ids + encoding.encode_ordinary(text[at:])

    def encode(text: str) -> list[int]:
        if not any(name in text for name in SPECIAL):
            return ordinary(text)
        return [i for part in special.split(text) for i in ([SPECIAL[part]] if part in SPECIAL else ordinary(part))]

    return encode


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece; of a document that is cut, the first piece is the short one."""

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            owner, number, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), END], "<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    owner.append(row)
                    number.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(tokenize, f"doc_id {id_type(docs)}, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """A segment tree over remaining capacities; each leaf holds ranges of bins (first, count) with that much room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.size)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _update(self, room: int) -> None:
        at = room + self.size
        self.some[at] = bool(self.ranges[room])
        while at > 1:
            at //= 2
            self.some[at] = self.some[2 * at] or self.some[2 * at + 1]

    def add(self, room: int, first: int, count: int) -> None:
        if count and room:
            self.ranges[room].append((first, count))
            self._update(room)

    def take(self, room: int) -> tuple[int, int]:
        out = self.ranges[room].pop()
        self._update(room)
        return out

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of an open bin that is not below ``length``."""
        at = length + self.size
        if self.some[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.some[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.some[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces per bin, first bin, first offset) of best-fit decreasing, by length and rank."""
    bins, opened, steps = OpenBins(capacity), 0, []
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = bins.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, count = opened, -(-left // each)
                opened += count
            else:
                each = room // length
                first, count = bins.take(room)
            steps.append((length, rank, each, first, capacity - room))
            full = min(count, left // each)
            placed, rest = full * each, 0
            if full < count:
                rest = left - placed if left - placed < each else 0
            bins.add(room - each * length, first, full)
            if rest:
                bins.add(room - rest * length, first + full, 1)
            bins.add(room, first + full + (1 if rest else 0), count - full - (1 if rest else 0))
            rank += placed + rest
            left -= placed + rest
    return steps


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset, one row per piece."""
    settle(docs.sparkSession)
    cut = shared_table(pieces(docs, vocabulary, capacity))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    steps = np.array(plan(counts, capacity) or np.zeros((0, 5)), np.int64)
    shuffle = spread(F.col("doc_id").cast("string"), F.col("piece").cast("string"))
    ranked = bucket_rank(cut, ["length"], shuffle, ["doc_id", "piece", "start", "ids_crc32"], "rank", sum(counts.values()))
    base = (1 << 40, steps[:, 0], steps[:, 1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Steps stand by falling length, then by rank.
        keys = (capacity - base[1]) * base[0] + base[2]
        for batch in batches:
            length, rank = (batch.column(name).to_numpy() for name in ("length", "rank"))
            step = steps[np.searchsorted(keys, (capacity - length) * base[0] + rank, "right") - 1]
            inside = rank - step[:, 1]
            sequence, offset = step[:, 3] + inside // step[:, 2], step[:, 4] + inside % step[:, 2] * length
            columns = [batch.column(name) for name in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    return ranked.select(*columns).mapInArrow(place, f"doc_id {id_type(docs)}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
