"""Removal of the bytes under every 400-byte string that starts more than once, by suffix arrays.

Equal strings are brought together first. Of the 32-byte grams of a 400-byte window the one with the least hash, the leftmost of
equal ones, is its anchor; equal windows have equal anchors at equal places. A run of windows around one anchor is a piece of text.
Pieces whose anchor occurs once are done. The others are dealt by anchor to buckets of some ``BUCKET_BYTES``; a bucket's pieces are one
string, whose suffixes are ordered by two-stage sorting (see ``suffix_array``). Neighbours with 400 common bytes are windows that repeat.

A task sends the bytes of one piece once and that it met it again at most once; pieces equal in 128 bits of BLAKE2b are one piece. So
copies do not crowd a bucket. Where the unlike pieces of one anchor have more than ``CROWDED`` bytes (a short passage in very many
texts), their windows are counted one by one by 128 bits of hash, spread over all tasks, which gives the same answer.

Matches do not cross rows. Null and empty texts have no bytes and nothing to remove. Repeated rows are rows of their own: each makes
all windows of the other repeat. Null ids are ids. An empty table gives no rows; other columns are not read. A very long text is
anchored in segments, and its bytes are held once more where they are cut.

Anchors that repeat pass a bitmap of at most 16 MB. Beyond some 30 million of them ever more pieces with a single anchor are dealt
too (all of them are 3.2 times the text): this costs shuffle, and loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import id_type, keyed_texts, same_row, settle, shared_table
from .sketch import bitmap
from .suffix_array import common_prefixes, eight_bytes, suffix_order
from .words import U, _BYTE_CODES, _BYTE_MULTS, _range_hashes, in_bits, signed, text_groups

SPAN = 400
GRAM = 32
WIDTH = SPAN - GRAM + 1
#: Window starts that are anchored at once; a place in a segment takes 20 bits.
SEGMENT = 1 << 19
BUCKET_BYTES = 1 << 20
CROWDED = 1 << 20
#: Pieces that a task remembers, to send their bytes once.
REMEMBERED = 500_000
#: Crowded anchors up to this number are sent to every task; beyond it they are joined by shuffle.
BROADCAST_ROWS = 100_000


def _anchored(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first and last window start, and anchor of every piece."""
    parts = [[np.zeros(0, np.int64)] * 3 + [np.zeros(0, U)]]
    for lo in range(0, max(0, len(buf) - SPAN + 1), SEGMENT):
        data = buf[lo : lo + SEGMENT + SPAN - 1]
        at = np.arange(len(data) - GRAM + 1)
        grams = _range_hashes(_BYTE_CODES[0][data], at, at + GRAM, _BYTE_MULTS[0])
        least, reach = (grams & ~U((1 << 20) - 1)) | at.astype(U), 1
        while 2 * reach <= WIDTH:
            least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
        if WIDTH > reach:
            least = np.minimum(least[: reach - WIDTH], least[WIDTH - reach :])
        start = np.arange(len(least))
        text = np.searchsorted(offsets, start + lo, "right") - 1
        inside = start + lo + SPAN <= offsets[text + 1]
        start, text, chosen = start[inside], text[inside], (least[inside] & U((1 << 20) - 1)).astype(np.int64)
        if not len(start):
            continue
        new = np.r_[True, (chosen[1:] != chosen[:-1]) | (start[1:] != start[:-1] + 1)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(start)] - 1
        parts.append([text[first], start[first] + lo, start[last] + lo, grams[chosen[first]]])
    return tuple(np.concatenate(x) for x in zip(*parts))


def repeated_anchors(docs: DataFrame) -> DataFrame:
    """Anchors (a) of two pieces or more."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _lo, _hi, buf, offsets in text_groups(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(signed(_anchored(buf, offsets)[3]))], names=["a"])

    met = docs.select("text").mapInArrow(find, "a long").groupBy("a").agg(F.count("*").alias("n"))
    return met.filter("n > 1").select("a")


def suspect_pieces(docs: DataFrame, anchors: np.ndarray) -> DataFrame:
    """Every piece whose anchor passes the bitmap: doc_id, k, start in its text, hash (h1, h2), anchor a, length n. ``bytes`` where the
    task meets it first, and ``again`` where it meets it for the second time."""
    sent = docs.sparkSession.sparkContext.broadcast(anchors)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, bool] = {}
        for batch in batches:
            for lo, _hi, buf, offsets in text_groups(batch.column(2)):
                text, first, last, anchor = _anchored(buf, offsets)
                some = np.flatnonzero(in_bits(sent.value, anchor))
                if len(seen) > REMEMBERED:
                    seen.clear()
                data, content, again, digests = buf.tobytes(), [], [], []
                for a, b in zip(first[some].tolist(), (last[some] + SPAN).tolist()):
                    piece = data[a:b]
                    digest = blake2b(piece, digest_size=16).digest()
                    content.append(piece if digest not in seen else None)
                    again.append(seen.get(digest, False))
                    seen[digest] = digest not in seen
                    digests.append(digest)
                hashes = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                rows = pa.array(text[some] + lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows), batch.column(1).take(rows), pa.array(first[some] - offsets[text[some]]),
                        pa.array(np.ascontiguousarray(hashes[:, 0])), pa.array(np.ascontiguousarray(hashes[:, 1])), pa.array(signed(anchor[some])),
                        pa.array((last - first)[some] + SPAN), pa.array(content, pa.binary()), pa.array(again, pa.bool_()),
                    ],
                    names=["doc_id", "k", "start", "h1", "h2", "a", "n", "bytes", "again"],
                )

    schema = f"doc_id {id_type(docs)}, k long, start long, h1 long, h2 long, a long, n long, bytes binary, again boolean"
    return keyed_texts(docs).mapInArrow(find, schema)


def _runs(piece: np.ndarray, place: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> pa.Table:
    """(h1, h2, lo, hi): maximal runs of places of each piece."""
    order = np.lexsort((place, piece))
    piece, place = piece[order], place[order]
    new = np.r_[True, (piece[1:] != piece[:-1]) | (place[1:] != place[:-1] + 1)] if len(piece) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(piece)] - 1 if len(first) else first
    return pa.table({"h1": h1[piece[first]], "h2": h2[piece[first]], "lo": place[first].astype(np.int64), "hi": place[last].astype(np.int64)})


def _sorted_bucket(rows):
    """Runs of repeated window starts of a bucket's pieces, from the suffix array of all of them."""
    h1, h2 = rows["h1"].to_numpy(), rows["h2"].to_numpy()
    order = np.lexsort((rows["bytes"].is_null().to_numpy(), h2, h1))
    new = np.r_[True, (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])]
    weight = np.diff(np.r_[np.flatnonzero(new), len(order)])
    kept = order[new]
    content = rows["bytes"].take(pa.array(kept)).to_pylist()
    text = np.frombuffer(b"".join(content), np.uint8)
    ends = np.cumsum([len(x) for x in content])
    piece = np.repeat(np.arange(len(kept)), np.diff(np.r_[0, ends]))
    wanted = np.arange(len(text)) + SPAN <= ends[piece]
    keys = eight_bytes(text, SPAN)
    entries = suffix_order(text, wanted, SPAN, keys)
    group = np.cumsum(common_prefixes(entries, keys, SPAN) < SPAN)
    met = np.bincount(group, weight[piece[entries]]) > 1 if len(entries) else np.zeros(0, bool)
    found = entries[met[group]] if len(entries) else entries
    begin = np.r_[0, ends[:-1]]
    return _runs(piece[found], found - begin[piece[found]], h1[kept], h2[kept])


def _counted_windows(pieces: DataFrame) -> DataFrame:
    """The same runs for pieces of crowded anchors: their windows are counted by hash."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, piece in enumerate(batch["bytes"]):
                data = np.frombuffer(piece.as_buffer(), np.uint8)
                at = np.arange(len(data) - SPAN + 1)
                one, two = (_range_hashes(codes[data], at, at + SPAN, mult) for codes, mult in zip(_BYTE_CODES, _BYTE_MULTS))
                same = pa.array(np.full(len(at), i))
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c].take(same) for c in ("h1", "h2", "weight")), pa.array(at), pa.array(signed(one)), pa.array(signed(two))],
                    names=["h1", "h2", "weight", "place", "w1", "w2"],
                )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch["places"]
            piece = np.repeat(np.arange(batch.num_rows), places.value_lengths().to_numpy())
            yield from _runs(piece, places.flatten().to_numpy(), batch["h1"].to_numpy(), batch["h2"].to_numpy()).to_batches()

    distinct = pieces.groupBy("h1", "h2").agg(F.count("*").alias("weight"), F.max("bytes").alias("bytes"))
    each = shared_table(distinct.mapInArrow(windows, "h1 long, h2 long, weight long, place long, w1 long, w2 long"))
    many = each.groupBy("w1", "w2").agg(F.sum("weight").alias("n")).filter("n > 1").select("w1", "w2")
    found = each.join(many, ["w1", "w2"]).select("h1", "h2", "place")
    return found.groupBy("h1", "h2").agg(F.collect_list("place").alias("places")).mapInArrow(joined, "h1 long, h2 long, lo long, hi long")


def repeated_runs(pieces: DataFrame) -> DataFrame:
    """(h1, h2, lo, hi): runs of window starts, inside each distinct piece, that repeat somewhere."""
    sent = pieces.filter("bytes is not null or again").select("h1", "h2", "a", "n", "bytes")
    crowded = shared_table(sent.filter("bytes is not null").groupBy("a").agg(F.sum("n").alias("size")).filter(F.col("size") > CROWDED).select("a"))
    number = crowded.count()
    calm = sent
    if number:
        side = F.broadcast(crowded) if number <= BROADCAST_ROWS else crowded
        calm = sent.join(side, "a", "left_anti")
    buckets = 1 + (sent.filter("bytes is not null").agg(F.sum("n")).first()[0] or 0) // BUCKET_BYTES
    dealt = calm.select("h1", "h2", "bytes", F.pmod(F.xxhash64("a"), F.lit(buckets)).alias("bucket"))
    runs = dealt.groupBy("bucket").applyInArrow(_sorted_bucket, "h1 long, h2 long, lo long, hi long")
    if number:
        runs = runs.unionByName(_counted_windows(sent.join(side, "a", "left_semi")))
    return runs


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary: the bytes that stay), one row per row of ``docs``."""
    settle(docs.sparkSession)
    anchors = bitmap(shared_table(repeated_anchors(docs)), F.col("a"))
    pieces = shared_table(suspect_pieces(docs, anchors))
    runs = shared_table(repeated_runs(pieces))
    met = pieces.select("doc_id", "k", "start", "h1", "h2").join(runs, ["h1", "h2"])
    spans = met.groupBy("doc_id", "k").agg(F.collect_list(F.struct((F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))).alias("spans"))
    touched = shared_table(spans)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(touched, F.col("k"), 16))
    keyed = keyed_texts(docs)
    schema = f"doc_id {id_type(docs)}, n_bytes long, n_removed long, n_spans long, kept binary"

    def passing(batches: Iterator[pa.RecordBatch], whether: bool = True) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bits(sent.value, batch.column(1).to_numpy().view(U)) == whether))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passing(batches, False):
            content = batch["text"].cast(pa.binary()).fill_null(b"")
            size, none = pc.binary_length(content).cast(pa.int64()), pa.array(np.zeros(batch.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], size, none, none, content], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch["text"], batch["spans"]):
                data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
                edge = np.zeros(len(data) + 1, np.int64)
                if spans.is_valid:
                    np.add.at(edge, spans.values.field("lo").to_numpy(), 1)
                    np.add.at(edge, spans.values.field("hi").to_numpy() + SPAN, -1)
                gone = np.cumsum(edge)[:-1] > 0
                starts = gone & ~np.r_[False, gone[:-1]] if len(gone) else gone
                rows.append((len(data), int(gone.sum()), int(starts.sum()), data[~gone].tobytes()))
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), [pa.int64()] * 3 + [pa.binary()])] if rows else [pa.array([], k) for k in [pa.int64()] * 3 + [pa.binary()]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    meeting = same_row(keyed.mapInArrow(passing, keyed.schema), touched).select("doc_id", "text", "spans")
    return meeting.mapInArrow(cut, schema).union(keyed.mapInArrow(whole, schema))
