"""Exact removal of repeated 50-word windows behind a count-min prefilter.

In each window the 25-word gram with the least hash is its anchor; equal windows have equal anchors at equal places, so the
number of documents with an anchor is never below that of any of its windows. Every partition counts its documents' anchors in a
count-min sketch, held at 2; Spark merges the sketches, which overestimate. A second pass takes only windows whose anchor is
estimated in two documents or more, as runs of windows around one anchor, and groups these exactly by 128 bits of hash: equal runs first,
and where an anchor has several unlike runs, their windows. A window counts as repeated in a document if it also starts in one with a
smaller id, and its words go.

Null texts have no words; rows with a null id neither lose words nor make others lose them; rows of equal id do not repeat
each other; repeated rows each get their row. An empty table gives no rows; other columns are not read. A very long text is one
task's, at some 100 bytes a byte. The sketch has a fixed size: on very large inputs it lets more runs pass and still loses none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import id_type, keyed_texts, same_row, settle, shared_table
from .sketch import bitmap, cell_rows, merged_cells
from .words import NON_BLANK, U, Words, in_bits, mix, signed, text_groups, winnow, words_of

WINDOW = 50
GRAM = 25
WIDTH = WINDOW - GRAM + 1
#: Cells of each of the sketch's two rows, and of a block that is merged at once.
CELLS = 1 << 25
BLOCK = 1 << 18


def _anchored(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of every window, hash of its anchor, and the anchor's number among the grams."""
    at, grams = words.grams(GRAM)
    first, chosen = winnow(at, grams, words.text_of_word()[at], WIDTH)
    return at[first], grams[chosen], chosen


def _cells(anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each anchor in either row of the sketch, which lie one after the other."""
    one = (anchors & U(CELLS - 1)).astype(np.int64)
    two = ((anchors >> U(32)) & U(CELLS - 1)).astype(np.int64) + CELLS
    return one, two


def anchor_sketch(docs: DataFrame) -> np.ndarray:
    """Packed bits: whether a cell was met by two documents or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(2 * CELLS, np.uint8)
        for batch in batches:
            for _lo, _hi, buf, offsets in text_groups(batch.column(0)):
                words = words_of(buf, offsets, NON_BLANK, lower=False)
                starts, anchors, _ = _anchored(words)
                if not len(starts):
                    continue
                owner = words.text_of_word()[starts]
                fresh = np.r_[True, (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])]
                anchors, owner = anchors[fresh], owner[fresh]
                order = np.lexsort((anchors, owner))
                anchors, owner = anchors[order], owner[order]
                # Once for each document.
                for at in _cells(anchors[np.r_[True, (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])]]):
                    at, n = np.unique(at, return_counts=True)
                    cells[at] = np.minimum(cells[at] + n, 2)
        rows = list(cell_rows(cells, TaskContext.get().partitionId(), BLOCK))
        for row in rows:
            yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), pa.array([row[1]], pa.int64()), pa.array([row[2]], pa.binary())], names=["part", "block", "cells"])

    rows = docs.select("text").mapInArrow(count, "part long, block long, cells binary")
    return np.packbits(merged_cells(rows, 2 * CELLS, BLOCK, "uint8", 2) >= 2)


#: Runs that a task remembers, to send their windows once.
REMEMBERED = 500_000


def _suspect_runs(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """Runs of windows around one anchor (a) that is estimated in two documents or more: place, number of windows, hash of the run
    (r1, r2); where the task meets the run first also its windows' hashes."""
    sent = docs.sparkSession.sparkContext.broadcast(sketch)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, seen = sent.value, set()
        met = lambda at: (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        for batch in batches:
            for lo, _hi, buf, offsets in text_groups(batch.column(2)):
                words = words_of(buf, offsets, NON_BLANK, lower=False)
                starts, anchors, chosen = _anchored(words)
                one, two = _cells(anchors)
                some = met(one) & met(two)
                starts, anchors, chosen = starts[some], anchors[some], chosen[some]
                if not len(starts):
                    continue
                if len(seen) > REMEMBERED:
                    seen.clear()
                at, h1 = words.grams(WINDOW)
                h2 = words.grams(WINDOW, second=True)[1]
                where = np.searchsorted(at, starts)
                h1, h2, owner = h1[where], h2[where], words.text_of_word()[starts]
                first = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)])
                n = np.diff(np.r_[first, len(starts)])
                # A run has fewer windows than a window has words: the first, the last and their number fix all its words.
                last = first + n - 1
                r1, r2 = mix(h1[first] ^ mix(h1[last] + n.astype(U))), mix(h2[first] ^ mix(h2[last] + n.astype(U)))
                fresh = np.zeros(len(first), bool)
                for i, pair in enumerate(zip(r1.tolist(), r2.tolist())):
                    fresh[i] = pair not in seen
                    seen.add(pair)
                sizes = np.where(fresh, n, 0)
                told, none = np.repeat(fresh, n), pa.array(~fresh)
                ends = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
                lists = lambda x: pa.ListArray.from_arrays(ends, pa.array(signed(x[told])), mask=none)
                rows = pa.array(owner[first] + lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows), batch.column(1).take(rows), pa.array((starts[first] - words.first[owner[first]]).astype(np.int32)), pa.array(n.astype(np.int32)),
                        pa.array(signed(anchors[first])), pa.array(signed(r1)), pa.array(signed(r2)), lists(h1), lists(h2),
                    ],
                    names=["doc_id", "k", "start", "n", "a", "r1", "r2", "h1", "h2"],
                )

    schema = f"doc_id {id_type(docs)}, k long, start int, n int, a long, r1 long, r2 long, h1 array<long>, h2 array<long>"
    return keyed_texts(docs).filter("doc_id is not null").mapInArrow(find, schema)


def _window_owners(runs: DataFrame, unlike: DataFrame) -> DataFrame:
    """(r1, r2, owners): for the runs of anchors with several unlike ones, the least id that has the window at each place."""
    sent = runs.sparkSession.sparkContext.broadcast(bitmap(unlike, F.col("a")))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bits(sent.value, batch.column(0).to_numpy().view(U))))

    told = runs.filter("h1 is not null").select("a", "r1", "r2", "h1", "h2")
    told = told.mapInArrow(passing, told.schema.simpleString()).join(unlike.drop("a"), ["r1", "r2"])
    pairs = F.posexplode(F.arrays_zip("h1", "h2")).alias("place", "w")
    windows = told.select("r1", "r2", "least", "most", pairs).select("r1", "r2", "least", "most", "place", "w.h1", "w.h2")
    least = windows.groupBy("h1", "h2").agg(F.min("least").alias("owner"))
    owned = windows.join(least, ["h1", "h2"]).filter("owner < most")
    # A run that several tasks told has equal entries.
    return owned.groupBy("r1", "r2").agg(F.collect_set(F.struct("place", "owner")).alias("owners"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, k and the starts of the row's windows that also start in a document with a smaller id."""
    runs = shared_table(_suspect_runs(docs, anchor_sketch(docs)))
    alike = runs.groupBy("a", "r1", "r2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    anchors = alike.groupBy("a").agg(F.count("*").alias("runs"), F.min("least").alias("first"), F.max("most").alias("last")).filter("first < last")
    kinds = shared_table(alike.join(anchors.select("a", "runs"), "a"))
    single = kinds.filter("runs = 1").select("r1", "r2", "least", F.lit(None).cast(f"array<struct<place:int,owner:{id_type(docs)}>>").alias("owners"))
    many = _window_owners(runs, kinds.filter("runs > 1").select("a", "r1", "r2", "least", "most"))
    judged = single.unionByName(many.select("r1", "r2", F.lit(None).cast(id_type(docs)).alias("least"), "owners"))
    places = runs.select("doc_id", "k", "start", "n", "r1", "r2").join(judged, ["r1", "r2"])
    own = F.transform(F.filter("owners", lambda x: x["owner"] < F.col("doc_id")), lambda x: x["place"] + F.col("start"))
    whole = F.when(F.col("least") < F.col("doc_id"), F.sequence(F.col("start"), F.col("start") + F.col("n") - 1))
    starts = F.when(F.col("owners").isNull(), whole).otherwise(own)
    later = places.select("doc_id", "k", starts.alias("starts")).filter("size(starts) > 0")
    return later.groupBy("doc_id", "k").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space), one row per row of ``docs``.

    Only texts whose key passes a bitmap of the rows that lose words are moved to meet their windows.
    """
    settle(docs.sparkSession)
    repeated = shared_table(repeated_windows(docs))
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(repeated, F.col("k"), 16))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bits(sent.value, batch.column(1).to_numpy().view(U))))

    keyed = keyed_texts(docs)
    met = same_row(keyed.mapInArrow(passing, keyed.schema), repeated).select("doc_id", "text", "starts")

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.filter(pa.array(~in_bits(sent.value, batch.column(1).to_numpy().view(U))))
            yield pa.RecordBatch.from_arrays([rest.column(0), rest.column(2), pa.nulls(rest.num_rows, pa.list_(pa.int32()))], names=["doc_id", "text", "starts"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts_of = batch.column(2)
            for lo, hi, buf, offsets in text_groups(batch.column(1)):
                words = words_of(buf, offsets, NON_BLANK, lower=False)
                n_words, n_removed, kept = words.counts, np.zeros(hi - lo, np.int64), []
                data = buf.tobytes()
                for i in range(hi - lo):
                    a, b = words.first[i], words.first[i + 1]
                    keep = np.ones(b - a, bool)
                    if starts_of[lo + i].is_valid:
                        edge = np.zeros(b - a + 1, np.int64)
                        starts = starts_of[lo + i].values.to_numpy()
                        np.add.at(edge, starts, 1)
                        np.add.at(edge, starts + WINDOW, -1)
                        keep = np.cumsum(edge[:-1]) == 0
                        n_removed[i] = (b - a) - keep.sum()
                    kept.append(b" ".join([data[s:e] for s, e in zip(words.start[a:b][keep].tolist(), words.end[a:b][keep].tolist())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n_words.astype(np.int64)), pa.array(n_removed), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    schema = f"doc_id {id_type(docs)}, n_words long, n_removed long, kept string"
    return met.mapInArrow(cut, schema).union(keyed.mapInArrow(lambda batches: cut(untouched(batches)), schema))
