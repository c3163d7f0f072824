"""Importance resampling of documents towards a target distribution of hashed n-grams.

Every document is normalised once (words of letters and digits, A-Z lower-cased, one space after each) and scanned once for the
running CRC-32 of its bytes. CRC-32 is linear over GF(2), so the CRC of any run of words follows from two of these prefixes: the
earlier one is shifted by the run's length, by tables of the shift by 1, 2, 4, ... zero bytes, and cancelled. An n-gram's bucket is
that CRC modulo ``buckets``.

A bucket's gain is the smoothed log-ratio of its shares in the target and in the documents, in thousandths. A document's weight is
the floored mean of the gains of its features; Gumbel noise from a seeded hash of its id is added, and the highest scores are
drawn. Counts cover all documents. Tasks keep one array of ``buckets`` counts; only these are shuffled and only the gains are broadcast.

Null and empty texts have no features, weight 0 and are not eligible unless ``least_words`` is 0. A null id draws its noise as the
empty string and comes last among equal scores. Repeated rows are rows of their own, with equal scores. No documents give no rows;
a target without features counts as one that is even over all buckets. Other columns of the inputs are not read. A text costs its
task some 40 bytes a byte while it is hashed, in groups of texts of 1 MB or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.core import number_rows, running_total
from .common import id_type, settle, shared_table
from .words import LETTERS_DIGITS, Words, text_groups, words_of

POLYNOMIAL = 0xEDB88320
#: Bytes of one lane of the scan; all lanes of a buffer are scanned side by side.
LANE = 256
ONES = np.uint32(0xFFFFFFFF)


@lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    """CRC register after one byte, from a zero register."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> 1) ^ np.where(table & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    return table


def _apply(shift: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A GF(2) matrix, held as four tables of 256 sums of its columns, times registers."""
    return shift[0][x & 255] ^ shift[1][(x >> 8) & 255] ^ shift[2][(x >> 16) & 255] ^ shift[3][x >> 24]


@lru_cache(maxsize=64)
def _shift(power: int) -> np.ndarray:
    """Tables that shift a register by 2^power zero bytes: the shift by half as many, applied to itself."""
    columns = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    if power == 0:
        return (columns >> 8) ^ _byte_table()[columns & 255]
    return _apply(_shift(power - 1), _apply(_shift(power - 1), columns))


def shifted(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Each register shifted by its own number of zero bytes."""
    x, by, power = x.copy(), np.asarray(by), 0
    while len(by) and int(by.max()) >> power:
        some = np.flatnonzero((by >> power) & 1)
        x[some] = _apply(_shift(power), x[some])
        power += 1
    return x


def prefix_registers(data: np.ndarray) -> np.ndarray:
    """CRC register, from zero, of data[:i] for every i. Lanes are scanned side by side, then shifted onto what is before them."""
    lanes = -(-len(data) // LANE) if len(data) else 0
    padded = np.zeros(lanes * LANE, np.uint8)
    padded[: len(data)] = data
    by_step, table = np.ascontiguousarray(padded.reshape(lanes, LANE).T), _byte_table()
    inside = np.zeros((LANE + 1, lanes), np.uint32)
    for step in range(LANE):
        before = inside[step]
        inside[step + 1] = (before >> 8) ^ table[(before & 255).astype(np.uint8) ^ by_step[step]]
    # Lane starts by doubling: what lies 1, 2, 4, ... lanes before, shifted by as many lanes.
    starts, power = inside[LANE].copy(), LANE.bit_length() - 1
    reach = 1
    while reach < lanes:
        starts[reach:] ^= _apply(_shift(power), starts[:-reach].copy())
        reach, power = reach * 2, power + 1
    starts = np.concatenate([np.zeros(1, np.uint32), starts[:-1]]) if lanes else starts
    out = np.zeros(len(data) + 1, np.uint32)
    moved = starts
    for step in range(LANE):
        moved = (moved >> 8) ^ table[moved & 255]
        row = inside[step + 1] ^ moved
        target = out[step + 1 :: LANE]
        target[:] = row[: len(target)]
    return out


def substring_crc(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end] from two prefixes each, start not beyond end."""
    length = end - start
    return prefix[end] ^ shifted(prefix[start] ^ ONES, length) ^ ONES


def features(words: Words, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of all runs of 1 to ``most`` words."""
    length = words.end - words.start
    start = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length + 1, out=start[1:])
    normal = np.full(int(start[-1]), 32, np.uint8)
    inside = np.repeat(words.start - start[:-1], length + 1) + np.arange(len(normal))
    letters = np.ones(len(normal), bool)
    letters[start[1:] - 1] = False
    normal[letters] = words.buf[inside[letters]]
    prefix, owner = prefix_registers(normal), words.text_of_word()
    texts, hashes = [], []
    for n in range(1, most + 1):
        first = np.arange(max(0, len(length) - n + 1))
        first = first[owner[first] == owner[first + n - 1]]
        texts.append(owner[first])
        hashes.append(substring_crc(prefix, start[first], start[first + n] - 1).astype(np.int64) % buckets)
    return np.concatenate(texts), np.concatenate(hashes)


def bucket_counts(texts: DataFrame, most: int, buckets: int) -> DataFrame:
    """(bucket, n): occurrences of the features of all texts; a task sends at most one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _lo, _hi, buf, offsets in text_groups(batch.column(0)):
                total += np.bincount(features(words_of(buf, offsets, LETTERS_DIGITS, lower=True), most, buckets)[1], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, most: int, buckets: int) -> np.ndarray:
    """floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) of every bucket."""
    wanted, given = bucket_counts(target, most, buckets), bucket_counts(docs, most, buckets)
    both = shared_table(wanted.select("bucket", F.col("n").alias("t"), F.lit(0).cast("long").alias("s")).unionByName(given.select("bucket", F.lit(0).cast("long").alias("t"), F.col("n").alias("s"))))
    counts = both.groupBy("bucket").agg(F.sum("t").alias("t"), F.sum("s").alias("s"))
    all_t, all_s = both.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("s"), F.lit(0))).first()
    spark, d = docs.sparkSession, lambda c: F.col(c).cast("double")
    filled = spark.range(buckets).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").fillna(0, ["t", "s"])
    ratio = (d("t") + 1) * F.lit(float(all_s + buckets)) / ((d("s") + 1) * F.lit(float(all_t + buckets)))
    out = np.zeros(buckets, np.int64)
    for row in filled.select("bucket", F.floor(F.lit(1000) * F.log(ratio)).alias("gain")).collect():
        out[row["bucket"]] = row["gain"]
    return out


def weigh(docs: DataFrame, gain: np.ndarray, most: int) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            for lo, hi, buf, offsets in text_groups(batch.column(1)):
                words = words_of(buf, offsets, LETTERS_DIGITS, lower=True)
                owner, bucket = features(words, most, len(gain))
                n, total = np.bincount(owner, minlength=hi - lo), np.zeros(hi - lo, np.int64)
                np.add.at(total, owner, gain[bucket])
                columns = [words.counts.astype(np.int64), n.astype(np.int64), total // np.maximum(n, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, columns)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(weights, f"doc_id {id_type(docs)}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, most: int = 2, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024") -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null where not drawn), one row per row of ``docs``.

    Of the N rows with ``least_words`` words or more, floor(percent N / 100) with the highest scores are drawn, ties to smaller ids.
    Ranks are places in range partitions plus the partitions' offsets.
    """
    settle(docs.sparkSession)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000) * F.log(-F.log((noise + 0.5) / F.lit(4294967296.0))))
    scored = shared_table(weigh(docs, gains(docs, target, most, buckets), most).withColumn("score", F.col("weight") + gumbel))
    eligible = scored.filter(F.col("n_words") >= least_words)
    drawn = eligible.count() * percent // 100
    # Only rows from the score on at which enough are counted are put in order.
    counts = eligible.groupBy((-F.col("score")).alias("down")).agg(F.count("*").alias("n"))
    edge = running_total(counts, [], "down", F.col("n"), "upto").filter(F.col("upto") >= drawn).agg(F.min("down")).first()[0] if drawn else None
    above = F.lit(False) if edge is None else F.coalesce((F.col("n_words") >= least_words) & (-F.col("score") <= edge), F.lit(False))
    order = F.struct((-F.col("score")).alias("down"), F.col("doc_id").isNull().alias("none"), "doc_id", F.monotonically_increasing_id().alias("row"))
    ranked = number_rows(shared_table(scored.filter(above).withColumn("__order", order)), [], "__order", "rank")
    ranked = ranked.drop("__order").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return scored.filter(~above).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked)
