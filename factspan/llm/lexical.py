"""Ranked lexical search by pipelined term partitioning.

Terms are dealt to owners by the class of their weight, rarest first. Documents lie in blocks, and a block's postings of an owner's
terms lie together. Items travel in bundles: for every block a bundle carries, for each of its items, a sparse accumulator of
documents and scores, and it passes one owner after the other. At each owner it meets the owner's postings of its block in a
cogroup, which adds their integer contributions. After the last owner the best documents of each block are kept and ranked.

Pruning is exact: an item's rest at an owner is the most that all later owners can add, a term's weight times 10^6 each. A document
that cannot reach the score that the item's 50th document of the block already has goes, and where the owner and its successors
together cannot reach it, no new document enters. Equal scores stay.

A term in most documents is spread over as many rows as there are blocks, dealt by term and block; a block holds at most
``BLOCK_DOCS`` documents and some ``BLOCK_POSTINGS`` postings (or one longer text), a bundle some ``BUNDLE_ITEMS`` items, so no group
grows with the data. Terms are told apart by 128 bits of hash. Postings of terms that no item has are not written, by a bitmap of at
most 16 MB.

Null texts and texts without a term hold nothing and are never found. Repeated rows are documents of their own. Among equal scores a
null id comes last. Rows of one ``item_id`` are one item with the terms of all; items without a term in any document give no rows,
and so do empty tables. Other columns are not read. A very long text is cut into words in one task, at some 60 bytes a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.core import top_per_group
from .common import id_type, settle, shared_table
from .sketch import bitmap
from .words import LETTERS_DIGITS, U, Words, in_bits, signed, text_groups, words_of

BLOCK_DOCS = 4096
BLOCK_POSTINGS = 1_000_000
BUNDLE_ITEMS = 256
#: Least weight of the terms of each owner; the last takes the rest.
OWNERS = (4600, 3000, 1400, 1)
#: No occurrence count makes (1000000000 tf) div (1000 tf + 20 m) larger.
MOST_PER_WEIGHT = 1_000_000


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, h1, h2): the terms of each item."""
    kind = items.schema["item_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _hi, buf, offsets in text_groups(batch.column(1)):
                words = words_of(buf, offsets, LETTERS_DIGITS, lower=True)
                owner = pa.array(words.text_of_word() + lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), pa.array(signed(words.hash)), pa.array(signed(words.second_hash))], names=["item_id", "h1", "h2"])

    return items.select("item_id", "text").mapInArrow(cut, f"item_id {kind}, h1 long, h2 long").distinct()


def _counted(words: Words, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, hashes and number of occurrences of every wanted term of each text."""
    one, two, text = words.hash[wanted], words.second_hash[wanted], words.text_of_word()[wanted]
    order = np.lexsort((two, one, text))
    one, two, text = one[order], two[order], text[order]
    new = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (text[1:] != text[:-1])]) if len(one) else np.zeros(0, np.int64)
    return text[new], one[new], two[new], np.diff(np.r_[new, len(one)])


def block_rows(block: int, ids: list, sizes: list, found: list) -> pa.RecordBatch:
    """The rows of one block (see :func:`blocks_of`); ``found`` holds (document, h1, h2, count) arrays and is emptied.

    Arrays are let go as soon as they are put in order: a worker holds some 60 bytes a posting at most.
    """
    ids, sizes = pa.concat_arrays(ids), np.concatenate(sizes)
    order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    columns = [list(x) for x in zip(*found)]
    found.clear()
    doc, one, two, count = (_joined(x) for x in columns)
    doc = place[doc]
    by = np.lexsort((doc, two, one))
    doc, count = doc[by], count[by]
    one, two = one[by], two[by]
    del by
    first = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(one) else np.zeros(0, np.int64)
    ends, n = np.r_[first, len(one)].astype(np.int32), len(first)
    one, two = one[first], two[first]
    whole = np.array([0, len(order)], np.int32)
    # The first row is the block's own; it is missing in the columns of postings and the others in its columns.
    lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets), values)
    after = lambda array: pa.concat_arrays([pa.nulls(1, array.type), array])
    before = lambda array: pa.concat_arrays([array, pa.nulls(n, array.type)])
    columns = [
        pa.array(np.full(n + 1, block)), before(lists(whole, ids.take(pa.array(order)))), before(lists(whole, pa.array(sizes[order]))),
        after(pa.array(signed(one))), after(pa.array(signed(two))),
        after(lists(ends, pa.array(doc))), after(lists(ends, pa.array(count.astype(np.int64)))),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "sizes", "h1", "h2", "docs", "counts"])


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    whole = np.concatenate(parts)
    parts.clear()
    return whole


def blocks_of(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """Per block one row with its documents' ids and numbers of terms, in order of id (h1 null), and one row per term with the
    places and occurrence counts of its documents."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, sizes, found, docs_in, postings = TaskContext.get().partitionId() << 32, [], [], [], 0, 0
        for batch in batches:
            for lo, hi, buf, offsets in text_groups(batch.column(1)):
                words = words_of(buf, offsets, LETTERS_DIGITS, lower=True)
                text, one, two, count = _counted(words, np.flatnonzero(in_bits(sent.value, words.hash)))
                ids.append(batch.column(0).slice(lo, hi - lo))
                sizes.append(words.counts.astype(np.int64))
                found.append(((text + docs_in).astype(np.int32), one, two, count.astype(np.int32)))
                docs_in, postings = docs_in + hi - lo, postings + len(text)
                if docs_in >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                    yield block_rows(block, ids, sizes, found)
                    block, ids, sizes, found, docs_in, postings = block + 1, [], [], [], 0, 0
        if docs_in:
            yield block_rows(block, ids, sizes, found)

    schema = f"block long, ids array<{id_type(docs)}>, sizes array<long>, h1 long, h2 long, docs array<int>, counts array<long>"
    return docs.select("doc_id", "text").mapInArrow(gather, schema)


def _bundles(terms: DataFrame, items: int) -> DataFrame:
    """(bundle, item_id, place of the item in its bundle, h1, h2); bundles are dealt by a hash, some ``BUNDLE_ITEMS`` items each."""
    number = -(-items // BUNDLE_ITEMS)
    dealt = terms.select("item_id").distinct().withColumn("bundle", F.pmod(F.xxhash64("item_id"), F.lit(number)).cast("int"))
    dealt = dealt.withColumn("item", F.row_number().over(Window.partitionBy("bundle").orderBy("item_id")) - 1)
    return terms.join(dealt.withColumnRenamed("item_id", "__item"), F.col("item_id").eqNullSafe(F.col("__item"))).drop("__item")


def _plan(terms: DataFrame, blocks: DataFrame, documents: int) -> tuple[DataFrame, DataFrame]:
    """Weighted terms (h1, h2, bundle, owner, weight, items), and bundles with item ids and each item's rest after each owner."""
    spread = blocks.filter("h1 is not null").groupBy("h1", "h2").agg(F.sum(F.size("docs")).alias("df"))
    ratio = F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1).cast("double")
    weighted = terms.join(spread, ["h1", "h2"]).withColumn("weight", F.floor(F.lit(1000) * F.log(ratio)).cast("long")).filter("weight > 0")
    owner = F.lit(len(OWNERS) - 1)
    for number, least in reversed(list(enumerate(OWNERS[:-1]))):
        owner = F.when(F.col("weight") >= least, number).otherwise(owner)
    weighted = shared_table(weighted.withColumn("owner", owner))
    later = [F.coalesce(F.sum(F.when(F.col("owner") > n, F.col("weight") * MOST_PER_WEIGHT)), F.lit(0)).alias(f"r{n}") for n in range(len(OWNERS))]
    items = weighted.groupBy("bundle", "item", "item_id").agg(*later)
    row = F.struct("item", "item_id", F.array(*[f"r{n}" for n in range(len(OWNERS))]).alias("rest"))
    bundles = items.groupBy("bundle").agg(F.array_sort(F.collect_list(row)).alias("items"))
    plan = weighted.groupBy("h1", "h2", "bundle", "owner", "weight").agg(F.collect_list("item").alias("items"))
    return plan, bundles


def _nullable(kind: pa.DataType) -> pa.DataType:
    """The type as Spark declares it from a schema string: every element may be null."""
    if pa.types.is_list(kind):
        return pa.list_(pa.field("element", _nullable(kind.value_type)))
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _nullable(f.type)) for f in kind])
    return kind


def _owner_stage(number: int, documents: int, total: int, best: int):
    """What one owner does with a bundle at one block: add its postings, then drop what cannot be among the best."""

    def reached(scores: np.ndarray) -> int:
        return int(np.partition(scores, len(scores) - best)[len(scores) - best]) if len(scores) >= best else 0

    def visit(bundle: pa.Table, postings: pa.Table) -> pa.Table:
        if not bundle.num_rows:
            return bundle.cast(pa.schema([(f.name, _nullable(f.type)) for f in bundle.schema]))
        head = bundle.slice(0, 1)
        sizes = head["sizes"].combine_chunks().flatten().to_numpy()
        m = 50 + (50 * sizes * documents) // total
        items = head["items"].combine_chunks().flatten()
        rest, here = items.field("rest").flatten().to_numpy().reshape(len(items), len(OWNERS))[:, number], items.field("item").to_numpy()
        slot = np.zeros(int(here.max()) + 1, np.int64)
        slot[here] = np.arange(len(here))
        added: list[list] = [[] for _ in range(len(items))]
        for weight, of, docs, counts in zip(*(postings[c].combine_chunks() for c in ("weight", "of", "docs", "counts"))):
            docs, counts = docs.values.to_numpy(), counts.values.to_numpy()
            gain = weight.as_py() * ((1_000_000_000 * counts) // (1000 * counts + 20 * m[docs]))
            for item in slot[of.values.to_numpy()]:
                added[item].append((docs, gain))
        places, scores = head["places"].combine_chunks(), head["scores"].combine_chunks()
        edge = np.r_[0, np.cumsum(places.flatten().value_lengths().to_numpy())]
        old_places, old_scores = places.flatten().flatten().to_numpy(), scores.flatten().flatten().to_numpy()
        all_places, all_scores = [], []
        for item in range(len(items)):
            total_of = np.zeros(len(sizes), np.int64)
            known = old_places[edge[item] : edge[item + 1]]
            total_of[known] = old_scores[edge[item] : edge[item + 1]]
            closed = sum(int(gain.max()) for _docs, gain in added[item]) + rest[item] < reached(total_of[known])
            for docs, gain in added[item]:
                total_of[docs] += np.where(total_of[docs] > 0, gain, 0) if closed else gain
            met = np.flatnonzero(total_of)
            met = met[total_of[met] + rest[item] >= reached(total_of[met])]
            if number == len(OWNERS) - 1:
                met = np.sort(met[np.lexsort((met, -total_of[met]))][:best])
            all_places.append(met.astype(np.int32))
            all_scores.append(total_of[met])
        ends = np.r_[0, np.cumsum([len(x) for x in all_places])].astype(np.int32)
        one = pa.array(np.array([0, len(items)], np.int32))
        nested = lambda parts, kind: pa.ListArray.from_arrays(one, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts), kind)))
        at = {"places": nested(all_places, pa.int32()), "scores": nested(all_scores, pa.int64())}
        columns = [at.get(name, head[name]) for name in bundle.column_names]
        return pa.table([c.cast(_nullable(c.type)) for c in columns], names=bundle.column_names)

    return visit


def search(items: DataFrame, docs: DataFrame, best: int = 50) -> DataFrame:
    """item_id, rank (from 1), doc_id and score: each item's ``best`` documents by score, equal scores by id.

    A term's weight is floor(1000 ln((2N+2)/(2df+1))), a document's length norm m is 50 + (50 n N) div L; a term adds its weight times
    (10^9 tf) div (1000 tf + 20 m), in 64-bit integers.
    """
    spark = settle(docs.sparkSession)
    terms = shared_table(item_terms(items))
    blocks = shared_table(blocks_of(docs, bitmap(terms, F.col("h1"))))
    heads = blocks.filter("h1 is null").select("block", "ids", "sizes")
    holding = F.expr("aggregate(sizes, 0L, (a, n) -> a + if(n > 0, 1L, 0L))")
    documents, total = heads.agg(F.coalesce(F.sum(holding), F.lit(0)), F.coalesce(F.sum(F.expr("aggregate(sizes, 0L, (a, n) -> a + n)")), F.lit(0))).first()
    count = terms.select("item_id").distinct().count()
    id_kind, item_kind = id_type(docs), items.schema["item_id"].dataType.simpleString()
    if not count or not documents:
        return spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {id_kind}, score long")
    plan, bundles = _plan(_bundles(terms, count), blocks, documents)
    number, salts = -(-count // BUNDLE_ITEMS), 16
    salted = plan.withColumnRenamed("items", "of").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    lists = blocks.filter("h1 is not null").select("h1", "h2", "block", "docs", "counts", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"))
    postings = shared_table(lists.join(salted, ["h1", "h2", "salt"]).select("bundle", "block", "owner", "weight", "of", "docs", "counts"))
    state = heads.withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(number - 1)))).join(bundles, "bundle")
    none = lambda kind: F.transform("items", lambda _: F.array().cast(f"array<{kind}>"))
    state = state.select("bundle", "block", "ids", "sizes", "items", none("int").alias("places"), none("long").alias("scores"))
    for owner in range(len(OWNERS)):
        met = postings.filter(F.col("owner") == owner).groupBy("bundle", "block")
        state = state.groupBy("bundle", "block").cogroup(met).applyInArrow(_owner_stage(owner, documents, total, best), state.schema.simpleString())
    by_item = state.select("ids", F.explode(F.arrays_zip(F.col("items.item_id").alias("item_id"), "places", "scores")).alias("x"))
    found = by_item.select("ids", "x.item_id", F.explode(F.arrays_zip("x.places", "x.scores")).alias("y"))
    found = found.select("item_id", F.expr("ids[y.places]").alias("doc_id"), F.col("y.scores").alias("score"))
    ranked = top_per_group(found, ["item_id"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], best, "rank")
    return ranked.select("item_id", "rank", "doc_id", "score")
