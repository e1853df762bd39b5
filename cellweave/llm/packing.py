"""Packing documents into training sequences: first-fit decreasing over a tournament tree, in randomised groups."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, prepare
from .tokens import encoder

TOKENISED = "doc_id bigint, grp bigint, doc_tokens bigint, crcs array<bigint>, tail binary"
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint"

#: A gap below this many ids is left rather than filled with a cut piece.
LEAST_CUT = 16


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size, for sizes in falling order: the first bin that has room for it.

    A tournament tree holds the room of each bin in its leaves and the larger of
    two in each node above, so the first bin with enough room is found by one
    way down from the root.
    """
    width = 1
    while width < len(sizes):
        width *= 2
    room = [capacity] * (2 * width)
    bins = []
    for size in sizes:
        at = 1
        while at < width:
            at *= 2
            if room[at] < size:
                at += 1
        bins.append(at - width)
        room[at] -= size
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return bins


def fill_gaps(bins: list[list[list[int]]], capacity: int) -> list[list[list[int]]]:
    """Cut the contents of the emptiest bins into the gaps of the others while that saves a bin.

    A bin is a list of [item, start, length]. A saved bin costs some cuts; gaps
    under LEAST_CUT stay.
    """
    fill = [sum(p[2] for p in b) for b in bins]
    spare = sum(capacity - f for f in fill)
    order = sorted(range(len(bins)), key=lambda i: (fill[i], i))
    gaps = [(-(capacity - f), i) for i, f in enumerate(fill) if capacity - f >= LEAST_CUT]
    heapq.heapify(gaps)
    gone: set[int] = set()
    for i in order:
        usable = sum(-g for g, j in gaps if j != i and j not in gone)
        # it may have got pieces meanwhile; the end of each piece can leave a gap under LEAST_CUT unused
        if spare < capacity or usable < sum(p[2] + LEAST_CUT for p in bins[i]):
            break
        gone.add(i)
        spare -= capacity
        for item, start, length in bins[i]:
            while length:
                gap, j = heapq.heappop(gaps)
                if j in gone:
                    continue
                take = min(length, -gap)
                bins[j].append([item, start, take])
                start, length = start + take, length - take
                if -gap - take >= LEAST_CUT:
                    heapq.heappush(gaps, (gap + take, j))
        bins[i] = []
    return [b for b in bins if b]


def _tokenise(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path, True)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            totals, crcs, tails = [], [], []
            for ids in ids_of.raw(texts, end_id):
                n = len(ids) // 4
                whole = n // capacity * capacity
                totals.append(n)
                crcs.append([crc32(ids[4 * k : 4 * (k + capacity)]) for k in range(0, whole, capacity)])
                tails.append(ids[4 * whole :])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("grp"), pa.array(totals, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary())],
                names=["doc_id", "grp", "doc_tokens", "crcs", "tail"],
            )

    return run


def _pack_group(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        ids, totals, crcs, tails = (table.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "crcs", "tail"))
        first = table.column("grp")[0].as_py() << 32
        rows: list[tuple] = []
        sequence = first
        for k, found in enumerate(crcs):
            for j, crc in enumerate(found):
                rows.append((ids[k], j * capacity, capacity, crc, totals[k], sequence, 0))
                sequence += 1
        items = [k for k in range(len(ids)) if tails[k]]
        items.sort(key=lambda k: (-len(tails[k]), ids[k] is None, ids[k] or 0, tails[k]))
        bins: list[list[list[int]]] = []
        for k, b in zip(items, first_fit_decreasing([len(tails[k]) // 4 for k in items], capacity)):
            if b == len(bins):
                bins.append([])
            bins[b].append([k, 0, len(tails[k]) // 4])
        for content in fill_gaps(bins, capacity):
            offset = 0
            for k, start, length in content:
                before = len(crcs[k]) * capacity
                rows.append((ids[k], before + start, length, crc32(tails[k][4 * start : 4 * (start + length)]), totals[k], sequence, offset))
                offset += length
            sequence += 1
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*rows))})

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, group_docs: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document into sequences of at most `capacity` ids; a row for each piece (PIECES).

    A document's ids are those of the tokenizers file (a byte-level vocabulary)
    and `end_id`. Each full run of `capacity` ids becomes a sequence of its own
    where the text is tokenised; only the rest, under `capacity` ids, is
    shuffled. Rests go to random groups of about `group_docs` documents, by a hash
    of the row and the input partition it stands in; each group is packed by itself
    with first-fit decreasing, and the emptiest bins are then cut into the gaps of
    the others. So a task holds about `group_docs` rests of under 4 * `capacity`
    bytes, or those of the rows that are alike within one partition.

    Null and empty texts have one id, the end id. Null ids are kept as null.
    Repeated rows are documents of their own. No documents, no rows. Other
    columns are ignored, whatever their names.
    """
    prepare(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    groups = max(1, -(-rows.count() // group_docs))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64(F.lit("pack"), "doc_id", F.crc32("text"), F.spark_partition_id()), F.lit(groups)))
    return rows.mapInArrow(_tokenise(tokenizer_path, capacity, end_id), TOKENISED).groupBy("grp").applyInArrow(_pack_group(capacity), PIECES)
