"""Token ids in files: frequency ranks in byte-aligned variable-length coding, control bytes apart from data bytes."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Scratch, pick, prepare
from .tokens import encoder

#: Ids in a block of a file, about.
BLOCK_IDS = 1 << 17

TOKENS = "doc_id bigint, ids binary, counts binary"
BLOCKS = "shard int, block int, doc_ids array<bigint>, lengths array<bigint>, control binary, data binary"
SPANS = "shard int, block int, place int, doc_id bigint, start_in_block bigint, n_tokens bigint, ids_crc32 bigint"

#: For each control byte, the bytes of its four numbers: two bits each, lowest first, one byte less.
WIDTHS = ((np.arange(256, dtype=np.uint8)[:, None] >> np.array([0, 2, 4, 6], dtype=np.uint8)) & 3) + 1


def encode_numbers(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers: one to four data bytes each, two control bits each."""
    x = np.ascontiguousarray(numbers, dtype="<u4")
    width = 1 + (x > 0xFF).astype(np.uint8) + (x > 0xFFFF) + (x > 0xFFFFFF)
    two = np.zeros(-(-len(x) // 4) * 4, np.uint8)
    two[: len(x)] = width - 1
    two = two.reshape(-1, 4)
    control = two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6
    used = np.arange(4, dtype=np.uint8) < width[:, None]
    return control.tobytes(), x.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_numbers(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The numbers again: widths by table lookup, then one gather for each byte of a number."""
    width = WIDTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    end = np.cumsum(width, dtype=np.int64)
    raw, at = np.frombuffer(data, np.uint8), end - width
    out = raw[at].astype("<u4") if count else np.zeros(0, "<u4")
    for k in range(1, 4):
        wide = np.flatnonzero(width > k)
        if not len(wide):
            break
        out[wide] |= raw[at[wide] + k].astype("<u4") << np.uint32(8 * k)
    return out


def _tokenise(path: str, blank_kept: bool, end_id: int, width: int):
    """The ids of each text, `width` bytes wide; a task's last row has instead how often it met each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, total = encoder(path, blank_kept), np.zeros(0, np.int64)
        for batch in batches:
            found = ids_of.raw([x or "" for x in batch.column("text").to_pylist()], end_id)
            flat = np.frombuffer(b"".join(found), "<u4")
            n = np.bincount(flat, minlength=len(total))
            n[: len(total)] += total
            total = n
            end = np.cumsum([len(x) // 4 for x in found]) * width
            ids = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(np.append(0, end).astype("<i4")), pa.py_buffer(flat.astype(f"<u{width}"))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.nulls(len(found), pa.binary())], names=["doc_id", "ids", "counts"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["doc_id", "ids", "counts"])

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cell in batch.column("counts").to_pylist():
            total = np.frombuffer(cell, np.int64)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])


def _blocks(ids_by_rank: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.zeros(int(ids_by_rank.max(initial=0)) + 1, "<u4")
        rank[ids_by_rank] = np.arange(len(ids_by_rank))
        context = TaskContext.get()
        shard = context.partitionId() if context else 0
        block, held, docs, size = 0, [], [], 0

        def cut():
            control, data = encode_numbers(rank[np.concatenate(held)])
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([docs], pa.list_(pa.int64())), pa.array([[len(x) for x in held]], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                names=["shard", "block", "doc_ids", "lengths", "control", "data"],
            )

        for batch in batches:
            for doc, cell in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                held.append(np.frombuffer(cell, f"<u{width}"))
                docs.append(doc)
                size += len(held[-1])
                if size >= BLOCK_IDS:
                    yield cut()
                    block, held, docs, size = block + 1, [], [], 0
        if held:
            yield cut()

    return run


def _spans(ids_by_rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                ids = ids_by_rank[decode_numbers(row["control"], row["data"], int(lengths.sum()))].astype("<u4")
                end = np.cumsum(lengths)
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                        pa.array(end - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array([crc32(ids[e - k : e].tobytes()) for e, k in zip(end, lengths)], pa.int64()),
                    ],
                    names=["shard", "block", "place", "doc_id", "start_in_block", "n_tokens", "ids_crc32"],
                )

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, scratch: Scratch, end_id: int = 1, blank_kept: bool = False, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Write the ids of every document, and `end_id` after each, to the files `blocks` in ascending order of id_col.

    A first pass tokenises to a scratch table and counts each id as it goes; the count is
    added up on the executors, and only the vocabulary's counts reach the driver
    (at most one for each id of the vocabulary). Ids are then replaced by their
    rank in falling frequency, so most take one byte. Rows are dealt out by range
    of the id column and, for rows of one id, of a digest of their ids; a task writes its rows as blocks of BLOCK_IDS ids. Returns
    the id of each rank, which is also written, as `ranks`.

    Null and empty texts have the end id only; null ids come first; rows of one id
    stay, in the order of that digest and then of their ids. Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    width = 2 if max(end_id, Tokenizer.from_file(tokenizer_path).get_vocab_size() - 1) < 1 << 16 else 4
    tokens = scratch.store(rows.mapInArrow(_tokenise(tokenizer_path, blank_kept, end_id, width), TOKENS), "tokens")
    counts = tokens.where("counts is not null").select("counts").mapInArrow(_count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = sorted(counts.collect(), key=lambda r: (-r["n"], r["id"]))
    ids_by_rank = np.array([r["id"] for r in ranked], dtype="<u4")
    scratch.store(spark.createDataFrame([(k, r["id"], r["n"]) for k, r in enumerate(ranked)], "place int, id bigint, n bigint").coalesce(1), "ranks")
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tied = tokens.where("counts is null").select("doc_id", F.crc32("ids").alias("tie"), "ids")
    ordered = tied.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids").select("doc_id", "ids")
    scratch.store(ordered.mapInArrow(_blocks(ids_by_rank, width), BLOCKS), "blocks")
    scratch.drop("tokens")
    return ids_by_rank


def read_spans(blocks: DataFrame, ids_by_rank: np.ndarray) -> DataFrame:
    """Decode files of blocks: for each document in them its start among all ids, its number of ids and their crc32.

    The ids before a shard are summed on the driver from one number for each
    shard; those before a block within its shard by a window over the blocks'
    totals, without their data.
    """
    spark = blocks.sparkSession
    totals = blocks.select("shard", "block", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    before, so_far = [], 0
    for r in sorted(totals.groupBy("shard").agg(F.sum("n").alias("n")).collect()):
        before.append((r["shard"], so_far))
        so_far += r["n"]
    shards = spark.createDataFrame(before, "shard int, before_shard bigint")
    starts = totals.selectExpr("shard", "block", "sum(n) over (partition by shard order by block) - n as before_block").join(F.broadcast(shards), "shard")
    spans = blocks.mapInArrow(_spans(ids_by_rank), SPANS)
    return spans.join(starts, ["shard", "block"]).select("doc_id", (F.col("before_shard") + F.col("before_block") + F.col("start_in_block")).alias("start"), "n_tokens", "ids_crc32")


def token_spans(docs: DataFrame, tokenizer_path: str, end_id: int = 1, blank_kept: bool = False) -> DataFrame:
    """`write_tokens`, then `read_spans` of the files that it wrote. No documents, no rows."""
    scratch = Scratch(docs.sparkSession, "tokens")
    ids_by_rank = write_tokens(docs, tokenizer_path, scratch, end_id, blank_kept)
    return read_spans(docs.sparkSession.read.parquet(scratch.path("blocks")), ids_by_rank)
