"""Substring deduplication by content-defined chunks: a gear hash cuts texts into them, digests of chunks that follow each other are compared, later copies go."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, pick, prepare

#: Bytes that the rolling hash looks at, its width in bits, and the units (words) of which one at least is a cut.
WINDOW, EVERY = 16, 12
#: Bytes of a long word that count as a word of text, and the length from which a word is long; ASCII bytes count a quarter of it.
LETTERS, LONG = 6, 64

_GEAR = np.random.default_rng(1077).integers(0, 2**WINDOW, 256, dtype=np.uint16)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

WINDOWS = "doc_id bigint, fp int, windows array<struct<digest:bigint,start:int,size:int,word:int,words:int>>"


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: the sum of G[b] << k over the WINDOW bytes up to it, k counted backwards; by doubling."""
    h = _GEAR[data]
    reach = 1
    while reach < WINDOW:
        h[reach:] += h[:-reach] << np.uint16(reach)
        reach *= 2
    return h


def units(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where windows may begin, what of a window each place takes up (a word is LETTERS), its word's number, and whether it begins it.

    These are the words; in long words, as in scripts without spaces, all characters.
    """
    space = _SPACE[data]
    head = ~space & np.append(True, space[:-1])[: len(data)]
    begins = np.flatnonzero(head)
    cost = np.append(0, np.cumsum(np.where(space, 0, np.where(data < 128, 1, 4))))
    long = np.flatnonzero(np.diff(cost[np.append(begins, len(data))]) > 4 * LONG)
    if not len(long):
        return begins, np.full(len(begins), LETTERS), np.arange(len(begins)), np.ones(len(begins), bool)
    word = np.cumsum(head) - 1
    within = np.zeros(len(begins), bool)
    within[long] = True
    at = np.flatnonzero(head | ~space & ((data & 0xC0) != 0x80) & within[word])
    # a character of a long word takes up its bytes
    bytes_ = np.where(data[at] < 0xC0, 1, np.where(data[at] < 0xE0, 2, np.where(data[at] < 0xF0, 3, 4)))
    return at, np.where(within[word[at]], bytes_, LETTERS), word[at], head[at]


def _least(keys: np.ndarray) -> np.ndarray:
    """The first of the least keys in each stretch of EVERY: at least one in any stretch, decided by nothing outside of it."""
    best = (keys.astype(np.int64) << 32) | np.arange(len(keys))
    reach = 1
    while reach < min(EVERY, len(best)):
        step = min(reach, EVERY - reach, len(best) - 1)
        best = np.minimum(best[:-step], best[step:])
        reach += step
    best = best & (2**32 - 1)
    return best[np.append(True, best[1:] != best[:-1])[: len(best)]]


def _cut_units(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _least(gear(data)[np.minimum(at + WINDOW - 1, len(data) - 1)])


def cuts(data: np.ndarray) -> np.ndarray:
    """Where windows begin, from 0: at the least hash of the WINDOW bytes from a unit on, in any EVERY units that follow each other.

    Only what stands in those decides on a cut, so an insertion moves the cuts
    after it and changes none of them, and no stretch, however it repeats itself,
    is without one.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    at = units(data)[0]
    return np.unique(np.append(0, at[_cut_units(data, at)]))


def _fingerprint(raw: bytes) -> int:
    """Of a text, to tell apart rows that share an id."""
    return xxhash.xxh32_intdigest(raw) - 2**31


def chunk_runs(data: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Where a text's chunks begin (and its end), and of each run of chunks to compare its first chunk, the one after its last, its first word's number, its words and its first unit.

    Chunks lie between cuts; the first begins at 0. A run is one chunk and those
    after it, or those before it, up to `least` words: so runs cover all from the
    first to the last of any cuts that are so far apart.
    """
    at, weight, word, head = units(data)
    reach = np.append(0, np.cumsum(weight))
    k = _cut_units(data, at)
    k = np.append(k if len(k) and k[0] == 0 else np.append(0, k), len(at)) if len(at) else np.zeros(1, np.int64)
    begin = np.append(at, len(data))[k]
    begin[0] = 0
    # words are counted where a part of them is in a run
    first_word, last_word = np.append(word, 0)[k], np.append(word + ~head, word[-1] + 1 if len(word) else 0)[k]
    far = reach[k]
    n = len(k)
    onward = np.searchsorted(far, far + LETTERS * least)
    back = np.searchsorted(far, far - LETTERS * least, "right") - 1
    first = np.concatenate([np.flatnonzero(onward < n), back[back >= 0]])
    after = np.concatenate([onward[onward < n], np.flatnonzero(back >= 0)])
    pair = np.unique(first * (n + 1) + after)
    i, j = pair // (n + 1), pair % (n + 1)
    return begin, i, j, first_word[i], last_word[j] - first_word[i], k[i]


def _windows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, ends, digests, starts, sizes, firsts, words = [], [0], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode()
                places, i, j, first, count, unit = chunk_runs(np.frombuffer(raw, np.uint8), least)
                fps.append(_fingerprint(raw))
                # white space around a chunk isn't part of its digest; a run's is that of its chunks' digests
                chunks = np.array([xxhash.xxh3_64_intdigest(raw[a:b].strip()) for a, b in zip(places.tolist(), places[1:].tolist())], np.uint64).tobytes() if len(i) else b""
                found = [xxhash.xxh3_64_intdigest(chunks[8 * a : 8 * b]) - 2**63 for a, b in zip(i.tolist(), j.tolist())]
                begin, end = places[i], places[j]
                if len(unit) > 1 and (np.diff(unit) == 1).any():
                    # where one word repeats, every place is a cut: of equal windows in a row, some that touch say the same
                    same = np.append(False, (np.diff(unit) == 1) & (np.diff(np.array(found)) == 0))
                    row = np.arange(len(unit))
                    row -= np.maximum.accumulate(np.where(same, 0, row))
                    keep = ~same | (row % max(1, least // 2) == 0) | ~np.append(same[1:], False)
                    begin, end, first, count = begin[keep], end[keep], first[keep], count[keep]
                    found = [x for x, y in zip(found, keep.tolist()) if y]
                digests += found
                starts.append(begin)
                sizes.append(end - begin)
                firsts.append(first)
                words.append(count)
                ends.append(ends[-1] + len(begin))
            flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0), pa.int32())
            items = pa.StructArray.from_arrays([pa.array(digests, pa.int64()), *map(flat, (starts, sizes, firsts, words))], names=["digest", "start", "size", "word", "words"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)], names=["doc_id", "fp", "windows"])

    return run


def repeated_spans(docs: DataFrame, least_words: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages that stand elsewhere before: (doc_id, fp, start, size, words, keeper), places in UTF-8 bytes.

    A text is cut into chunks, at whole words, where the gear hash says. From
    every chunk on, and back from every chunk, as many are taken as have
    `least_words` words; equal runs of chunks have one digest. The first copy of
    a run, by document and place, is kept. Later copies, where they don't overlap
    the first, are repeats, and those that touch make one span: so all words of a
    span stand in `least_words` words that stood together in one earlier place. As
    any EVERY words in a row have a cut, and only words up to EVERY - 1 away decide
    on one, a passage of least_words + 2 * EVERY - 1 words is always found, and
    loses at most EVERY - 1 words at its start and EVERY at its end. In words of over LONG
    bytes (ASCII: four times that), as of scripts without spaces, chunks begin
    at characters and have LETTERS bytes for a word. keeper is the document that
    holds the first copy of the span's first run.

    A document is named by its id and fp, a digest of its text. Rows that repeat
    both are one document, and stay alike. Texts of fewer words, null and empty
    ones too, have no runs. Null ids come before others. Other columns are
    ignored. Only digests and places are shuffled; a digest's copies are reduced
    to a count and the first of them.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "chunks")
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    taken = rows.mapInArrow(_windows(least_words), WINDOWS).select("doc_id", "fp", F.explode("windows").alias("c")).select("doc_id", "fp", "c.*")
    # runs are cheaper to cut twice than to store: each pass shuffles, and its files are gone before the next
    many = taken.groupBy("digest").agg(F.min(F.struct("doc_id", "fp", "start")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    many = scratch.store(many.select("digest", "first"), "many")
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("fp") == F.col("first.fp")) & (F.col("start") < F.col("first.start") + F.col("size"))
    later = taken.join(many.hint("merge"), "digest").where(~own).select("doc_id", "fp", "start", "size", "word", "words", F.col("first.doc_id").alias("keeper"))
    order = Window.partitionBy("doc_id", "fp").orderBy("start")
    placed = later.withColumn("reached", F.max(F.col("start") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    runs = placed.withColumn("run", F.sum(F.when(F.col("reached") >= F.col("start"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "fp", "run")
    end, last = F.max(F.col("start") + F.col("size")), F.max(F.col("word") + F.col("words"))
    found = runs.agg(F.min("start").alias("start"), (end - F.min("start")).cast("int").alias("size"), (last - F.min("word")).cast("int").alias("words"), F.min_by("keeper", "start").alias("keeper"))
    found = scratch.store(found.drop("run"), "spans")
    scratch.drop("many")
    return found


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = pa.array([_fingerprint((x or "").encode()) for x in batch.column("cw_text").to_pylist()], pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns, fp], names=[*batch.schema.names, "cw_fp"])


def drop_repeats(docs: DataFrame, least_words: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the spans of `repeated_spans` cut out of the text column; rows whose whole text goes are dropped.

    All columns stay, in order. Texts without such spans, null and empty ones too,
    are left as they are. Texts are shuffled once, to meet their spans.
    """
    from pyspark.sql.types import IntegerType, StructField, StructType

    spans = repeated_spans(docs, least_words, id_col, text_col)
    names = docs.columns
    at, text_at = names.index(id_col), names.index(text_col)
    plain = docs.toDF(*(f"cw_{i}" for i in range(len(names)))).withColumnRenamed(f"cw_{text_at}", "cw_text")
    marked = plain.mapInArrow(_mark, StructType([*plain.schema.fields, StructField("cw_fp", IntegerType())]))
    per_doc = spans.groupBy(F.col("doc_id").alias("cw_doc"), F.col("fp").alias("cw_key")).agg(F.array_sort(F.collect_list(F.struct("start", "size"))).alias("cw_spans"))
    both = marked.join(per_doc, F.col(f"cw_{at}").cast("bigint").eqNullSafe(F.col("cw_doc")) & (F.col("cw_fp") == F.col("cw_key")), "left")
    # cut where all spans of a text are known: pieces between the spans, on bytes
    raw = F.col("cw_text").cast("binary")
    step = F.aggregate(
        "cw_spans",
        F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("kept")),
        lambda a, s: F.struct((s["start"] + s["size"] + 1).alias("at"), F.concat(a["kept"], F.array(F.substring(raw, a["at"], s["start"] + 1 - a["at"]).cast("string"))).alias("kept")),
        lambda a: F.rtrim(F.concat(F.concat_ws("", a["kept"]), F.substring(raw, a["at"], F.lit(2**31 - 1)).cast("string"))),
    )
    cut = both.withColumn("cw_text", F.when(F.col("cw_spans").isNull(), F.col("cw_text")).otherwise(step))
    left = cut.where("cw_spans is null or cw_text != ''")
    return left.select(*(F.col("cw_text" if i == text_at else f"cw_{i}").alias(n) for i, n in enumerate(names)))
