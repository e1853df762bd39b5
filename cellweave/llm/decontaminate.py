"""Benchmark decontamination: a BM25 index of test items with block-max WAND, queried with every passage of the corpus."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, prepare

#: BM25's usual parameters.
K1, B = 1.2, 0.75
#: Items in a block of a posting list.
BLOCK = 4
#: Bytes of test items that may be sent to every executor.
MOST_BYTES = 64 << 20

_BREAKS = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
HITS = "doc_id bigint, item_id bigint, score double, question double, answer double"


def terms_of(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII marks and white space part them."""
    return (text or "").lower().encode().translate(_BREAKS).split()


def halves(text: str) -> tuple[str, str]:
    """Question and answer: where an item is one text, its last sentence is the answer."""
    parts = re.split(r"(?<=[.!?])\s+", text.strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


def _grams(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


@dataclass
class Index:
    """Posting lists (item, impact) of the terms of the test items, in blocks of BLOCK neighbouring items with their largest impact.

    An impact is a term's BM25 weight in the item, divided by the item's score
    against itself; so an item scores 1 in a passage that holds all its terms.
    """

    item_ids: list[int]
    vocabulary: dict[bytes, int]
    postings: list[tuple[list[int], list[float]]]
    grams: list[tuple[set, set]]
    words: int
    #: Of each term the largest impact of each of its blocks, and of all.
    maxima: list[dict[int, float]]
    most: list[float]

    @classmethod
    def of(cls, items: list[tuple[int, str, str]], n: int) -> "Index":
        """items: (id, question, answer); items without words are left out."""
        kept = [(i, terms_of(q), terms_of(a)) for i, q, a in items]
        kept = [x for x in kept if x[1] or x[2]]
        sizes = [len(q) + len(a) for _, q, a in kept]
        mean = sum(sizes) / max(1, len(sizes))
        df = Counter(t for _, q, a in kept for t in set(q + a))
        vocabulary = {t: k for k, t in enumerate(sorted(df))}
        postings: list[tuple[list[int], list[float]]] = [([], []) for _ in vocabulary]
        for k, (_, q, a) in enumerate(kept):
            weight = {t: np.log(1 + (len(kept) - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * sizes[k] / mean)) for t, f in Counter(q + a).items()}
            whole = sum(weight.values())
            for t, w in weight.items():
                postings[vocabulary[t]][0].append(k)
                postings[vocabulary[t]][1].append(float(w / whole))
        maxima: list[dict[int, float]] = []
        for found, impacts in postings:
            top: dict[int, float] = {}
            for i, w in zip(found, impacts):
                top[i // BLOCK] = max(w, top.get(i // BLOCK, 0.0))
            maxima.append(top)
        return cls([i for i, _, _ in kept], vocabulary, postings, [(_grams(q, n), _grams(a, n)) for _, q, a in kept], max(sizes, default=1), maxima, [max(x) for _, x in postings])

    def block_maxima(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each term its blocks and their largest impacts, as starts, blocks and impacts."""
        starts, blocks, most = [0], [], []
        for top in self.maxima:
            blocks += top.keys()
            most += top.values()
            starts.append(len(blocks))
        return np.array(starts), np.array(blocks, np.int64), np.array(most)

    def search(self, terms: set[int], least: float) -> list[tuple[int, float]]:
        """All items that score `least` or more against the terms, by block-max WAND.

        Lists are kept in the order of their current item. The pivot is the first
        item at which the largest impacts of the lists so far reach `least`; the
        maxima of the pivot's blocks are tried next, and where they fall short the
        lists skip to the end of the nearest block. Only else an item is scored.
        """
        lists = []
        for t in terms:
            items, impacts = self.postings[t]
            lists.append([items[0], 0, self.most[t], items, impacts, self.maxima[t]])
        found = []
        while lists:
            lists.sort(key=lambda x: x[0])
            bound, p = 0.0, 0
            for p, x in enumerate(lists):
                bound += x[2]
                if bound >= least:
                    break
            else:
                break
            pivot = lists[p][0]
            while p + 1 < len(lists) and lists[p + 1][0] == pivot:
                p += 1
            block = pivot // BLOCK
            bound = sum(x[5].get(block, 0.0) for x in lists[: p + 1])
            if bound >= least and lists[0][0] == pivot:
                score = sum(x[4][x[1]] for x in lists[: p + 1])
                if score >= least:
                    found.append((pivot, score))
                to = pivot + 1
            elif bound >= least:
                to = pivot
            else:
                to = (block + 1) * BLOCK
                if p + 1 < len(lists):
                    to = min(to, lists[p + 1][0])
                to = max(to, pivot + 1)
            for x in lists[: p + 1]:
                x[1] = bisect_left(x[3], to, x[1])
                x[0] = x[3][x[1]] if x[1] < len(x[3]) else -1
            lists = [x for x in lists if x[0] >= 0]
        return found


#: Numbers in a table of bounds: cells by blocks.
BOUNDS = 1 << 20


def _promising(where: np.ndarray, term: np.ndarray, cells: int, starts: np.ndarray, blocks: np.ndarray, most: np.ndarray, n_blocks: int, least: float) -> Iterator[int]:
    """Cells that begin a passage (two cells in a row) in which some block's maxima add up to `least`: (where, term) are the cells' terms, by cell.

    The bounds of a stretch of cells stand in a table of BOUNDS numbers at most,
    or of two cells. The last cell of a text borrows the next text's, which only
    loosens its bound.
    """
    step = max(1, BOUNDS // n_blocks - 1)
    for low in range(0, cells, step):
        here = slice(*np.searchsorted(where, [low, low + step + 1]))
        t, c = term[here], where[here] - low
        size = starts[t + 1] - starts[t]
        at = np.repeat(starts[t] - np.cumsum(size) + size, size) + np.arange(size.sum())
        bound = np.bincount(np.repeat(c, size) * n_blocks + blocks[at], most[at], minlength=(step + 1) * n_blocks).reshape(-1, n_blocks)
        found = np.flatnonzero((bound[:-1] + bound[1:]).max(axis=1) >= least - 1e-9) + low
        yield from found[found < cells].tolist()


def _query(index: Index, least: float, question: float, answer: float, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = max(8, index.words)
        starts, blocks, most = index.block_maxima()
        term_of, absent = index.vocabulary.get, repeat(-1)
        n_blocks = int(blocks.max(initial=-1)) + 1
        for batch in batches:
            rows: list[tuple] = []
            texts = [terms_of(x) for x in batch.column("text").to_pylist()]
            for lo in range(0, len(texts), 64):
                part = texts[lo : lo + 64]
                cells = [-(-len(x) // cell) for x in part]
                first = np.concatenate([[0], np.cumsum(cells)]).astype(np.int64)
                if not n_blocks or not first[-1]:
                    continue
                ids = [np.fromiter(map(term_of, x, absent), np.int64, len(x)) for x in part]
                where = np.concatenate([np.arange(len(x)) // cell + f for x, f in zip(ids, first)])
                term = np.concatenate(ids)
                where, term = where[term >= 0], term[term >= 0]
                key = np.unique(where * len(index.postings) + term)
                where, term = key // len(index.postings), key % len(index.postings)
                # the blocks' bounds of every cell, of all terms at once
                own = np.repeat(np.arange(len(part)), cells)
                best: dict[tuple[int, int], tuple] = {}
                for c in _promising(where, term, int(first[-1]), starts, blocks, most, n_blocks, least):
                    d = int(own[c])
                    at0 = (c - int(first[d])) * cell
                    terms = set(ids[d][at0 : at0 + 2 * cell].tolist())
                    terms.discard(-1)
                    for item, score in index.search(terms, least):
                        if (d, item) in best and best[d, item][0] >= 1 and best[d, item][1] >= 1:
                            continue
                        near = part[d][max(0, at0 - cell) : at0 + 3 * cell]
                        q, a = _overlaps(index.grams[item], near)
                        if q >= question and a >= answer:
                            best[d, item] = max(best.get((d, item), (0.0, 0.0, 0.0)), (q, a, score))
                rows += [(lo + d, index.item_ids[i], s, q, a) for (d, i), (q, a, s) in sorted(best.items())]
            take = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take)] + [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()), (4, pa.float64()))], names=["doc_id", "item_id", "score", "question", "answer"])

    return run


def _overlaps(grams: tuple[set, set], words: list[bytes]) -> tuple[float, float]:
    """The shares of an item's question and answer shingles that stand in a passage; 1 for an empty part."""
    out = []
    for part in grams:
        if not part:
            out.append(1.0)
            continue
        seen = _grams(words, len(next(iter(part))))
        out.append(len(part & seen) / len(part))
    return out[0], out[1]


def _item_rows(benchmark: DataFrame) -> tuple[DataFrame, bool]:
    both = {"question", "answer"} <= set(benchmark.columns)
    return pick(benchmark, item_id="item_id", q="question" if both else "text", a="answer" if both else "text").where("item_id is not null and (q is not null or a is not null)"), both


def read_items(benchmark: DataFrame) -> Iterator[list[tuple[int, str, str]]]:
    """(id, question, answer) of the test items, in parts of about MOST_BYTES at most; the columns question and answer, where there are any, else `halves` of text."""
    rows, both = _item_rows(benchmark)
    size = rows.agg(F.sum(F.coalesce(F.octet_length("q"), F.lit(0)) + F.coalesce(F.octet_length("a"), F.lit(0)))).first()[0] or 0
    parts = -(-size // MOST_BYTES) or 1
    for k in range(parts):
        found = sorted({(int(r["item_id"]), r["q"] or "", r["a"] or "") for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).collect()})
        yield found if both else [(i, *halves(q)) for i, q, _ in found]


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.6, question: float = 0.8, answer: float = 0.8, words: int = 5) -> DataFrame:
    """Documents that hold test items: (doc_id, item_id, score, question, answer), a row for each pair.

    An index of the test items goes to every executor, of MOST_BYTES of them at a
    time; the corpus is read once for each and not shuffled. Every text is cut into passages of
    twice the longest item's words, half overlapping, so an item stands whole in
    one of them. Block maxima, summed over a passage's terms for many passages at
    once, bound the scores; block-max WAND then retrieves every item that scores
    `least` of its score against itself. A pair counts if shares of `question` and
    `answer` of the item's shingles of `words` words stand near the passage.

    Null and empty texts hold nothing. Null ids are kept as null. Repeated rows
    are searched each. Items without words are left out; an item of fewer words
    than a shingle is one shingle. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    found = [rows.mapInArrow(_query(Index.of(items, words), least, question, answer, words), HITS) for items in read_items(benchmark)]
    return reduce(DataFrame.unionByName, found)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """`docs` without the documents that hold test items. Rows without an id are kept."""
    bad = contaminated(docs, benchmark, **options).where("doc_id is not null").select(F.col("doc_id").alias("cw_bad")).distinct()
    at = docs.columns.index("doc_id")
    plain = docs.toDF(*(f"cw_{i}" for i in range(len(docs.columns))))
    left = plain.join(bad, F.col(f"cw_{at}").cast("bigint") == F.col("cw_bad"), "left_anti")
    return left.select(*(F.col(f"cw_{i}").alias(n) for i, n in enumerate(docs.columns)))
