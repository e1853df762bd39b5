"""Tokens of two vocabularies over the same texts, cut into groups where both end at the same byte.

Each text, with a blank before it, is written as a string of one label for each
of its bytes: `0` no token ends there, `1` one of A does, `2` one of B does, `3`
both do. A regular expression takes the spans up to each `3`; the labels in a
span say how many tokens of either kind its group holds. Every pair of an A and a
B token of one group is a link. A pair of ids counts as many documents, over the
whole corpus, as hold it linked.

Both vocabularies cut a text before each run of white space, so labels are
made for such segments and kept; a text whose segments don't each give back
their own bytes is encoded whole.

Null and empty texts, and those whose tokens don't give back the bytes of the
text with a blank before it, have no tokens: zeros and an empty digest. Repeated
rows count each; null ids stay null. An empty table gives an empty table. Columns
beside doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick, prepare
from .tokens import LETTERS, MARKS, PLAIN

#: Pairs of ids, the most frequent ones, that every task holds with their counts (17 bytes each); all others are met by a join.
HELD_PAIRS = 1 << 18
#: Segments and their characters that a worker remembers, twice over; longer ones than LONG characters it doesn't.
KEEP, KEEP_CHARS, LONG = 250_000, 5_000_000, 200

SEGMENT = re.compile(r"\s*\S+|\s+\Z")
#: White space to Python and none to the vocabularies' rules.
ODD = "\x1c\x1d\x1e\x1f"
GROUP = re.compile(rb"[012]*3")
#: A word of letters that no normal form changes, after a blank or a line's end, and ASCII marks after it: its parts are tokens apart by the rules of A.
WORD = re.compile(rf"([ \n])({PLAIN.pattern})([{re.escape(MARKS)}]*)")
#: Links of one group that are laid out side by side.
LINKS_AT_ONCE = 1 << 16


def label_string(a: list[bytes], b: list[bytes]) -> bytes:
    """A label for each byte of a text that both lists of tokens spell."""
    labels = bytearray(b"0") * sum(map(len, a))
    for tokens, mark in ((a, 1), (b, 2)):
        at = 0
        for t in tokens:
            at += len(t)
            labels[at - 1] |= mark
    return bytes(labels)


def spans(labels: bytes) -> list[tuple[int, int, int, int]]:
    """(start, stop, A tokens, B tokens) of each group: the bytes up to each label of both."""
    return [(m.start(), m.end(), m[0].count(b"1") + 1, m[0].count(b"2") + 1) for m in GROUP.finditer(labels)]


class Segment(NamedTuple):
    """What a piece of text adds to its document."""

    text: str  # its groups as ids in decimal
    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    pairs: bytes  # the pairs that it links, a << 32 | b, 64 bits each
    times: bytes  # how often each, 64 bits each; nothing if once for each time it stands there


class Aligner:
    """Encodes by both vocabularies: A by a file of the tokenizers library, B by one of sentencepiece."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        back = {chr(c): b for b, c in LETTERS.items()}
        back |= {chr(b): b for b in range(256) if b not in LETTERS}
        self.a_bytes = {i: bytes(back[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in back for c in t)}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.a_size, self.b_size = (np.array([len(table.get(i, b"")) for i in range(max(table) + 1)]) for table in (self.a_bytes, dict(enumerate(self.b_bytes))))
        self.decimal = list(map(str, range(max(len(self.a_size), len(self.b_size)))))
        self.blank, self.line_end = self.b.piece_to_id("▁"), self.a.encode("\n").ids
        # white space that a piece has after other characters ties segments together
        ties = {x for p in pieces for x, y in zip(p.replace("▁", " ")[1:], p.replace("▁", " ")) if x.isspace() and not y.isspace()}
        self.tied = re.compile(f"[{re.escape(ODD + ''.join(sorted(ties)))}]")
        self.known: dict[str, Segment | None] = {}
        self.before: dict[str, Segment | None] = {}
        self.chars = 0

    def groups(self, text: str, ids_b: list[int]) -> list[tuple[int, int, list[int], list[int]]] | None:
        """(start, stop, ids of A, ids of B) of a text's groups; None if its tokens don't give back its bytes."""
        ids_a, own = self._ids_a(text), text.encode()
        try:
            a, b = [self.a_bytes[i] for i in ids_a], [self.b_bytes[i] for i in ids_b]
        except KeyError:
            return None
        if b"".join(a) != own or b"".join(b) != own:
            return None
        out, i, j = [], 0, 0
        for start, stop, n, m in spans(label_string(a, b)):
            out.append((start, stop, ids_a[i : i + n], ids_b[j : j + m]))
            i, j = i + n, j + m
        return out

    def _ids_a(self, text: str) -> list[int]:
        """The ids of A; a word of plain letters, and marks after it, go to the library's model without the steps before it."""
        m = WORD.fullmatch(text)
        if not m:
            return self.a.encode(text, add_special_tokens=False).ids
        lead, word, marks = m.groups()
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(LETTERS)
        ids = [t.id for t in self.a.model.tokenize("Ġ" + letters if lead == " " else letters)]
        if marks:
            ids += [t.id for t in self.a.model.tokenize(marks)]
        return ids if lead == " " else self.line_end + ids

    def _segment(self, text: str, ids_b: list[int]) -> Segment | None:
        """One text, however long its groups are: its distinct pairs with how often each is linked."""
        groups = self.groups(text, ids_b)
        if not groups:
            return None
        links: Counter = Counter()
        for _, _, x, y in groups:
            times = Counter(y)
            for p, k in Counter(x).items():
                for q, n in times.items():
                    links[p << 32 | q] += k * n
        line = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for _, _, x, y in groups)
        return Segment(line, sum(len(g[2]) for g in groups), len(ids_b), len(groups), sum(links.values()), array("q", links).tobytes(), array("q", links.values()).tobytes())

    def _segments(self, new: list[str], lists_b: list[list[int]]) -> list[Segment | None]:
        """The same for many short segments at once, none of white space alone: A cuts their string before each white space, and their labels stand in one string, which a group never crosses, for both kinds of tokens end where a segment does."""
        one = "".join(new)
        flat_a, flat_b = self.a.encode_batch_fast([one], add_special_tokens=False)[0].ids, list(chain.from_iterable(lists_b))
        own = one.encode()
        if b"".join(map(self.a_bytes.get, flat_a, repeat(b""))) != own or b"".join(map(self.b_bytes.__getitem__, flat_b)) != own:
            return [self._segment(p, ids) for p, ids in zip(new, lists_b)]
        a, b = np.array(flat_a, np.int64), np.array(flat_b, np.int64)
        stops = np.cumsum([len(p) for p in new] if len(own) == len(one) else [len(p.encode()) for p in new])
        size_a = self.a_size[a]
        stops_a = np.cumsum(size_a)
        n_a = np.searchsorted(stops_a, stops) + 1  # tokens of A up to each segment's end
        if not size_a.all() or (stops_a[n_a - 1] != stops).any():
            return [self._segment(p, ids) for p, ids in zip(new, lists_b)]
        labels = np.full(len(own), ord("0"), np.uint8)
        labels[stops_a - 1] |= 1
        labels[np.cumsum(self.b_size[b]) - 1] |= 2
        last = np.cumsum(list(map(len, GROUP.findall(labels.tobytes())))) - 1  # where each group ends
        n, m = (np.diff(np.cumsum(labels & bit != 0)[last], prepend=0) for bit in (1, 2))
        to_a, to_b = np.cumsum(n), np.cumsum(m)
        links = n * m
        if links.max(initial=0) > LINKS_AT_ONCE:
            return [self._segment(p, ids) for p, ids in zip(new, lists_b)]
        to = np.cumsum(links)
        group = np.repeat(np.arange(len(n)), links)
        k = np.arange(len(group)) - (to - links)[group]
        pairs = (a[(to_a - n)[group] + k // m[group]] << 32 | b[(to_b - m)[group] + k % m[group]]).tobytes()
        sa, sb = list(map(self.decimal.__getitem__, flat_a)), list(map(self.decimal.__getitem__, flat_b))
        lines = [f"{sa[i - 1]}|{sb[j - 1]}" if x == y == 1 else f"{','.join(sa[i - x : i])}|{','.join(sb[j - y : j])}" for i, j, x, y in zip(to_a.tolist(), to_b.tolist(), n.tolist(), m.tolist())]
        ends = np.searchsorted(last, stops - 1, "right")
        out, g0, l0 = [], 0, 0
        for g, at, x, y in zip(ends.tolist(), to[ends - 1].tolist(), np.diff(n_a, prepend=0).tolist(), lists_b):
            out.append(Segment(";".join(lines[g0:g]), x, len(y), g - g0, at - l0, pairs[8 * l0 : 8 * at], b""))
            g0, l0 = g, at
        return out

    def whole(self, text: str) -> Segment | None:
        """A text without cutting it into segments first."""
        return self._segment(" " + text, self.b.encode(text))

    def pieces(self, text: str | None) -> list[str] | None:
        """The segments of a text with a blank before it; None if it must be encoded whole."""
        if not text:
            return []
        return None if self.tied.search(text) else SEGMENT.findall(" " + text)

    def _ids_b(self, new: list[str]) -> list[list[int] | None]:
        """The ids of B of segments: the blank that the vocabulary adds is the segment's own, or, before other white space, taken off."""
        found = self.b.encode([p[1:] if p[0] == " " else p for p in new], num_threads=1)
        return [ids if p[0] == " " else ids[1:] if ids and ids[0] == self.blank else None for p, ids in zip(new, found)]

    def _short(self, new: list[str]) -> list[Segment | None]:
        ids = self._ids_b(new)
        found: list[Segment | None] = [None] * len(new)
        good = []
        for k, x in enumerate(ids):
            if x is not None:
                if new[k].isspace():  # the next one's white space would belong to it
                    found[k] = self._segment(new[k], x)
                else:
                    good.append(k)
        for at in range(0, len(good), 4096):
            part = good[at : at + 4096]
            for k, s in zip(part, self._segments([new[k] for k in part], [ids[k] for k in part])):
                found[k] = s
        return found

    def batch(self, texts: list[str | None]) -> list[list[Segment]]:
        """The segments of each document, in order; none if it has no tokens."""
        if len(self.known) > KEEP or self.chars > KEEP_CHARS:
            self.before, self.known, self.chars = self.known, {}, 0
        cut = [self.pieces(t) for t in texts]
        new, here = [], {}
        for p in set(chain.from_iterable(filter(None, cut))):
            if p in self.known:
                here[p] = self.known[p]
            elif p in self.before:
                here[p] = self.known[p] = self.before[p]
            else:
                new.append(p)
        for p in [p for p in new if len(p) > LONG]:
            here[p] = (lambda ids: None if ids is None else self._segment(p, ids))(self._ids_b([p])[0])  # noqa: B023
        short = [p for p in new if len(p) <= LONG]
        for p, s in zip(short, self._short(short)):
            here[p] = self.known[p] = s
            self.chars += len(p)
        odd = {p for p, s in here.items() if s is None}
        out = []
        for text, pieces in zip(texts, cut):
            found = None if pieces is None or odd and not odd.isdisjoint(pieces) else list(map(here.__getitem__, pieces))
            if found is None:
                one = self.whole(text)
                found = [one] if one else []
            out.append(found)
        return out


def links_of(segments: list[Segment]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs that a document links, and how often each."""
    *_, links, often = zip(*segments) if segments else ((), ())
    pairs = np.frombuffer(b"".join(links), np.int64)
    if not any(often):
        return np.unique(pairs, return_counts=True)
    times = np.frombuffer(b"".join([s.times or ONE * (len(s.pairs) // 8) for s in segments]), np.int64)
    order = np.argsort(pairs, kind="stable")
    pairs, times = pairs[order], times[order]
    first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
    return pairs[first], np.add.reduceat(times, first)


ONE = (1).to_bytes(8, "little")
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process."""
    key = (path_a, path_b)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


GROUPS = "doc_id bigint, groups array<struct<start:bigint,stop:bigint,a:array<int>,b:array<int>>>"


def token_groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, groups): each group's bytes in the text with a blank before it, and its ids of both vocabularies."""
    prepare(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ = aligner(path_a, path_b)
        for batch in batches:
            found = [with_.groups(" " + t, with_.b.encode(t)) if t else None for t in batch.column(1).to_pylist()]
            rows = [[dict(zip(("start", "stop", "a", "b"), g)) for g in row or []] for row in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "groups"])

    return _texts(docs).mapInArrow(run, GROUPS)


def _texts(docs: DataFrame) -> DataFrame:
    return pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


DIGESTS = ["n_a", "n_b", "n_groups", "n_links"]


def digests(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): each document's numbers, and the distinct pairs that it links with how often."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ = aligner(path_a, path_b)
        for batch in batches:
            found = with_.batch(batch.column(1).to_pylist())
            columns = [list(zip(*row)) for row in found]
            numbers = [pa.array([sum(row[k]) if row else 0 for row in columns], pa.int64()) for k in range(1, 5)]
            digest = [hashlib.sha256(";".join(row[0]).encode()).hexdigest() if row else "" for row in columns]
            columns.clear()
            links = [links_of(row) for row in found]
            at = pa.array(np.r_[0, np.cumsum([len(p) for p, _ in links])], pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate([x[k] for x in links]) if links else [], pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(digest), *lists], names=["doc_id", *DIGESTS, "groups_sha256", "pairs", "times"])

    return _texts(docs).mapInArrow(run, f"doc_id bigint, {', '.join(f'{c} bigint' for c in DIGESTS)}, groups_sha256 string, pairs array<bigint>, times array<bigint>")


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): how many documents (of `digests`) hold a pair linked, and whether none of its A id has more."""
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    # each id of A has one row here, so this side is as small as the vocabulary
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    return counts.join(most, F.shiftright(F.col("pair"), 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, path_a: str, path_b: str, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best (links of the A id's most frequent pairs), count_sum (over links) and groups_sha256.

    Tasks hold the `held_pairs` most frequent pairs; links of others go through a
    join with all counts, once for each distinct row of groups.
    """
    scratch = Scratch(docs.sparkSession, "align")
    found = scratch.store(digests(docs, path_a, path_b), "digests")
    counts = scratch.store(pair_counts(found), "counts")
    top = counts.orderBy(F.desc("n"), "pair").limit(held_pairs).toArrow().sort_by("pair")
    held = docs.sparkSession.sparkContext.broadcast(tuple(np.asarray(top.column(c).to_numpy(), np.int64).tobytes() for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = (np.r_[np.frombuffer(x, np.int64), -1] for x in held.value)  # -1: no pair, after the last
        for batch in batches:
            lists, times = batch.column(6), batch.column(7).flatten().to_numpy()
            asked, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            at = np.searchsorted(pair[:-1], asked)
            met = pair[at] == asked
            row = np.repeat(np.arange(len(batch)), size)

            def total(values: np.ndarray) -> pa.Array:
                ends = np.r_[0, np.cumsum(values)][np.r_[0, np.cumsum(size)]]
                return pa.array(np.diff(ends), pa.int64())

            weight = np.where(met, times, 0)
            rest = np.r_[0, np.cumsum(np.bincount(row[~met], minlength=len(batch)))]
            rests = [pa.ListArray.from_arrays(pa.array(rest, pa.int32()), pa.array(x[~met], pa.int64())) for x in (asked, times)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], total(best[at] * weight), total(n[at] * weight), *rests], names=[*batch.schema.names[:6], "n_best", "count_sum", "pairs", "times"])

    looked_up = found.mapInArrow(run, f"doc_id bigint, {', '.join(f'{c} bigint' for c in DIGESTS)}, groups_sha256 string, n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>")
    columns = ["doc_id", *DIGESTS, "n_best", "count_sum", "groups_sha256"]
    if top.num_rows < held_pairs:  # every pair is held, so nothing is left for the join
        return looked_up.select(columns)
    looked_up = scratch.store(looked_up, "looked-up")
    scratch.drop("digests")
    asked = looked_up.where(F.size("pairs") > 0).groupBy("groups_sha256").agg(F.first(F.arrays_zip("pairs", "times")).alias("rest")).select(F.col("groups_sha256").alias("d"), F.explode("rest").alias("r"))
    asked = asked.select("d", F.col("r.pairs").alias("pair"), "r.times")
    added = asked.join(counts, "pair").groupBy("d").agg(F.sum(F.col("times") * F.col("best").cast("bigint")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
    joined = looked_up.join(added, looked_up.groups_sha256 == added.d, "left")
    plus = lambda c, more: (F.col(c) + F.coalesce(F.col(more), F.lit(0))).alias(c)
    return joined.select("doc_id", *DIGESTS, plus("n_best", "more_best"), plus("count_sum", "more"), "groups_sha256")
