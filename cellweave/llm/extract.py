"""Main text of web pages: elements that name themselves first, then a suffix array over the pages of each host."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, pick, prepare
from .neardup import sorted_groups
from .reputation import host_of

#: Fixed names. Elements that are never text of the article; those whose content is raw; those without content; those within a line.
LEFT_OUT = frozenset("aside button datalist dialog footer form head header iframe input label menu nav noscript object option search select svg template textarea".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Words of class, id or role that mark what isn't the article: alone, or at the end of a compound (site-footer), or before words of PLACES (ad-slot).
MARKS = frozenset("ad ads adsense advert advertisement adverts advertising alert alertdialog banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies disqus footer header masthead menu menubar modal nav navbar navigation newsletter notice notices paywall popup promo related replies respond search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
PLACES = frozenset("area bar block bottom box button buttons column consent container content form group inline inner item items left links list panel right section signup slot top unit wrap wrapper".split())
#: Compounds that begin so tell of a state, not of what the element is.
STATES = frozenset("has hide is no not show with without".split())
#: Elements that hold whole pages or articles keep their content whatever their class says.
WHOLE = frozenset("html body main article".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?)?""")
_PARTS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")

PARSED = "page_id bigint, url string, blocks array<string>, settled boolean"
TEXTS = "uid string, text string"
SUBSTRINGS = "host string, uid string, digest bigint, at int"


def _names_itself(word: str) -> bool:
    parts = [p.lower() for p in _PARTS.split(word) if p]
    if not parts or parts[0] in STATES:
        return False
    return parts[-1] in MARKS or parts[0] in MARKS and all(p in PLACES or p in MARKS for p in parts[1:])


def _marked(name: str, attributes: dict[str, str]) -> bool:
    if name in WHOLE or not attributes:
        return False
    if "hidden" in attributes or "none" in attributes.get("style", "") and re.search(r"display\s*:\s*none", attributes["style"], re.I):
        return True
    return any(_names_itself(w) for a in ("class", "id", "role") for w in attributes.get(a, "").split())


def _tag(page: str, at: int) -> tuple[dict[str, str], bool, int]:
    """The attributes of a tag whose name ends at `at`, whether it closes itself, and where it ends.

    Only quotes at the start of a value are quotes; one that is never closed is
    none. Each place of the page is looked at a few times, however broken it is.
    """
    out: dict[str, str] = {}
    size = len(page)
    while at < size:
        m = _ATTRIBUTE.match(page, at)
        if not m:
            break
        value = m[2] or ""
        out.setdefault(m[1].lower(), value[1:-1] if value[:1] in "\"'" and value else value)
        at = m.end()
        if at < size and page[at] in "\"'":  # a quote that nothing closes
            at += 1
    end = page.find(">", at)
    return out, end > 0 and page[end - 1] == "/", size if end < 0 else end + 1


def tokens_of(page: str) -> Iterator[tuple[int, str, dict[str, str] | str]]:
    """Pieces of a page: (0, "", text), (1, name, attributes) of a start tag, (-1, name, "") of an end tag; (2, name, attributes) closes itself. Comments are left out."""
    at, size = 0, len(page)
    while at < size:
        begin = page.find("<", at)
        if begin < 0 or begin == size - 1:
            break
        if begin > at:
            yield 0, "", page[at:begin]
        at = begin
        next_ = page[begin + 1]
        if next_ in "!?" or next_ == "/" and not _NAME.match(page, begin + 2):
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 4)
                at = end + 3 if end >= 0 else size
            elif page.startswith("<![CDATA[", begin):
                end = page.find("]]>", begin)
                yield 0, "", html.escape(page[begin + 9 : end if end >= 0 else size])
                at = end + 3 if end >= 0 else size
            else:
                end = page.find(">", begin)
                at = end + 1 if end >= 0 else size
            continue
        m = _NAME.match(page, begin + 1 + (next_ == "/"))
        if not m:
            yield 0, "", "<"
            at = begin + 1
            continue
        name = m[0].lower()
        if page.startswith(">", m.end()):
            attributes, closed, at = {}, False, m.end() + 1
        else:
            attributes, closed, at = _tag(page, m.end())
        if next_ == "/":
            yield -1, name, ""
            continue
        yield 2 if closed else 1, name, attributes
        if name in RAW and not closed:
            end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            if end is None:
                return
            if end.start() > at:
                yield 0, "", page[at : end.start()]
            at = end.start()
    if at < size:
        yield 0, "", page[at:]


def blocks_of(page: str) -> tuple[list[str], bool]:
    """The blocks of text of a page, and whether an article or main element settles what they are.

    Elements that are left out, by name or mark, end at their own end tag; where
    there is none, only script-like ones run on to the end of the page. Inside an
    article (else a main element) all other text counts; without either, all of
    the page's other text comes back unsettled.
    """
    tokens = list(tokens_of(page))
    # the end of each element of a kind that matters, by counting tags of its own name
    ends: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for k, (kind, name, rest) in enumerate(tokens):
        if kind == 1 and name not in VOID:
            open_.setdefault(name, []).append(k)
        elif kind == -1 and open_.get(name):
            ends[open_[name].pop()] = k
    inside: dict[str, list[str]] = {"article": [], "main": [], "": []}
    depth = {"article": 0, "main": 0}
    held: dict[str, list[str]] = {"article": [], "main": [], "": []}

    def cut() -> None:
        for where, parts in held.items():
            if parts:
                block = "".join(parts)
                block = " ".join((html.unescape(block) if "&" in block else block).split())
                if block:
                    inside[where].append(block)
                parts.clear()

    k = 0
    while k < len(tokens):
        kind, name, rest = tokens[k]
        if kind == 0:
            for where in ("article", "main", ""):
                if not where or depth[where]:
                    held[where].append(rest)
        else:
            if name not in INLINE:
                cut()
            if kind > 0 and name not in VOID:
                if name in RAW or name in LEFT_OUT or _marked(name, rest):
                    if k in ends:
                        k = ends[k]
                    elif name in RAW and kind == 1:
                        break
                elif name in depth and kind == 1:
                    depth[name] += 1
            elif kind == -1 and name in depth:
                depth[name] = max(0, depth[name] - 1)
        k += 1
    cut()
    for where in ("article", "main"):
        if inside[where]:
            return inside[where], True
    return inside[""], False


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [blocks_of(x or "") for x in batch.column("html").to_pylist()]
        texts = [b for b, _ in found]
        settled = [s or not b for b, s in found]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.list_(pa.string())), pa.array(settled, pa.bool_())], names=["page_id", "url", "blocks", "settled"])


def repeated(tokens: np.ndarray, page: np.ndarray, least: int) -> np.ndarray:
    """Which tokens stand in a substring of `least` tokens that two pages at least share.

    All suffixes that share their first `least` tokens stand together in the array;
    a token is in a repeat of `least` tokens or more exactly if it is in one of `least`.
    """
    n = len(tokens)
    covered = np.zeros(n + 1, np.int64)
    if n < least:
        return covered[:n] > 0
    rank = suffix_ranks(tokens, least)
    whole = np.zeros(n, bool)
    whole[: n - least + 1] = page[: n - least + 1] == page[least - 1 :]
    at = np.flatnonzero(whole)
    array = at[np.argsort(rank[at], kind="stable")]
    edge = np.flatnonzero(np.diff(rank[array], prepend=-1))
    if not len(array):
        return covered[:n] > 0
    low, high = np.minimum.reduceat(page[array], edge), np.maximum.reduceat(page[array], edge)
    hit = array[np.repeat(low != high, np.diff(np.append(edge, len(array))))]
    np.add.at(covered, hit, 1)
    np.subtract.at(covered, hit + least, 1)
    return np.cumsum(covered)[:n] > 0


def _tokens(pages: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words that pages hold, "" first; the number of each token's word, 0 between blocks; and the token's page."""
    known: dict[str, int] = {"": 0}
    tokens, owner = [], []
    for k, blocks in enumerate(pages):
        for block in blocks:
            words = block.split(" ")
            tokens += [known.setdefault(w, len(known)) for w in words]
            tokens.append(0)
            owner += [k] * (len(words) + 1)
    return list(known), np.array(tokens, np.int64), np.array(owner, np.int64)


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """The rank of each suffix among all, by its first `depth` tokens: the suffix array sorted to that depth, by prefix doubling. What ends before is less."""
    n = len(tokens)
    rank, length = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while length < depth:
        step = min(length, depth - length)
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        after[np.arange(n) > n - step - length] = -1
        rank = np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        length += step
    return rank


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _window_digests(words: list[str], tokens: np.ndarray, least: int) -> np.ndarray:
    """A digest of the `least` tokens from each place on."""
    names = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)[tokens]
    n = max(0, len(names) - least + 1)
    out = np.full(n, least, np.uint64)
    for k in range(least):
        out = (out ^ names[k : k + n]) * _ODD
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def few(pages: int, alone: bool) -> float:
    """On how many of a part's pages a substring must stand to be counted, so that the parts' counts add up.

    What stands on SHARE of a host's pages, dealt at random, stands on fewer in a
    part of so many with a chance of about one in a billion; in small parts, of
    large pages, everything is counted. The only part of a host counts for itself.
    """
    return max(2, FEW * pages) if alone else 1 if pages < 64 else pages / 8 if pages < 256 else FEW * pages


def common_substrings(pages: list[list[str]], least: int, alone: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """Of distinct pages, the digests of substrings of `least` tokens that stand on `few` of them, on how many, and how many pages there are. alone: the host has no other part."""
    pages = [list(p) for p in dict.fromkeys(map(tuple, pages))]
    words, tokens, owner = _tokens(pages)
    if len(tokens) < least or alone and len(pages) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), len(pages)
    rank = suffix_ranks(tokens, least)
    whole = np.flatnonzero(owner[: len(tokens) - least + 1] == owner[least - 1 :])
    array = whole[np.lexsort((owner[whole], rank[whole]))]  # suffixes in order, those alike by page
    new = np.append(True, np.diff(rank[array]) != 0)
    on = np.add.reduceat((new | np.append(True, np.diff(owner[array]) != 0)).astype(np.int64), np.flatnonzero(new)) if len(array) else np.zeros(0, np.int64)
    often = on >= few(len(pages), alone)
    return _window_digests(words, tokens, least)[array[new][often]], on[often], len(pages)


def without(blocks: list[str], digests: frozenset[int], least: int) -> str:
    """A page's text without the words that substrings with these digests cover."""
    if not digests or not blocks:
        return " ".join(blocks)
    words, tokens, _ = _tokens([blocks])
    at = np.flatnonzero(np.isin(_window_digests(words, tokens, least), np.fromiter(digests, np.int64, len(digests))))
    if not len(at):
        return " ".join(blocks)
    gone = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(gone, at, 1)
    np.subtract.at(gone, at + least, 1)
    return " ".join(words[t] for t in tokens[(np.cumsum(gone[:-1]) == 0) & (tokens > 0)])


def unique_runs(pages: list[list[str]], least: int, marks: list[list[int] | None] | None = None) -> list[str]:
    """Each page's text without what it shares with others: the blocks' words that no repeated substring covers.

    marks: the tokens of each page at which substrings begin that are known to stand on other pages.
    """
    words, tokens, owner = _tokens(pages)
    gone = repeated(tokens, owner, least)
    if marks:
        first = np.searchsorted(owner, np.arange(len(pages)))
        for k, at in enumerate(marks):
            for x in at or []:
                gone[first[k] + x : first[k] + x + least] = True
    out: list[list[str]] = [[] for _ in pages]
    for k in np.flatnonzero(~gone & (tokens > 0)).tolist():
        out[owner[k]].append(words[tokens[k]])
    return [" ".join(x) for x in out]


def _substrings(least: int):
    """A digest of each substring of `least` tokens and the token where it begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, blocks in enumerate(batch.column("blocks").to_pylist()):
                words, tokens, _ = _tokens([blocks])
                names = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)[tokens]
                n = len(names) - least + 1
                if n < 1:
                    continue
                table = np.lib.stride_tricks.sliding_window_view(names, least)
                digests = pa.array([xxhash.xxh3_64_intdigest(np.ascontiguousarray(x)) - 2**63 for x in table], pa.int64())
                one = [pa.array([v] * n, batch.schema.field(c).type) for c, v in (("host", batch.column("host")[k].as_py()), ("uid", batch.column("uid")[k].as_py()))]
                yield pa.RecordBatch.from_arrays([*one, digests, pa.array(np.arange(n), pa.int32())], names=["host", "uid", "digest", "at"])

    return run


def _settle(least: int, most_pages: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, "grp"):
            for lo in range(0, len(t), most_pages):
                part = t.slice(lo, most_pages)
                texts = unique_runs(part.column("blocks").to_pylist(), least, part.column("marks").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("uid").combine_chunks(), pa.array(texts, pa.string())], names=["uid", "text"])

    return run


#: What a group of a host's pages says: substrings that stand on FEW of them, (digest null) how many there are, and the pages without an article themselves.
SAID = "host string, digest bigint, pages bigint, open boolean, page_id bigint, url string, blocks array<string>"


def _common(least: int, characters: int):
    def said(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in SAID_ARROW], schema=SAID_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, "grp"):
            open_ = t.filter(pc.invert(t.column("settled"))).combine_chunks()
            if len(open_):
                yield said(len(open_), open=pa.array([True] * len(open_)), **{c: open_.column(c).combine_chunks() for c in ("host", "page_id", "url", "blocks")})
            t = t.filter(pc.and_(t.column("settled"), pc.not_equal(t.column("host"), "")))
            hosts, groups = t.column("host").to_pylist(), t.column("groups").to_pylist()
            lengths = np.cumsum(t.column("size").to_numpy())
            for host in dict.fromkeys(hosts):  # two hosts may share a group's hash
                # equal pages once, before parts are made of them
                rows = list({xxhash.xxh3_128_digest("\n".join(t.column("blocks")[k].as_py())): k for k, h in enumerate(hosts) if h == host}.values())
                if groups[rows[0]] == 1 and len(rows) < PAGES:
                    continue
                parts = np.split(rows, np.flatnonzero(np.diff(lengths[rows] // characters)) + 1)
                for part in parts:
                    digests, on, n = common_substrings(t.column("blocks").take(pa.array(part)).to_pylist(), least, groups[rows[0]] == len(parts) == 1)
                    yield said(len(on) + 1, host=pa.array([host] * (len(on) + 1)), digest=pa.array([None, *digests.tolist()], pa.int64()), pages=pa.array([n, *on.tolist()], pa.int64()))

    return run


SAID_ARROW = pa.schema([("host", pa.string()), ("digest", pa.int64()), ("pages", pa.int64()), ("open", pa.bool_()), ("page_id", pa.int64()), ("url", pa.string()), ("blocks", pa.list_(pa.string()))])


def _applied(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = (None, frozenset())
        for batch in batches:
            texts = []
            for host, blocks, digests in zip(*(batch.column(c).to_pylist() for c in ("host", "blocks", "digests"))):
                if digests and known[0] != host:
                    known = (host, frozenset(digests))
                texts.append(without(blocks, known[1] if digests else frozenset(), least))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


#: The share of a host's pages, and the least number, on which a substring within articles is boilerplate; the share of a group from which it is counted.
SHARE, PAGES, FEW = 0.5, 8, 0.25
#: Characters of a host's pages that one suffix array holds, about.
GROUP_CHARACTERS = 1 << 25


#: Hosts of several groups whose number of groups is broadcast.
MOST_HOSTS = 100_000


def look_at_hosts(parsed: DataFrame, pages: DataFrame, scratch: Scratch, least: int, group_pages: int, characters: int) -> tuple[DataFrame, DataFrame]:
    """(host, digests) of what most of a host's distinct articles hold, and the pages without an article, of rows (page_id, url, blocks, settled, host).

    Each host's pages are dealt at random into groups of about `group_pages`, and
    each group has its suffix array, or several if its pages are large. What stands
    on SHARE of all of a host's pages is counted in each (`few`), so the counts add
    up to the host's. Equal pages are one page, always in
    one group. The texts are shuffled once, to their groups. `pages` has a row
    (host) for each page, which is cheaper to count; only hosts of more than one
    group are joined, by broadcast where they are MOST_HOSTS at most.
    """
    large = scratch.store(pages.groupBy("host").agg(F.ceil(F.count("*") / group_pages).cast("int").alias("groups")).where("groups > 1"), "large")
    met = parsed.join(F.broadcast(large) if large.count() <= MOST_HOSTS else large, "host", "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    size = F.aggregate("blocks", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x) + 1)
    dealt = met.where("not settled or size(blocks) > 0").select("page_id", "url", "host", "blocks", "settled", "groups", size.alias("size"), F.xxhash64("host", F.pmod(F.xxhash64("blocks"), "groups")).alias("grp"))
    said = scratch.store(dealt.repartition("grp").sortWithinPartitions("grp", "host").mapInArrow(_common(least, characters), SAID), "said")
    summed = said.where("open is null").groupBy("host", "digest").agg(F.sum("pages").alias("pages"))
    of = Window.partitionBy("host")
    many = summed.withColumn("all", F.max(F.when(F.col("digest").isNull(), F.col("pages"))).over(of)).where(F.col("digest").isNotNull() & (F.col("pages") >= PAGES) & (F.col("pages") >= SHARE * F.col("all")))
    return many.groupBy("host").agg(F.collect_list("digest").alias("digests")), said.where("open").select("page_id", "url", "blocks", "host")


def main_text(pages: DataFrame, least: int = 12, group_pages: int = 256, group_characters: int = GROUP_CHARACTERS, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: (page_id, url, text, n_chars).

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts and
    comments that name themselves are left out first; what is left of an article
    (else main) element is the page's words, else all that is left of the page.
    The words of a host's pages are then laid end to end and a suffix array finds
    substrings of `least` words (or ends of blocks) on distinct pages; what it
    covers goes, and the other words are the text.

    Within articles a substring counts as boilerplate if it stands on half of a
    host's pages and on eight at least (`look_at_hosts`), for articles may share
    passages, all of which is kept otherwise. On pages without an article, what two
    pages share is boilerplate. A host with more than `group_pages` pages has an
    array for each group of about so many; what its pages share is found over all
    of the host.

    Pages of a host with the same blocks are one page to this, at however many
    addresses, and have the same text. Pages without an article that are nearly the
    same are distinct, so they lose what they share.

    Null and empty pages have an empty text; pages without a host form one of their
    own, of which nothing is boilerplate within articles. Null ids and
    repeated rows stay. Other columns are ignored.
    """
    spark = pages.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "extract")
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col).select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    parsed = rows.mapInArrow(_parse, PARSED).withColumn("host", host_of(F.col("url")))  # cheaper to do again than to store
    found, open_ = look_at_hosts(parsed, rows.select(host_of(F.col("url")).alias("host")), scratch, least, group_pages, group_characters)
    found = scratch.store(found, "boilerplate")
    done = parsed.where("settled").join(found, "host", "left").select("page_id", "url", "host", "blocks", "digests").mapInArrow(_applied(least), "page_id bigint, url string, text string")
    if not open_.isEmpty():
        uid = F.sha2(F.concat(F.sha2("host", 256), F.array_join("blocks", "\n")), 256)  # of host and blocks; blocks have no line ends
        open_ = scratch.store(open_.withColumn("uid", uid), "open")
        own = scratch.store(open_.select("host", "uid", "blocks").dropDuplicates(["uid"]), "own")
        large = own.groupBy("host").agg(F.ceil(F.count("*") / group_pages).alias("groups")).where("groups > 1")
        salt = F.pmod(F.xxhash64("uid"), F.coalesce("groups", F.lit(1)))
        known = scratch.store(own.join(large, "host").select("host", "uid", "blocks").mapInArrow(_substrings(least), SUBSTRINGS), "substrings")
        shared = known.groupBy("host", "digest").agg(F.min("uid").alias("low"), F.max("uid").alias("high")).where("low != high").select("host", "digest")
        marks = known.join(shared, ["host", "digest"]).groupBy("uid").agg(F.collect_list("at").alias("marks"))
        grouped = own.join(large, "host", "left").join(marks, "uid", "left").select("uid", "blocks", "marks", F.xxhash64("host", salt).alias("grp"))
        settled = grouped.repartition("grp").sortWithinPartitions("grp").mapInArrow(_settle(least, 2 * group_pages), TEXTS)
        done = done.union(open_.join(settled, "uid").select("page_id", "url", "text"))
    return done.withColumn("n_chars", F.length("text").cast("bigint"))
