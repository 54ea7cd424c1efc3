"""Main text of web pages: page structure, and a host suffix array for what structure leaves open.

A page becomes blocks of text, each with a verdict of the markup: inside the article,
inside something else (menus, footers, adverts, forms, comments and so on), or open.
Open blocks are those of pages without an article element, and blocks of an article
that stand in plain containers instead of paragraphs. The open blocks of a page are
its token stream. For each host, the suffixes of the streams are sorted, cut to
`LONG` tokens; suffixes that share their first LONG tokens are neighbours. A substring
that stands in at least `LEAST` different streams and `SHARE` of the host's different
streams is boilerplate; passages that a few pages share stay. Identical streams count
once, and a stream that would lose more than `MOSTLY` of its tokens is a near copy of
others and stays whole, so mirrored pages keep their text.

Sorting is split: each Arrow batch sorts its own different streams by host and gives one
row for each run, with its number of streams; runs of one substring meet in a partial
aggregate, so neither a large host nor a common passage gathers in one task.
"""
from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pitscreen.llm import textnum
from pitscreen.llm.common import as_long, stored

LONG = 8
LEAST, SHARE, MOSTLY = 3, 0.5, 0.8
SALTS = 16                  # parts of a host's substrings when they meet its number of streams
ARTICLE, OPEN = 1, 2
TEASER = 3                  # how many times the text of the articles paragraphs beside them must hold to count as well

# Element names of the HTML standard by their role, and usual words in class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style template noscript iframe textarea title select".split()
CHROME = frozenset("nav footer aside form menu dialog button fieldset figcaption".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt".split())
BLOCK = PROSE | CHROME | frozenset("address article body center details div dl figure head header hgroup hr html main ol search section summary table tbody tfoot thead tr ul".split())
CHROME_WORDS = frozenset("""
    ad ads advert advertisement adverts adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs
    footer sidebar aside widget cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login
    share sharing social related recommended comment comments reply replies respond disqus pagination pager toolbar search complementary contentinfo
    dialog form skip print
""".split())
# Pieces that do not change what a name says ("comment-list"), and words that as an id inside an article name no topic of it.
NEUTRAL = frozenset("area bar block body bottom box btn button buttons container content footer header icons inner item items left link links list main menu outer page panel post posts right row section site slot top unit wrap wrapper".split())
FURNITURE = frozenset("adsense adverts advertisement breadcrumb breadcrumbs comments disqus navbar newsletter pager pagination respond sidebar".split())
PLAIN = frozenset("div section form".split())
HEADER_WORDS = frozenset(["header", "masthead", "topbar", "page-header", "site-header"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
STOP = re.compile(r"[>\"']")
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"""(?:^|[\s/])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=]|\Z)|aria-hidden\s*=\s*["']?true|display:\s*none""", re.I)
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
WHITE = re.compile(r"\s+")


def _names_chrome(name: str) -> bool:
    """Whether a whole class, id or role token says chrome: one of its pieces does and the others are neutral."""
    pieces = [p for p in re.split(r"[^a-z0-9]+", name) if p and not p.isdigit()]
    return not CHROME_WORDS.isdisjoint(pieces) and all(p in CHROME_WORDS or p in NEUTRAL for p in pieces)


def _is_chrome(tag: str, attrs: str, in_article: bool) -> bool:
    """Whether an element is no part of the text. Inside an article the name of a paragraph, a cell or an inline element
    (a link, a span) says nothing unless it can only mean something else; being hidden always counts."""
    if tag in CHROME:
        return tag != "figcaption" or not in_article
    if not attrs or tag in ("html", "body", "main", "article"):
        return False
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if in_article and name == "id":      # an anchor of the text, unless it can only mean something else
            if tag not in PROSE and value in FURNITURE:
                return True
        elif in_article and (tag in PROSE or tag not in BLOCK):
            if name in ("class", "role") and not FURNITURE.isdisjoint(value.split()):
                return True
        elif name in ("class", "id", "role") and any(map(_names_chrome, value.split())):
            return True
    return False


def _is_header(tag: str, attrs: str) -> bool:
    """A header element, or a plain container that one of its class, id or role tokens, taken whole, calls a header."""
    return tag == "header" or tag in PLAIN and any(n.lower() in ("class", "id", "role") and not HEADER_WORDS.isdisjoint(v.strip("\"'").lower().split()) for n, v in ATTRIBUTE.findall(attrs or ""))


def _end_of_tag(page: str, at: int) -> int:
    """The place of the > that ends a tag, outside quoted values; -1 if a quote or the tag never ends."""
    while found := STOP.search(page, at):
        if found[0] == ">":
            return found.start()
        at = page.find(found[0], found.end()) + 1
        if not at:
            return -1
    return -1


def pieces(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, tag name, is an end tag, attributes) of all markup, in page order; comments, declarations and raw
    elements with their content have no name.

    The scanner only moves forward. Once a tag or a quote in it never ends, quotes mean nothing in the rest of the page,
    where a tag ends at the next >; so broken markup of any length costs one pass. A last tag without a > is text.
    """
    at, quotes = 0, True
    while (low := page.find("<", at)) >= 0:
        if page.startswith("<!--", low):
            high = page.find("-->", low + 4)
            at = len(page) if high < 0 else high + 3
            yield low, at, "", False, ""
            continue
        name = NAME.match(page, low + 1)
        if not name and page[low + 1:low + 2] not in ("!", "?"):
            at = low + 1
            continue
        begin = name.end() if name else low + 1
        high = _end_of_tag(page, begin) if quotes and name else page.find(">", begin)
        if high < 0 and quotes and name:
            quotes, high = False, page.find(">", begin)
        if high < 0:
            return
        at = high + 1
        tag, ends = (name[2].lower(), bool(name[1])) if name else ("", False)
        if tag in RAW_END:
            close = None if ends else RAW_END[tag].search(page, at)
            at = at if ends else close.end() if close else len(page)
            tag = ""
        yield low, at, tag, ends, page[begin:high]


def page_blocks(page: str) -> list[tuple[str, int]]:
    """(text, ARTICLE or OPEN) of the blocks that the markup does not rule out, in page order.

    Character references are decoded, white space inside a block (line breaks too) is one space. If
    the page has an article (or else a main) element, only what stands in it comes back, unless paragraphs outside hold more
    than TEASER times its text. A div, section or form
    around an article or main that its name calls chrome does not rule it out; if the page has no other article or
    main, that one comes back with what the markup leaves open. A page whose only text stands in forms is that text.
    """
    stack: list[tuple[str, str]] = []   # element, what it starts ("chrome", "header", "article", "main" or nothing)
    depth = {"chrome": 0, "header": 0, "article": 0, "main": 0, "plain": 0, "form": 0}
    outside = [0]                       # chrome of plain wrappers around the page and around each open article or main
    blocks: list[tuple[str, bool, bool, bool]] = []
    in_forms: list[tuple[str, int]] = []
    parts: list[str] = []

    def close_block() -> None:
        if parts:
            text = WHITE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                inner = next((t for t, _ in reversed(stack) if t in BLOCK), "")
                wraps = depth["plain"] + depth["form"]
                if wraps > outside[-1]:
                    in_forms.append((text, OPEN))
                else:
                    blocks.append((text, (depth["article"] > 0) * (1 + (wraps > 0)), depth["main"] > 0, inner in PROSE))

    def pop_to(index: int) -> None:
        for _, role in stack[index:]:
            if role:
                depth[role] -= 1
            if role in ("article", "main"):
                outside.pop()
        del stack[index:]

    def text_at(low: int, high: int) -> None:
        wraps = depth["plain"] + depth["form"]
        hidden = depth["chrome"] or wraps > outside[-1] and (depth["plain"] or len(outside) > 1)
        if low < high and not hidden and not (depth["header"] and not any(t in HEADINGS for t, _ in stack) or depth["header"] and not depth["article"]):
            parts.append(page[low:high])

    at = 0
    for low, high, tag, ends, attrs in pieces(page):
        text_at(at, low)
        at = high
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            close_block()
        if ends:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
            continue
        if tag in BLOCK:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or stack[i][0] == tag == "li":
                    pop_to(i)
                    break
                if stack[i][0] in BLOCK:
                    break
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        role = ""
        if _is_chrome(tag, attrs, depth["article"] > 0):
            role = "chrome"
            if tag in PLAIN and not depth["article"] and not HIDDEN.search(attrs):
                role = "form" if tag == "form" else "plain"
        elif tag == "article" and depth["plain"] and any(n.lower() == "class" and any(map(_names_chrome, v.strip("\"'").lower().split())) for n, v in ATTRIBUTE.findall(attrs)):
            role = "chrome"             # a reader's comment, a related card
        elif _is_header(tag, attrs):
            role = "header"
        elif tag in ("article", "main"):
            role = tag
        stack.append((tag, role))
        if role in ("article", "main"):
            outside.append(depth["plain"] + depth["form"])
        if role:
            depth[role] += 1
    text_at(at, len(page))
    close_block()
    inside = sum(len(b[0]) for b in blocks if b[1] == 1)
    beside = sum(len(b[0]) for b in blocks if b[1] != 1 and b[3])
    if inside and TEASER * inside >= beside:      # else the article is a teaser beside the page's own prose
        kept = [b for b in blocks if b[1] == 1]
    elif any(b[2] for b in blocks):
        kept = [b for b in blocks if b[2]]
    else:
        kept = blocks
    return [(b[0], ARTICLE if b[3] and (b[1] or b[2]) else OPEN) for b in kept] or in_forms


def _streams(blocks: list[tuple[str, int]]) -> np.ndarray:
    """Token hashes of a page's open blocks."""
    data = "\n".join(t for t, kind in blocks if kind == OPEN).encode()
    return textnum.words(np.frombuffer(data, np.uint8), np.array([0, len(data)])).hash


def window_hashes(tokens: np.ndarray, long: int = LONG) -> np.ndarray:
    """A hash of the `long` tokens from each position on: what the cut suffixes are sorted by."""
    count = max(0, len(tokens) - long + 1)
    out = np.zeros(count, np.uint64)
    for j in range(long):
        out = (out + tokens[j:j + count]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return textnum.mix(out)


def suffix_runs(streams: list[np.ndarray], ids: list[int], long: int = LONG) -> list[tuple[int, int]]:
    """(substring hash, number of streams) of each run of neighbours in the sorted cut suffixes of one host's streams."""
    keys = [window_hashes(s, long) for s in streams]
    key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    owner = np.repeat(np.array(ids, np.int64), [len(k) for k in keys])
    order = np.lexsort((owner, key))     # the suffix array, cut to `long` tokens
    key, owner = key[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]) if len(key) else np.zeros(0, bool)
    return list(zip(key[first].astype(np.int64).tolist(), np.add.reduceat(new.astype(np.int64), first).tolist())) if len(key) else []


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, kinds, streams = [], [], []
        for page in batch.column(3).to_pylist():
            blocks = page_blocks(page or "")
            texts.append([t for t, _ in blocks])
            kinds.append([k for _, k in blocks])
            streams.append(_streams(blocks).astype(np.int64) if any(k == OPEN for _, k in blocks) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(texts, pa.list_(pa.string())), pa.array(kinds, pa.list_(pa.int32())), pa.array(streams, pa.list_(pa.int64()))],
                                         names=["page_id", "url", "host", "blocks", "kinds", "stream"])


def _sort_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_host: dict[str, tuple[list, list]] = {}
        for host, stream_id, stream in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            streams, ids = by_host.setdefault(host, ([], []))
            streams.append(stream.values.to_numpy().astype(np.uint64)), ids.append(stream_id)
        for host, (streams, ids) in by_host.items():
            runs = suffix_runs(streams, ids)
            if runs:
                key, count = zip(*runs)
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(runs), pa.string()), pa.array(key, pa.int64()), pa.array(count, pa.int64())], names=["host", "key", "streams"])


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for host, stream_id, stream in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            keys = window_hashes(stream.values.to_numpy().astype(np.uint64)).astype(np.int64)
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(keys), pa.string()), pa.array([stream_id] * len(keys), pa.int64()), pa.array(range(len(keys)), pa.int32()), pa.array(keys)], names=["host", "stream_id", "at", "key"])


def _without(text: str, words: list[str], covered: list[bool]) -> str:
    """A block without its covered runs: runs of LONG words, and a block that is covered whole. What a repeated
    substring only brushes, because it began in the block before, stays."""
    if all(covered):
        return ""
    left = []
    for is_covered, run in groupby(range(len(words)), key=covered.__getitem__):
        run = list(run)
        if not is_covered or len(run) < LONG:
            left += [words[i] for i in run]
    return text if len(left) == len(words) else " ".join(left)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for blocks, kinds, covered in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4)]):
            drop = {at + j for at in covered or () for j in range(LONG)}
            if drop and len(drop) > MOSTLY * sum(len(TOKEN.findall(t)) for t, kind in zip(blocks, kinds) if kind == OPEN):
                drop = set()
            token, kept = 0, []
            for text, kind in zip(blocks, kinds):
                if kind == OPEN and drop:
                    words = TOKEN.findall(text)
                    text = _without(text, words, [token + i in drop for i in range(len(words))])
                    token += len(words)
                if text:
                    kept.append(text)
            out.append("\n".join(kept))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of `pages` (page_id, url, html, any other columns).

    A null html is empty and gives an empty text; every row comes back, also a repeated one or one with
    a null id. Long pages are read whole, in one forward pass. Pages with a null url share one host. An empty table gives an empty result.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    parsed = stored(pages.select(as_long("page_id").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))
                    .mapInArrow(_parse, "page_id long, url string, host string, blocks array<string>, kinds array<int>, stream array<long>")
                    .withColumn("stream_id", F.when(F.col("stream").isNotNull(), F.xxhash64("stream"))), "pages")
    streams = parsed.filter("stream_id is not null").select("host", "stream_id", "stream")
    seen = streams.groupBy("host", "stream_id").agg(F.first("stream").alias("stream"))
    hosts = seen.groupBy("host").agg(F.count(F.lit(1)).alias("of")).filter(F.col("of") >= LEAST).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    repeated = (seen.mapInArrow(_sort_suffixes, "host string, key long, streams long").groupBy("host", "key").agg(F.sum("streams").alias("streams")).filter(F.col("streams") >= LEAST)
                .withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(hosts, ["host", "salt"]).filter(F.col("streams") >= SHARE * F.col("of")).select("host", "key"))
    covered = (seen.mapInArrow(_positions, "host string, stream_id long, at int, key long").join(repeated, ["host", "key"])
               .groupBy("host", "stream_id").agg(F.sort_array(F.collect_list("at")).alias("covered")))  # at most a page's tokens
    columns = ["page_id", "url", "blocks", "kinds", "covered"]
    cut = parsed.filter("stream_id is not null").join(covered, ["host", "stream_id"], "left").select(columns)
    settled = parsed.filter("stream_id is null").withColumn("covered", F.lit(None).cast("array<int>")).select(columns)
    return settled.unionByName(cut).mapInArrow(_finish, "page_id long, url string, text string, n_chars long")
