"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of block tags and text. For every element, by its path of tags and classes, the streams of its
children on all pages of the host are aligned one after another: what both have stays, what only one has becomes
optional, and what comes again becomes a repeated group. The nested expressions of all paths are the host's wrapper,
and their text slots are the fields of its pages. Slots that hold the same text on all pages, stand in navigation,
notices, adverts, forms or comments, or are mostly links are template; the others of the main region are the article.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm.common import saved, small_batches, table

#: Elements whose text is never shown as text.
RAW = "script|style|noscript|template|iframe|object|svg|canvas|title|textarea|select|audio|video"
#: Elements that begin and end blocks.
BLOCKS = frozenset("html body head div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption article section main nav header footer aside form fieldset blockquote pre figure figcaption address hr details summary dialog menu center button label option".split())
VOID = frozenset("hr br img input meta link wbr base col embed source track area".split())
#: An open element that the start of another ends.
ENDED_BY = {"p": BLOCKS - {"html", "body", "head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}}
#: Elements, and words in classes, ids and roles, that mark what is not the article.
ASIDE_TAGS = frozenset("nav footer aside form menu dialog button label head fieldset".split())
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement banner cookie cookies consent notice notices menu nav navbar navigation breadcrumb breadcrumbs sidebar widget footer masthead comment comments reply replies respond disqus promo sponsor sponsored related share sharing social newsletter subscribe popup modal login signup search pagination copyright hidden gdpr contentinfo complementary".split())
#: Words that say nothing in a name beside one that marks: "share-box" is aside, "share-price" is not.
NEUTRAL_WORDS = frozenset("a the top bottom left right first last main site page list lists item items box bar block blocks link links wrap wrapper container section area inner outer form panel panels btn button buttons icon icons content open closed text title header head post posts article articles story stories more tools unit slot count counts thread body".split())
#: Elements whose text names what follows: it may be the same on every page of a host.
NAMING_TAGS = frozenset("h1 h2 h3 h4 h5 h6 th dt caption figcaption summary".split())
MAIN_TAGS, MAIN_WORDS = ("article", "main"), frozenset("article content main post entry story".split())
#: Paths are written out down to this depth; deeper ones end in a hash of the rest and its elements that mark something.
DEPTH = 24

_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+(?:/>|>.*?(?:</\1\s*>|\Z))|<([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|</([a-zA-Z][^\s>]*)[^>]*>|<[!?/][^>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_MARKED = re.compile("|".join(sorted(ASIDE_WORDS - {"ad"}, key=len, reverse=True)) + r"|\bad\b|[-_]ad|ad[-_]", re.I)
_NAME = re.compile(r"[a-z]+(?=[A-Z]|[^A-Za-z]|\Z)|[A-Z][a-z]*")


def signature(tag: str, attributes: str) -> str:
    """A tag with the words of its class, id and role that hold no long number; `hidden` if it is not shown."""
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return tag
    names = set()
    for key, *values in _ATTRIBUTE.findall(attributes):
        value, key = "".join(values), key.lower()
        if key == "style":
            names |= {"hidden"} if re.search(r"display\s*:\s*none", value, re.I) else set()
        elif key == "hidden" or key == "aria-hidden":
            names |= {"hidden"} if value.lower() != "false" else set()
        else:
            names |= {w for w in re.split(r"[^\w-]+", value) if w and not re.search(r"\d{3}", w)}
    return ".".join([tag, *sorted(names)])


def words_of(sig: str) -> set[str]:
    return {w.lower() for name in sig.split(".")[1:] for w in _NAME.findall(name)}


@functools.lru_cache(maxsize=4096)
def aside_words(sig: str) -> bool:
    """Whether one of an element's names marks it as no article: a name of marking and neutral words alone."""
    for name in sig.split(".")[1:]:
        words = {w.lower() for w in _NAME.findall(name)}
        if words & ASIDE_WORDS and words <= ASIDE_WORDS | NEUTRAL_WORDS:
            return True
    return False


def marks(sig: str) -> bool:
    """Whether an element says that its text is the article, or is not."""
    return sig.split(".")[0] in {*MAIN_TAGS, *ASIDE_TAGS, "header"} or bool(words_of(sig) & (ASIDE_WORDS | MAIN_WORDS | {"header"}))


def deeper(tail: tuple[str, str, tuple[str, ...]], sig: str) -> tuple[str, str, tuple[str, ...]]:
    """The written part of a path, a hash of the rest, and the rest's marking elements, one step on."""
    head, digest, kept = tail
    return head, xxhash.xxh3_64_hexdigest(f"{digest}/{sig}"), (*kept, sig) if sig not in kept and marks(sig) else kept


class Page:
    """A page's blocks of text, each with its path, and its elements' children in order."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, str, int]] = []  # path, text, characters in links
        self.children: list[tuple[str, list[str]]] = []
        stack: list[tuple] = [("", "", [], None)]  # tag, path, children, and what deeper() made of a path that is not written out
        self.children.append(("", stack[0][2]))
        text: list[str] = []
        links, in_link, at = 0, 0, 0
        opened_now: Counter[str] = Counter()
        skipped, depth = "", 0  # an inline element that is no article, and how many of its kind are open; it ends with its block

        def flush() -> None:
            nonlocal links
            words = " ".join("".join(text).split())
            text.clear()
            if words:
                self.blocks.append((stack[-1][1], words, min(links, len(words))))
                stack[-1][2].append("#")
            links = 0

        for m in _TOKEN.finditer(source):
            if m.start() > at:
                run = source[at : m.start()]
                if not skipped:
                    text.append(entities.unescape(run) if "&" in run else run)
                    links += len(run) if in_link else 0
            at = m.end()
            opened, attributes, closed = m.group(2), m.group(3), m.group(4)
            if opened:
                tag = opened.lower()
                named = tag not in BLOCKS and "=" in attributes and _MARKED.search(attributes) and aside_words(signature(tag, attributes))
                if tag in BLOCKS or named and "-" in tag:  # an element of the page's own, marked, may hold blocks
                    flush()
                    skipped = ""
                    while len(stack) > 1 and tag in ENDED_BY.get(stack[-1][0], ()):
                        opened_now[stack.pop()[0]] -= 1
                    sig = signature(tag, attributes)
                    stack[-1][2].append(sig)
                    if tag not in VOID and not attributes.endswith("/"):
                        path, tail = f"{stack[-1][1]}/{sig}", None
                        if len(stack) > DEPTH:
                            tail = deeper(stack[-1][3] or (stack[-1][1], "", ()), sig)
                            path = "/".join([tail[0], f"~{tail[1]}", *tail[2]])
                        stack.append((tag, path, [], tail))
                        opened_now[tag] += 1
                        self.children.append((path, stack[-1][2]))
                elif skipped:
                    depth += tag == skipped and not attributes.endswith("/")
                elif named and tag not in VOID and not attributes.endswith("/"):
                    skipped, depth = tag, 1
                elif tag == "br":
                    text.append(" ")
                elif tag == "a":
                    in_link = 1
            elif closed:
                tag = closed.lower()
                if tag in BLOCKS or opened_now[tag]:
                    flush()
                    skipped = ""
                    if opened_now[tag]:
                        while (last := stack.pop()[0]) != tag:
                            opened_now[last] -= 1
                        opened_now[tag] -= 1
                elif skipped:
                    depth -= tag == skipped
                    skipped = skipped if depth else ""
                elif tag == "a":
                    in_link = 0
            elif not skipped:
                text.append(" " if m.group(1) else "")
        if at < len(source) and not skipped:
            run = source[at:]
            text.append(entities.unescape(run))
        flush()


def fold(items: list[str]) -> list[str]:
    """A sequence with each run of a repeated group, of up to four, written once with a plus."""
    for n in (1, 2, 3, 4):
        out: list[str] = []
        i = 0
        while i < len(items):
            group, j = items[i : i + n], i + n
            while len(group) == n and items[j : j + n] == group:
                j += n
            if j > i + n or n == 1 and out and out[-1] == f"{items[i].rstrip('+')}+" and items[i].rstrip("+") + "+" == out[-1]:
                again = group[0].rstrip("+") + "+" if n == 1 else "(" + " ".join(group) + ")+"
                if not (out and out[-1] == again):
                    out.append(again)
                i = j
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def align(a: list[str], b: list[str]) -> list[str]:
    """The least union-free expression found that has both: common items stay, others become optional."""
    bare = lambda items: [x.rstrip("+?") for x in items]
    out: list[str] = []
    for kind, i, j, k, m in SequenceMatcher(None, bare(a), bare(b), autojunk=False).get_opcodes():
        if kind == "equal":
            for x, y in zip(a[i:j], b[k:m], strict=True):
                marks = ("+" if "+" in x[len(x.rstrip("+?")) :] + y[len(y.rstrip("+?")) :] else "") + ("?" if x.endswith("?") or y.endswith("?") else "")
                out.append(x.rstrip("+?") + marks)
        else:
            out += [x.rstrip("?") + "?" for x in [*a[i:j], *b[k:m]]]
    merged: list[str] = []
    for x in out:
        if merged and merged[-1].rstrip("+?") == x.rstrip("+?"):
            both = merged.pop()
            x = x.rstrip("+?") + "+" + ("?" if x.endswith("?") and both.endswith("?") else "")
        merged.append(x)
    return merged


def items_of(expression: str) -> list[str]:
    """The top-level items of an expression."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(f"{expression} "):
        depth += (c == "(") - (c == ")")
        if c == " " and depth == 0:
            if i > start:
                out.append(expression[start:i])
            start = i + 1
    return out


SLOTS = "host string, path string, model string, pages long, chars long, links long, low long, high long"
_FIELDS = pa.schema([("host", pa.string()), ("path", pa.string()), ("model", pa.string()), *((c, pa.int64()) for c in ("pages", "chars", "links", "low", "high"))])
_NONE_LOW, _NONE_HIGH = (1 << 63) - 1, -(1 << 63)


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each path's folded children and what its text was, summed over a task's pages of a host."""
    held: dict[tuple[str, str, str], list[int]] = {}

    def sent() -> pa.RecordBatch:
        rows = [(*k, *v) for k, v in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=_FIELDS)

    for batch in small_batches(batches, "html"):
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = Page(source or "")
            texts: dict[str, list[int]] = {}
            for path, text, links in page.blocks:
                t = texts.setdefault(path, [0, 0, _NONE_LOW, _NONE_HIGH])
                h = xxhash.xxh3_64_intdigest(text) - (1 << 63)
                t[0], t[1], t[2], t[3] = t[0] + len(text), t[1] + links, min(t[2], h), max(t[3], h)
            for path, items in page.children:
                # An element that comes again on a page adds another model; its text is counted once.
                chars, links, low, high = texts.pop(path, (0, 0, _NONE_LOW, _NONE_HIGH))
                v = held.setdefault((host, path, " ".join(fold(items))), [0, 0, 0, _NONE_LOW, _NONE_HIGH])
                v[0], v[1], v[2], v[3], v[4] = v[0] + 1, v[1] + chars, v[2] + links, min(v[3], low), max(v[4], high)
        if len(held) > 50_000:
            yield sent()
    if held:
        yield sent()


def _merge_models(group: pa.Table) -> pa.Table:
    """One row for a path: its models aligned, the most frequent first."""
    rows = sorted(group.to_pylist(), key=lambda r: (-r["pages"], r["model"]))
    model: list[str] = items_of(rows[0]["model"])
    for r in rows[1:]:
        model = align(model, items_of(r["model"]))
    total = {c: sum(r[c] for r in rows) for c in ("pages", "chars", "links")}
    return pa.Table.from_pylist([{"host": rows[0]["host"], "path": rows[0]["path"], "model": " ".join(model), **total, "low": min(r["low"] for r in rows), "high": max(r["high"] for r in rows)}], schema=_FIELDS)


def learn_wrappers(pages: DataFrame) -> DataFrame:
    """Wrappers of pages(host, html): a row for each path of a host, with its model and what its text was.

    All pages count. Equal models are summed in each task and again by Spark, so a host with a third of all pages
    sends its distinct models only; those of a path are aligned in eight parts, and then these.
    """
    seen = pages.select("host", "html").mapInArrow(_observe, SLOTS)
    sums = [F.sum(c).alias(c) for c in ("pages", "chars", "links")]
    seen = seen.groupBy("host", "path", "model").agg(*sums, F.min("low").alias("low"), F.max("high").alias("high"))
    parts = seen.withColumn("_part", F.pmod(F.xxhash64("model"), F.lit(8))).groupBy("host", "path", "_part").applyInArrow(lambda t: _merge_models(t), SLOTS)
    return parts.groupBy("host", "path").applyInArrow(lambda t: _merge_models(t), SLOTS)


def main_levels(slots: list[dict]) -> list[list[str]]:
    """Text slots of a wrapper that are the article, best first; a page takes the first level of which it has text.

    html and body never mark what is aside. First every other element may; then words in classes count only below an
    article or main element, or where an element holds less than half of the text.
    """
    texts = [s for s in slots if s["chars"] > 0]
    held: dict[str, int] = {}
    for s in texts:
        parts = s["path"].split("/")
        for i in range(2, len(parts) + 1):
            held["/".join(parts[:i])] = held.get("/".join(parts[:i]), 0) + s["chars"]
    half = sum(s["chars"] for s in texts) / 2

    def aside(path: str, strict: bool) -> bool:
        parts, inside = path.split("/"), False
        last = max((i for i, x in enumerate(parts) if x.split(".")[0] in MAIN_TAGS), default=0)
        for i, sig in enumerate(parts[1:], 1):
            tag, words = sig.split(".")[0], words_of(sig)
            if tag not in ("html", "body"):
                judged = strict or (i > last if last else held["/".join(parts[: i + 1])] < half)
                if tag in ASIDE_TAGS or judged and (aside_words(sig) or (tag == "header" or "header" in words) and not inside):
                    return True
            inside = inside or tag in MAIN_TAGS
        return False

    def constant(s: dict) -> bool:
        return s["pages"] >= 3 and s["low"] == s["high"]

    pages = next((s["pages"] for s in slots if s["path"] == ""), 0)

    def filled(rest: list[dict]) -> list[dict]:
        """Those slots that are not the same on every page of the host, and headings; all, if the pages are copies of one."""
        names = lambda s: s["path"].rpartition("/")[2].split(".")[0] in NAMING_TAGS
        kept = [s for s in rest if names(s) or not (pages >= 3 and s["pages"] >= pages and s["low"] == s["high"])]
        return kept if any(not names(s) for s in kept) else rest

    def within(s: dict, tag: str) -> bool:
        return any(x.split(".")[0] == tag for x in s["path"].split("/"))

    def region(rest: list[dict]) -> list[str]:
        varied = [s for s in rest if not constant(s)] or rest
        varied = [s for s in varied if 2 * s["links"] < s["chars"]] or varied
        if marked := [s for s in varied if any(words_of(x) & MAIN_WORDS for x in s["path"].split("/"))]:
            return [s["path"] for s in marked]
        if not varied:
            return []
        largest = max(varied, key=lambda s: (s["chars"] - s["links"], s["path"]))
        top = largest["path"].rpartition("/")[0]
        return [s["path"] for s in varied if s["path"] == top or s["path"].startswith(f"{top}/")]

    rests = [[s for s in texts if not aside(s["path"], strict)] for strict in (True, False)]
    levels = [[s["path"] for s in filled([s for s in rest if within(s, tag)])] for rest in rests for tag in MAIN_TAGS]
    outside = [[s for s in rest if not any(within(s, tag) for tag in MAIN_TAGS)] for rest in rests]
    levels += [region(rest) for rest in outside]
    # A page of a rarer template has nothing of the largest region.
    levels += [[s["path"] for s in rest if not constant(s) and 2 * s["links"] < s["chars"]] for rest in outside]
    return [sorted(x) for x in levels if x]


def main_paths(slots: list[dict]) -> list[str]:
    """Which text slots of a wrapper are the article, on the pages that have them."""
    return next(iter(main_levels(slots)), [])


def _choose(group: pa.Table) -> pa.Table:
    rows = group.to_pylist()
    return pa.table({"host": pa.array([rows[0]["host"]], pa.string()), "main": pa.array([main_levels(rows)], pa.list_(pa.list_(pa.string())))})


def _extract(columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            out = []
            for source, main in zip(batch.column("html").to_pylist(), batch.column("main").to_pylist(), strict=True):
                blocks = Page(source or "").blocks
                found = {path for path, _, _ in blocks}
                chosen = next((c for c in map(set, main or ()) if c & found), set())
                out.append("\n".join(text for path, text, _ in blocks if path in chosen))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], [*columns, "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages(page_id, url, html).

    A null or empty html has no text; a null url is a host of its own; a host with one page has a wrapper of that
    page; repeated rows stay; other columns are ignored; an empty table gives no rows. Whole pages are read.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    wrappers = learn_wrappers(rows).groupBy("host").applyInArrow(lambda t: _choose(t), "host string, main array<array<string>>")
    # Spark broadcasts the wrappers if their files are small, and else splits a host with very many pages.
    joined = rows.join(saved(wrappers, "wrappers"), "host", "left")
    return joined.mapInArrow(_extract(["page_id", "url"]), "page_id long, url string, text string, n_chars long")


def op3_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
