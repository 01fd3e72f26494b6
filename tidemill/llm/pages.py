"""Main text of web pages: nearest-URL page differencing, and structure as the check on it."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import bounded_batches, cut, session, table

#: Elements whose content is never text, elements that hold no main text, and elements
#: that begin and end a block of text.
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "textarea", "select", "title", "xmp")
ASIDE = ("head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "label", "fieldset")
MAIN = ("article", "main")
BLOCKS = (
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul"
).split()
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: Words of a class, id or role that mark what is not main text.
HINTS = (
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar nav navbar navigation menu menubar breadcrumb "
    "breadcrumbs footer header masthead comment comments reply replies respond disqus cookie cookies consent gdpr notice notices newsletter subscribe signup "
    "popup modal overlay share sharing social related recommended recommendations widget toolbar pagination pager search complementary contentinfo"
).split()
_BLOCKS, _VOID, _ASIDE, _MAIN, _HINTS = map(frozenset, (BLOCKS, VOID, ASIDE, MAIN, HINTS))
#: A block of one of these ends where another block begins, whether it is closed or not.
_LIGHT = frozenset(("p", "li", "dt", "dd", "tr", "td", "th", "option", "h1", "h2", "h3", "h4", "h5", "h6"))

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*+>.*?(?:</(?P=raw)\s*+[^>]*+>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)|<[!?][^>]*+(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PART = re.compile(r"[a-z]+")
_NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: Parts of a class or id that say where or how, beside one of the words above: "site-header", "comment-list".
NEUTRAL = (
    "site page main global top bottom left right list box container wrapper wrap block section area inner outer bar body content item items link links "
    "post posts article articles story stories form button buttons icon icons group row col column unit slot zone panel title count thread text message "
    "primary secondary mobile desktop sticky fixed js"
).split()
_NEUTRAL = frozenset(NEUTRAL)
#: Asides that stand within a line of text and don't end it.
_INLINE_ASIDE = frozenset(("button", "label"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Ids that name what readers have written, which stands within an article often.
_COMMENTS = frozenset(("comment", "comments", "reply", "replies", "respond", "disqus"))
#: Blocks that hold text themselves: within an article a class of theirs that is only in part a hint says nothing.
_TEXTUAL = _HEADINGS | frozenset(("p", "blockquote", "pre", "li", "dt", "dd", "td", "th", "figcaption"))
#: Classes of the paragraph under a headline.
_LEAD = re.compile(r"""class\s*=\s*["']?[^"'>]*\b(?:standfirst|lead|lede|dek|deck|summary|subtitle|subheadline|intro)\b""", re.IGNORECASE)
#: A neighbour with this share of a page's characters is a copy of it, in which little was changed.
COPY = 0.8

#: Zones of a line: in the article; in the article, in an element whose class may mean an aside; outside; in an aside.
MAYBE_TEXT, MAIN_TEXT, OPEN_TEXT, OTHER = 3, 2, 1, 0


def _signs(name: str, attrs: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether an element isn't shown, is an aside, and may be one: a hint is part of its class beside words that aren't neutral.

    Inside an article an id is an anchor, not a sign (but for readers' comments), and a paragraph isn't an aside by a part of its class.
    """
    off, maybe = name in _ASIDE, False
    if not attrs or name in ("html", "body"):
        return False, off, False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if (key == "hidden" and value != "false") or (key == "style" and _NO_DISPLAY.search(value)):
            return True, off, False
        if key == "aria-label":
            off = off or value in _HINTS
        elif key in ("class", "role") or (key == "id" and (not inside or value in _COMMENTS)):
            for token in value.split():
                parts = _PART.findall(token)
                hints = [p in _HINTS for p in parts]
                if token in _HINTS or (any(hints) and name not in _MAIN and all(h or p in _NEUTRAL for h, p in zip(hints, parts, strict=True))):
                    off = True
                elif any(hints) and name not in _MAIN and not (inside and name in _TEXTUAL):
                    maybe = True
    return False, off, maybe and not off


def lines(page: str) -> list[tuple[int, str]]:
    """(zone, text) of each block with any text, in page order. References are decoded and white space made single spaces.

    Classes and ids count for blocks only; what isn't shown goes wherever it stands. Of a header within an
    article the headings stay, and paragraphs whose class calls them a standfirst.
    """
    out: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, tuple[int, int, int, int, int]]] = []  # open elements, and the state before each
    aside = main = maybe = head = mute = 0

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((OTHER if aside or head else OPEN_TEXT if not main else MAYBE_TEXT if maybe else MAIN_TEXT, text))
            held.clear()

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at and not mute:
            held.append(page[at : m.start()])
        at = m.end()
        if m["raw"] or not m["name"]:
            continue
        name = m["name"].lower()
        if name == "br":
            held.append(" ")
            continue
        block = name in _BLOCKS
        if block and not mute:
            flush()
        if name in _VOID:
            continue
        if m["close"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if stack[k][1][:4] != (aside, main, maybe, head):
                        flush()
                    aside, main, maybe, head, mute = stack[k][1]
                    del stack[k:]
                    break
            continue
        if block:
            while stack and stack[-1][0] in _LIGHT and (name not in ("p", "div", "ul", "ol", "dl", "table", "blockquote", "pre") or stack[-1][0] in ("p", *_HEADINGS)):
                aside, main, maybe, head, mute = stack.pop()[1]
                if name in ("div", "ul", "ol", "section") and (not stack or stack[-1][0] not in _LIGHT):
                    break
        gone, off, may = _signs(name, m["attrs"] or "", main > 0)
        own = block or "-" in name
        if m["attrs"] and m["attrs"].rstrip().endswith("/") and not block:
            continue
        if not (own or gone or name in _INLINE_ASIDE):
            continue
        before = aside, main, maybe, head, mute
        if (gone and not own) or name in _INLINE_ASIDE:
            mute += 1
        elif main and name == "header":
            flush()
            head += 1
        elif (name in _HEADINGS or (name in _TEXTUAL and _LEAD.search(m["attrs"] or ""))) and head and not (gone or off):
            head = 0  # until it ends
        elif off or gone:
            flush()
            aside += 1
        elif may:
            flush()
            maybe += 1
        main += name in _MAIN
        stack.append((name, before))
    if not mute:
        held.append(page[at:])
    flush()
    return out


def lcs(a: list, b: list) -> list[int]:
    """Places in a of a longest common subsequence of two lists of lines."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    where: dict[object, list[int]] = defaultdict(list)
    for j in range(len(b) - tail - 1, head - 1, -1):
        where[b[j]].append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i in range(head, len(a) - tail):
        for j in where.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    middle, at = [], links[-1] if links else None
    while at:
        middle.append(at[0])
        at = at[1]
    return [*range(head), *reversed(middle), *range(len(a) - tail, len(a))]


def _sorted_out(found: list[tuple[int, str]]) -> tuple[list[int], list[int]]:
    """Which lines stay whatever the neighbour has, and which stay unless it has them, too."""
    sure = [k for k, (z, _) in enumerate(found) if z == MAIN_TEXT]
    return sure, [k for k, (z, _) in enumerate(found) if z == MAYBE_TEXT or (z == OPEN_TEXT and not sure)]


def _shared(own: list, places: list[int], other: list | None) -> set[int]:
    """Which of these places of a page its neighbour has, too, in order."""
    return {places[i] for i in lcs([own[k] for k in places], other)} if other else set()


def _rest(sure: list[int], own: list) -> list[int]:
    fixed = set(sure)
    return [k for k in range(len(own)) if k not in fixed]


def _kept(sure: list[int], open_: list[int], own: list[str], shared: set[int]) -> str:
    """What differencing leaves, held against the structure: lines of the article come back, asides go."""
    if sum(len(own[k]) for k in shared) >= COPY * sum(len(own[k]) for k in _rest(sure, own)):
        shared = set()  # a near copy: what it shares is the article
    return "\n".join(own[k] for k in sorted([*sure, *(k for k in open_ if k not in shared)]))


def main_text(page: str, nearest: list[str] | None = None) -> str:
    """The article, less what may be an aside and is shared with the page of the nearest URL (its lines outside its own
    article); without an article or main element, the text outside asides less the lines shared in order with that page."""
    found = lines(page)
    sure, open_ = _sorted_out(found)
    own = [t for _, t in found]
    return _kept(sure, open_, own, _shared(own, _rest(sure, own), nearest))


_KEYS = pa.schema([("part", pa.int64()), ("run", pa.int64()), *((n, pa.string()) for n in ("host", "path", "page", "sig", "before", "before_path", "after", "after_path"))])
_KEYS_DDL = "part long, run long, host string, path string, page string, sig string, before string, before_path string, after string, after_path string"
_NEAR = pa.schema([("page", pa.string()), ("near", pa.string())])


def _closeness(a: str, b: str | None) -> tuple[int, int]:
    """How many folders two paths have in common, and then how many characters."""
    folders = lambda p: p.split("/")[:-1]
    same = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    return same(folders(a), folders(b or "")), same(a, b or "")


def _beyond(edge: list, k: int, step: int) -> tuple | None:
    """(page, path) of the first page of another text beyond part k, in the parts before (-1) or after it (1)."""
    end, front, then = ("last", "first", "after") if step > 0 else ("first", "last", "before")
    host, sig = edge[k][end]["host"], edge[k][end]["sig"]
    k += step
    while 0 <= k < len(edge) and edge[k][front]["host"] == host:
        row = edge[k][front]
        if row["sig"] != sig:
            return row["page"], row["path"]
        if row[then] is not None:
            return row[then], row[then + "_path"]
        if edge[k]["first"]["run"] != edge[k]["last"]["run"]:
            return None
        k += step
    return None


def _neighbours(keys: DataFrame) -> DataFrame:
    """(page, near): for each page the one of another text whose URL path stands nearest in order within its host.

    Of the pages before and after it the one with more folders in common; pages in a row with one sig (copies)
    pass each other over. Rows are dealt out by ranges of (host, path), so a host with very many pages is many
    ranges. The first and last row of each range are matched with the ranges beside it; these are two
    rows for each range, whatever the number of pages.
    """
    spark = session(keys)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        from pyspark import TaskContext

        part, held, number = TaskContext.get().partitionId(), [], -1
        for b in (*batches, None):
            out = []
            for host, path, page, sig in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True) if b is not None else [(None,) * 4]:
                last = held[-1] if held else None
                if last is None or page is None or (host, sig) != (last["host"], last["sig"]):
                    same = last is not None and page is not None and host == last["host"]
                    out += [r | {"after": page, "after_path": path} if same else r for r in held]
                    held, number = [], number + 1
                    before = (last["page"], last["path"]) if same else (None, None)
                else:
                    before = last["before"], last["before_path"]
                if page is not None:
                    held.append({"part": part, "run": number, "host": host, "path": path, "page": page, "sig": sig, "before": before[0], "before_path": before[1], "after": None, "after_path": None})
            if out:
                yield table({f: [r[f] for r in out] for f in _KEYS.names}, _KEYS)

    def nearest(batches):
        for b in batches:
            page, path, before, before_path, after, after_path = (b.column(k).to_pylist() for k in range(6))
            near = [
                x if y is None or (x is not None and _closeness(p, px) >= _closeness(p, py)) else y
                for p, x, px, y, py in zip(path, before, before_path, after, after_path, strict=True)
            ]
            yield table({"page": page, "near": near}, _NEAR)

    dealt = keys.repartitionByRange(n, "host", "path", "page").sortWithinPartitions("host", "path", "page")
    rows = cut(dealt.select("host", "path", "page", "sig").mapInArrow(run, _KEYS_DDL))
    whole = F.struct("run", "host", "path", "page", "sig", "before", "before_path", "after", "after_path")
    edge = rows.groupBy("part").agg(F.min_by(whole, F.struct("run", "path", "page")).alias("first"), F.max_by(whole, F.struct("run", "path", "page")).alias("last")).orderBy("part").collect()
    beside = [(e["part"], e["first"]["run"], e["last"]["run"], *(_beyond(edge, k, -1) or (None, None)), *(_beyond(edge, k, 1) or (None, None))) for k, e in enumerate(edge)]
    extra = spark.createDataFrame(beside, "part long, low long, high long, b string, bp string, a string, ap string")
    joined = rows.join(F.broadcast(extra), "part")
    # Only rows at an edge of their range, with nothing on that side within it, look beyond.
    left = F.col("before").isNull() & (F.col("run") == F.col("low"))
    right = F.col("after").isNull() & (F.col("run") == F.col("high"))
    ends = [F.when(left, F.col(x)).otherwise(F.col(y)) for x, y in (("b", "before"), ("bp", "before_path"))] + [F.when(right, F.col(x)).otherwise(F.col(y)) for x, y in (("a", "after"), ("ap", "after_path"))]
    return joined.select("page", "path", *ends).mapInArrow(nearest, "page string, near string")


#: Bytes of a line's digest, which stands for the line where pages are aligned.
MARK = 8


def _mark(line: str) -> bytes:
    return blake2b(line.encode(errors="surrogatepass"), digest_size=MARK).digest()


def _marks(joined: bytes | None) -> list[bytes]:
    return [joined[k : k + MARK] for k in range(0, len(joined or b""), MARK)]


_MARKED = pa.schema([("host", pa.string()), ("path", pa.string()), ("page", pa.string()), ("sig", pa.string()), ("inside", pa.binary()), ("outside", pa.binary())])
_PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("page", pa.string()), ("sure", pa.list_(pa.int32())), ("open", pa.list_(pa.int32())), ("lines", pa.list_(pa.string()))])


def _marked(base: DataFrame) -> DataFrame:
    """(host, path, page, sig, inside, outside): digests of a page's lines, of the article and of the rest, and of all that may be text."""

    def run(batches):
        for b in batches:
            *keys, html_ = (b.column(k).to_pylist() for k in range(4))
            sig, inside, outside = [], [], []
            for text in html_:
                found = lines(text)
                own, (sure, open_) = [_mark(t) for _, t in found], _sorted_out(found)
                sig.append(blake2b(b"".join(own[k] for k in (*sure, *open_)), digest_size=MARK).hexdigest())
                inside.append(b"".join(own[k] for k in sure))
                outside.append(b"".join(own[k] for k in _rest(sure, own)))
            yield table(dict(zip(_MARKED.names, (*keys, sig, inside, outside), strict=True)), _MARKED)

    return base.select("host", "path", "page", "html").mapInArrow(run, "host string, path string, page string, sig string, inside binary, outside binary")


def _parsed(base: DataFrame) -> DataFrame:
    """The lines of each page, and which of them are the article's and which may be text."""

    def run(batches):
        for b in batches:
            *keys, html_ = (b.column(k).to_pylist() for k in range(4))
            found = [lines(text) for text in html_]
            sure, open_ = zip(*map(_sorted_out, found), strict=True) if found else ((), ())
            yield table(dict(zip(_PARSED.names, (*keys, sure, open_, [[t for _, t in x] for x in found]), strict=True)), _PARSED)

    return base.select("page_id", "url", "page", "html").mapInArrow(run, "page_id long, url string, page string, sure array<int>, open array<int>, lines array<string>")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text (blocks joined by line ends; empty if none), n_chars (code points), n_lines, n_shared.

    Every page is paired with that of the nearest URL path within its host, copies of itself passed over, and
    aligned with it by longest common subsequence: the lines of its article with those of the neighbour's, the
    other lines with the other ones. n_shared of its n_lines are in the neighbour, too; they are taken for the
    site's. Structure is then the check: lines of an article (or main) element come back, as neighbours quote
    and repeat each other's; menus, headers, footers, adverts, forms, comments and the like go by element and
    by the words of their class, id or role. So differencing decides the lines of the article whose class only
    may mean an aside, and the lines of a page without an article. Null html or url: empty. Rows that
    repeat an id are extracted each for itself.
    """
    spark = session(pages)
    bounded_batches(spark, 128)
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rest = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    base = base.select(
        "*",
        # A page's key: its id and a digest, so that rows with one id but other content stay apart.
        F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.hex(F.xxhash64("url", "html"))).alias("page"),
        F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_shared", pa.int64())])

    def differ(batches):
        for b in batches:
            out: list[tuple] = []
            for key, url, sure, open_, own, inside, outside in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                marks = [_mark(t) for t in own]
                article, other = _shared(marks, sure, _marks(inside)), _shared(marks, _rest(sure, own), _marks(outside))
                out.append((key, url, _kept(sure, open_, own, other), len(own), len(article) + len(other)))
            yield table({n: [r[k] for r in out] for k, n in enumerate(schema.names)}, schema)

    marked = _marked(base)
    near = _neighbours(marked.select("host", "path", "page", "sig").distinct()).where("near is not null")
    # Rows that repeat a whole page have one digest, so any of them will do.
    paired = near.join(marked.select(F.col("page").alias("near"), "inside", "outside"), "near").dropDuplicates(["page"]).select("page", "inside", "outside")
    full = _parsed(base).join(paired, "page", "left").select("page_id", "url", "sure", "open", "lines", "inside", "outside")
    done = full.mapInArrow(differ, "page_id long, url string, text string, n_lines long, n_shared long")
    return done.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_lines", "n_shared")
