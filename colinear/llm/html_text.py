"""Main text of web pages: marked-up chrome goes, and lines shared with the page of the nearest URL."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colinear.llm.words import column
from colinear.session import stored, table

# Element names of HTML.
RAW = frozenset("script style textarea title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME = frozenset("script style noscript iframe template svg math nav header footer aside form button select option textarea object canvas audio video dialog menu head title label fieldset legend datalist map applet noembed noframes xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCKS - frozenset("html body td th tr tbody thead tfoot caption li dd dt option optgroup".split()) | {"p"}
# Words in class or id that name page parts outside the article, and such roles.
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup menu nav navbar navigation breadcrumb breadcrumbs sidebar sidebars aside widget widgets related recommended recommendations share sharing social footer header masthead comment comments disqus reply replies respond discussion login search searchform pagination pager toolbar topbar skip copyright legal disclaimer tracking".split()
)
#: Words that make any name that begins with them a part's, those after which a name says what a part has or hasn't, those of the
#: article itself, whose header is its own, and those that end a name without changing what it names.
LEADING = frozenset("ad ads advert advertisement adsense sponsor sponsored promo cookie cookies consent gdpr newsletter social share sharing related recommended nav navbar sidebar footer breadcrumb breadcrumbs".split())
HAVING = frozenset("has have no not with without is are show hide can".split())
OWN = frozenset("article post entry story news blog content".split())
ENDING = frozenset("container wrapper wrap inner outer box area block section list lists item items row col column columns group holder slot panel unit link links button buttons bar zone icon icons left right top bottom main primary secondary".split())
#: What a leading word speaks of in a name such as related-posts; with another word (related-work) the name only mentions a part.
ITEMS = frozenset("articles content contents feed media more news pages posts products reads stories topics videos".split())
# Elements within a sentence, whose names don't make them a part of the page, and those that stand in a head.
PHRASE = frozenset("abbr acronym b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

#: Added to the kind of a block whose surroundings have a name that mentions a part: differencing decides on it.
HINTED = 4
#: An open block with more than this share of its characters in links is a menu.
LINKS = 0.6
#: Pages whose lines differ in less than this share of their characters are copies: differencing leaves them alone.
COPY = 0.1
#: Pages that mark an article are versions of each other from this shared share of its characters on, as the article's
#: own lines are more likely text than an open page's.
VERSION = 0.5
#: Up to this many pages with lines to delete are sent to every task; beyond, they are joined.
SENT = 200_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|[^<]++|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_UNSHOWN = re.compile(r"display\s*:\s*none", re.I)
_CUT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _named(name: str, in_article: bool) -> int:
    """What one class or id says: 2 for a part outside the article, 1 if it only mentions one, 0 for neither."""
    words = [w for w in _CUT.split(_CAMEL.sub("-", name).lower()) if w]
    while len(words) > 1 and (words[-1] in ENDING or words[-1].isdigit()):
        words.pop()
    if not words or words[0] in HAVING:
        return 0
    if words[-1] == "header" and (in_article or words[0] in OWN):
        return 0
    if words[-1] in PARTS or words[0] in LEADING and (not in_article or all(w in ITEMS or w in PARTS for w in words[1:])):
        return 2
    return int(not PARTS.isdisjoint(words))


def _part(attributes: str, in_article: bool, phrase: bool = False) -> int:
    """3: the element is hidden; 2: the attributes name a page part outside the article; 1: a name mentions such a part; else 0.

    The names of a phrase in a sentence say nothing about the page.
    """
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), unescape((m[2] or "").strip("\"'")))
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _UNSHOWN.search(found.get("style", "")):
        return 3
    if phrase:
        return 0
    if found.get("role", "").lower() in ROLES:
        return 2
    return max((_named(name, in_article) for key in ("class", "id") for name in found.get(key, "").split()), default=0)


def blocks(html: str) -> list[tuple[str, int]]:
    """Blocks of text in page order, white space folded: (text, kind); 0: in chrome, 1: open, 2: inside article or main; and with
    HINTED added: an element around it has a name that mentions chrome. A head whose end tag is left out ends at the first element or
    text that can't stand in it; hidden phrases go without parting their sentence."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, bool, bool, bool, bool]] = []  # element; in chrome, in an article, in a link, hinted, in a hidden phrase
    text: list[str] = []
    linked = 0
    chrome = article = link = hinted = mute = False

    def flush() -> None:
        nonlocal linked
        if text:
            line = " ".join(unescape("".join(text)).split())
            if line:
                kind = 0 if chrome else 2 if article else 1
                out.append((line, 0 if kind == 1 and linked > LINKS * len(line) else kind + HINTED * (kind > 0 and hinted)))
            text.clear()
        linked = 0

    def settle() -> None:
        nonlocal chrome, article, link, hinted, mute
        chrome, article, link, hinted, mute = stack[-1][1:] if stack else (False,) * 5

    at, size, scan = 0, len(html), _TOKEN.match
    while at < size:
        m = scan(html, at)
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            piece = m[0]
            if mute:
                continue
            if piece[0] != "<" or piece == "<":
                if stack and stack[-1][0] == "head" and not piece.isspace():
                    stack.pop()
                    settle()
                text.append(piece)
                if link:
                    linked += len(piece.strip())
            continue
        name, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if name in BLOCKS:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if name not in BLOCKS and any(x[0] in BLOCKS for x in stack[i + 1 :]):
                        break  # an inline end tag doesn't close blocks
                    outside = stack[i - 1] if i else ("", False, False, False, False, False)
                    if name in CHROME or stack[i][1] != outside[1] or stack[i][4] != outside[4]:
                        flush()
                    del stack[i:]
                    settle()
                    break
            continue
        if name == "br":
            text.append(" ")
            continue
        if stack and (name == "body" or stack[-1][0] == "head" and name not in IN_HEAD):
            for i, x in enumerate(stack):
                if x[0] == "head":
                    flush()
                    del stack[i:]
                    settle()
                    break
        if name in BLOCKS:
            flush()
        if name in ENDS_P and stack:  # an open paragraph, and what is in it, ends here
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    settle()
                    break
                if stack[i][0] in BLOCKS:
                    break
        elif name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = ("td", "th") if name in ("td", "th") else ("dt", "dd") if name in ("dt", "dd") else (name,)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in same:
                    del stack[i:]
                    settle()
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "select", "menu"):
                    break
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else size
            continue
        inner = name in ("article", "main")
        phrase = name in PHRASE
        part = _part(attributes, article, phrase) if attributes and name not in ("html", "body") else 0
        if phrase:
            stack.append((name, chrome, article, link, hinted, mute or part == 3))
            settle()
            continue
        own = name in CHROME and not (name == "header" and article) or part >= 2
        if own and not chrome or part and not hinted:
            flush()
        stack.append((name, chrome or own, article or inner and not chrome and not own, link or name == "a", hinted or part > 0, mute))
        settle()
    flush()
    return out


def main_kind(sizes: list[int], kinds: list[int]) -> int:
    """2 if most of the text outside chrome is inside an article or main element, else 1 (an article may be a teaser)."""
    marked = sum(n for n, kind in zip(sizes, kinds) if kind % HINTED == 2)
    return 2 if marked and marked >= sum(n for n, kind in zip(sizes, kinds) if kind % HINTED == 1) else 1


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Indices in a of a longest common subsequence with b."""
    lo, n, m = 0, len(a), len(b)
    while lo < min(n, m) and a[lo] == b[lo]:
        lo += 1
    tail = 0
    while tail < min(n, m) - lo and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    places = defaultdict(list)
    for j in range(m - tail - 1, lo - 1, -1):  # descending, so that one line of a takes one of b
        places[b[j]].append(j)
    ends: list[int] = []
    nodes: list[tuple] = []
    for i in range(lo, n - tail):
        for j in places.get(a[i], ()):
            k = bisect_left(ends, j)
            node = (i, nodes[k - 1] if k else None)
            ends[k : k + 1], nodes[k : k + 1] = [j], [node]
    middle, node = [], nodes[-1] if nodes else None
    while node:
        middle.append(node[0])
        node = node[1]
    return [*range(lo), *reversed(middle), *range(n - tail, n)]


def shared_lines(own: tuple[list[int], list[int], list[int]], other: tuple[list[int], list[int], list[int]]) -> tuple[bool, list[int]]:
    """(copy, indices of own lines of main text that the other page shares); a page is its lines' hashes, lengths and kinds.

    All lines are aligned, those in chrome too, which are never main text themselves. Of a copy nothing is shared.
    """
    main = main_kind(own[1], own[2])
    gone = [i for i in common_lines(own[0], other[0]) if own[2][i] % HINTED == main]
    total = sum(n for n, kind in zip(own[1], own[2]) if kind % HINTED == main)
    rest = total - sum(own[1][i] for i in gone)
    if rest < COPY * max(1, total) or main == 2 and rest <= (1 - VERSION) * total:
        return True, []
    return False, gone


def _keyed(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.xxhash64(F.col("page_id").cast("long"), F.col("url"), F.col("html")).alias("row_key"))


def compared_pages(pages: DataFrame) -> DataFrame:
    """(row_key, near, turn, gone): a page against the nearest pages before and after it on its host that aren't its copies.

    The pages are sorted by host and path over all partitions, so a host with a third of all pages is no one task's. Rows
    that are copies of the row before them form a run; a page meets the row before its run and the row after it. gone: the
    lines of main text shared with that page, near: how long the common start of the paths is, turn: 1 for the page after.
    Pages without a url, or alone on their host but for copies, have no row.
    """
    outline = pa.schema([("row_key", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("hashes", pa.binary()), ("sizes", pa.binary()), ("kinds", pa.binary())])

    def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, url, html in zip(column(batch, "row_key"), column(batch, "url"), column(batch, "html")):
                m = re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#]*@)?([^/?#]*)([^#]*)", url or "")
                found = blocks(html or "") if m else []
                if any(kind for _, kind in found):
                    rows.append({"row_key": key, "host": m[1].lower(), "path": m[2] or "/", "hashes": np.array([xxhash.xxh64_intdigest(x) for x, _ in found], np.uint64).tobytes(), "sizes": np.array([len(x) for x, _ in found], np.int32).tobytes(), "kinds": bytes(kind for _, kind in found)})
            yield pa.RecordBatch.from_pylist(rows, schema=outline)

    ddl = "row_key long, host string, path string, hashes binary, sizes binary, kinds binary"
    found = stored(_keyed(pages).select("row_key", "url", "html").mapInArrow(lines_of, ddl).dropDuplicates(["row_key"]))
    placed = stored(found.repartitionByRange("host", "path", "row_key").sortWithinPartitions("host", "path", "row_key").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("at", 33).alias("part")
    ends = placed.groupBy(part).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))  # a row a partition
    steps = ends.select("hi", F.lead("lo").over(Window.orderBy("part")).alias("next"))
    after = placed.join(steps, placed["at"] == steps["hi"], "left").select("row_key", "host", "path", "hashes", "sizes", "kinds", "at", F.coalesce("next", F.col("at") + 1).alias("next"))
    own = ("path", "hashes", "sizes", "kinds")
    side = lambda p: after.select(*[F.col(c).alias(f"{p}{c}") for c in after.columns])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda r, p: (np.frombuffer(r[p + "hashes"], np.uint64).tolist(), np.frombuffer(r[p + "sizes"], np.int32).tolist(), list(r[p + "kinds"]))
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                copy, gone = shared_lines(read(r, ""), read(r, "o_"))
                rows.append({"row_key": r["row_key"], "at": r["at"], "near": len(commonprefix([r["path"], r["o_path"]])), "turn": r["turn"], "copy": copy, "gone": gone})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("row_key", pa.int64()), ("at", pa.int64()), ("near", pa.int32()), ("turn", pa.int32()), ("copy", pa.bool_()), ("gone", pa.list_(pa.int32()))]))

    def met(pairs: DataFrame, turn: int) -> DataFrame:
        wanted = pairs.select("row_key", "at", *own, *[F.col(f"o_{c}") for c in own], F.lit(turn).alias("turn"))
        return wanted.mapInArrow(compare, "row_key long, at long, near int, turn int, copy boolean, gone array<int>")

    before = met(side("").join(side("o_"), F.expr("at = o_next AND host = o_host")), 0).where("copy").select(F.col("at").alias("in_run"))
    flagged = placed.select("at", part).join(before, F.col("at") == F.col("in_run"), "left").select("at", "part", F.when(F.col("in_run").isNull(), F.col("at")).alias("start"))
    flagged = stored(flagged)
    up, down = Window.unboundedPreceding, lambda x: F.col(x).desc()  # frames that follow a row take its square in time, so order is turned
    outer = flagged.groupBy("part").agg(F.min("start").alias("first"), F.max("start").alias("last"))  # a row a partition
    outer = outer.select("part", F.max("last").over(Window.orderBy("part").rowsBetween(up, -1)).alias("last"), F.min("first").over(Window.orderBy(down("part")).rowsBetween(up, -1)).alias("first"))
    inner = Window.partitionBy("part")
    runs = flagged.select("at", "part", F.max("start").over(inner.orderBy("at").rowsBetween(up, 0)).alias("start"), F.min("start").over(inner.orderBy(down("at")).rowsBetween(up, -1)).alias("stop"))
    runs = runs.join(F.broadcast(outer), "part").select(F.col("at").alias("r_at"), F.coalesce("start", "last").alias("start"), F.coalesce("stop", "first").alias("stop"))
    placed_runs = side("").join(runs, F.col("at") == F.col("r_at"))
    found = met(placed_runs.join(side("o_"), F.expr("stop = o_at AND host = o_host")), 1).union(met(placed_runs.join(side("o_"), F.expr("start = o_next AND host = o_host")), 0))
    return found.where("not copy").select("row_key", "near", "turn", "gone")


def differences(pages: DataFrame) -> DataFrame:
    """(row_key, gone): indices of a page's blocks that leave its main text.

    Open lines, and lines in an element whose name mentions chrome, go if the page of the nearest URL path (compared_pages) shares
    them. Other lines of a marked article are main text by their mark: they go only if the pages before and after both share
    them, so that a passage two pages have stays.
    """
    compared = compared_pages(pages)
    nearest = compared.groupBy("row_key").agg(F.max_by("gone", F.struct(F.col("near"), -F.col("turn"))).alias("gone"), F.collect_list("gone").alias("all"))
    both = F.when(F.size("all") == 2, F.array_intersect(F.get("all", F.lit(0)), F.get("all", F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return nearest.select("row_key", "gone", both.alias("both")).where(F.size("gone") > 0)


def main_text(pages: DataFrame) -> DataFrame:
    """pages -> (page_id, url, text, n_chars), a row for each row.

    Lines inside <article> or <main> are the main text, where these hold less than the open lines do, the open ones; without
    those that differencing takes away (differences). Null and empty html give an empty text; a null url has no neighbour.
    Repeated rows each give a row, very long pages are read whole, other columns are ignored.
    """
    gone = stored(differences(pages))
    n = gone.count()
    keyed = _keyed(pages)
    if n == 0:
        keyed = keyed.withColumns({c: F.lit(None).cast("array<int>") for c in ("gone", "both")})
    else:
        keyed = keyed.join(F.broadcast(gone) if n <= SENT else gone, "row_key", "left")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, gone, both in zip(column(batch, "html"), column(batch, "gone"), column(batch, "both")):
                found = blocks(html or "")
                main = main_kind([len(x) for x, _ in found], [kind for _, kind in found])
                one, two = set(gone or ()), set(both or ())
                texts.append("\n\n".join(x for i, (x, kind) in enumerate(found) if kind % HINTED == main and i not in (two if kind == 2 else one)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], schema=schema)

    out = keyed.select("page_id", "url", "html", "gone", "both").mapInArrow(run, "page_id long, url string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
