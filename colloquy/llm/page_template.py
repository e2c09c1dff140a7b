"""Main text of web pages by equivalence classes of tokens over the pages of a host.

A page is a sequence of tokens: tags with the path they stand in, and text nodes. The occurrence vector of a token
says how often each page of its host has it; pages of equal content count once. Tokens of one vector form an
equivalence class. Vectors are compared by their sums of hashed (page, count) pairs, so a class is an aggregate over any
number of pages. A class is valid if it has two members or more, stands equally often wherever it occurs, does so in
most pages of the host, and nests: its tags all lie in the same class around them. Valid classes are the host's
template, the texts between their tokens its slots.

The article's slots are those inside the template's article or main element, or else inside the deepest single element
that holds most of the text that varies between pages. There nothing is taken for template because it repeats. Outside, what
valid classes repeat word for word goes, other slots stay. Which slots are menus, notices, adverts and the like cannot be seen from structure
alone: names of elements and roles tell it, and names of classes and ids outside the article. Inside it such a name counts
only for elements that the template repeats, but for adverts, comments and subscriptions.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.url_rules import host_of
from colloquy.runtime import materialize, small_side

SUPPORT = 0.5     # share of a host's pages that a template token occurs in
MIN_PAGES = 3     # pages from which classes say something

# fixed names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object select".split())
UNCLOSED = frozenset("noscript template svg iframe object select".split())  # RAW elements that end with their tag if never closed
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
LEFT_OUT = frozenset("nav header footer aside form dialog menu head button label".split())
HINTS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo|banner|cookies?|consent|notice|popup|modal|newsletter|subscribe|sidebar|nav|navbar|menu|"
    r"breadcrumbs?|header|footer|comments?|comment-list|respond|share|social|related|widget)(?:$|[\s_-])", re.I)
# names of class and id that also count inside an article on pages without a template
FOREIGN = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo|cookies?|consent|popup|modal|newsletter|subscribe|sidebar|navbar|breadcrumbs?|"
    r"comments?|comment-list|respond)(?:$|[\s_-])", re.I)
HOLDERS = frozenset("body center div section td".split())  # elements that may hold an article
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
CLOSES = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}


CONTENT = re.compile(r"/(?:article|main)(?:\.[^/]*)?(?=/|$)")

Out = bool | str  # left out or not, or the path of an element that goes if the template repeats it
Token = tuple[str, Out, str | None]


def _foreign(name: str, marks: dict, inside: bool) -> bool:
    """True if the element itself says that it is no article text; an article may have a header."""
    shown = name not in LEFT_OUT or inside and name == "header"
    return not shown or marks.get("role", "") in ROLES or "hidden" in marks or marks.get("aria-hidden") == "true"


def parse(page: str) -> list[Token]:
    """Tokens in order: (path, left out, text) for text nodes and (path, left out, None) for opened tags.

    Raw elements and comments have no text. A path is the open elements with class and id, inline ones left out.
    """
    out: list[Token] = []
    stack: list[tuple[str, str, Out]] = [("", "", False)]  # name, path, left out
    at, end = 0, len(page)

    def text(piece: str) -> None:
        if piece:
            out.append((stack[-1][1], stack[-1][2], piece))

    while at < end:
        tag = TOKEN.search(page, at)
        if not tag:
            text(page[at:])
            break
        text(page[at:tag.start()])
        at = tag.end()
        name = (tag.group(2) or "").lower()
        if not name:
            continue
        if tag.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    if name in BLOCKS:
                        out.append((stack[-1][1] + "/" + name + ">", stack[-1][2], None))
                    break
            continue
        if name == "br":
            text(" ")
            continue
        if name in RAW:
            out.append((stack[-1][1] + "/" + name, True, None))
            if name == "svg" and tag.group(3).endswith("/"):
                continue
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else at if name in UNCLOSED else end
            continue
        while stack[-1][0] in CLOSES and name in CLOSES[stack[-1][0]]:
            stack.pop()
        if name in BLOCKS:
            # an open paragraph ends before a block, also under inline elements
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in BLOCKS:
                    break
        marks = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(tag.group(3))}
        named = " ".join(filter(None, (marks.get("class"), marks.get("id"))))
        path, hidden = stack[-1][1], stack[-1][2]
        if name in BLOCKS:
            inside = bool(CONTENT.search(path))
            path = f"{path}/{name}" + (f".{named.replace('/', '_')}" if named else "")
            hidden = hidden is True or _foreign(name, marks, inside) or hidden
            if not hidden and named and name not in ("html", "body", "article", "main") and HINTS.search(named):
                hidden = path if inside and not FOREIGN.search(named) else True
            elif isinstance(hidden, str) and named and FOREIGN.search(named):
                hidden = True
            out.append((path, hidden, None))
        elif name in LEFT_OUT:
            hidden = True
        if name not in VOID and not tag.group(3).endswith("/"):
            stack.append((name, path, hidden))
    return out


def clean(text: str) -> str:
    """Character references decoded, white space as one space, trimmed."""
    import html

    return " ".join(html.unescape(text).split())


def blocks_of(tokens: list[Token]) -> list[tuple[str, Out, str]]:
    """(path, left out, text) of every block with text: what stands between two block tags."""
    out, open_parts = [], []

    def flush() -> None:
        if open_parts:
            joined = clean("".join(p[2] for p in open_parts))
            if joined:
                out.append((open_parts[0][0], open_parts[0][1], joined))
            open_parts.clear()

    for token in tokens:
        if token[2] is None:
            flush()
        else:
            if open_parts and (open_parts[0][0], open_parts[0][1]) != token[:2]:
                flush()
            open_parts.append(token)
    flush()
    return out


def hashed(value: str) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(value.encode("utf-8", "surrogatepass"))


def occurrences(pages: DataFrame) -> DataFrame:
    """host, kind, token, path, size, vector, pages, least, most: the occurrence vector of each token, as sums over pages.

    ``kind`` is tag, text, left (a text that names leave out) or page; ``path`` and ``size`` (characters) are those of a text. Each task sums what it has read of a host before it gives it out; Spark adds the sums up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list[int]] = {}

        def given() -> pa.RecordBatch:
            columns = list(zip(*((*k, *v) for k, v in sums.items()), strict=True))
            sums.clear()
            kinds = [pa.string()] * 4 + [pa.int64()] * 5
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], fields)

        for batch in batches:
            for host, page, key in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "page")), strict=True):
                counts: dict[tuple[str, str, str, int], int] = defaultdict(int)
                tokens = parse(page)
                for path, _, text in tokens:
                    if text is None:
                        counts["tag", path, "", 0] += 1
                for path, left, text in blocks_of(tokens):
                    counts["left" if left else "text", text_token(path, text), path, len(text)] += 1
                counts["page", "", "", 0] = 1
                for token, n in counts.items():
                    # 40 bits, so that sums over any number of pages stay within a long
                    own = hashed(f"{key} {n}") & 0xFFFFFFFFFF
                    s = sums.get((host, *token))
                    if s is None:
                        sums[(host, *token)] = [own, 1, n, n]
                    else:
                        s[0], s[1], s[2], s[3] = s[0] + own, s[1] + 1, min(s[2], n), max(s[3], n)
                if len(sums) > 200_000:
                    yield given()
        if sums:
            yield given()

    keys, sums_of = ["host", "kind", "token", "path", "size"], {"vector": F.sum, "pages": F.sum, "least": F.min, "most": F.max}
    fields = [*keys[:4], "size", *sums_of]
    parts = _once(pages).mapInArrow(run, "host string, kind string, token string, path string, size long, vector long, pages long, least long, most long")
    return parts.groupBy(*keys).agg(*[f(c).alias(c) for c, f in sums_of.items()])


def _once(pages: DataFrame) -> DataFrame:
    """Each content of a host once. Only pages that have copies are moved, the others stay where they are read."""
    copied = materialize(pages.groupBy("host", "page").count().where("count > 1").select("host", "page"))
    if copied.isEmpty():
        return pages
    keys = small_side(copied)
    return pages.join(keys, ["host", "page"], "left_anti").unionByName(pages.join(keys, ["host", "page"], "left_semi").dropDuplicates(["host", "page"]))


def text_token(path: str, text: str) -> str:
    return f"{hashed(path + chr(10) + text):016x}"


def _around(token: Column) -> Column:
    """The paths around a path and the path itself."""
    steps = F.split(token, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(steps))), lambda i: F.array_join(F.slice(steps, 1, i), "/"))


def templates(occurring: DataFrame, support: float = SUPPORT, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, vector, kind, token, path, parent, most: the tokens of valid classes.

    A class is the tokens of one vector. It is valid if its tokens occur equally often in each page that has them, in at
    least ``support`` of the host's different pages and in ``min_pages``, if it has two members or more, since a single token shows
    no structure, and if it nests: the nearest tag of another class around its tags is of one class, ``parent`` (null: none).
    """
    sizes = occurring.where("kind = 'page'").select("host", F.col("pages").alias("all_pages"))
    often = occurring.where("kind <> 'page' and least = most").where(F.col("pages") >= min_pages)
    often = often.join(sizes, "host").where(F.col("pages") >= support * F.col("all_pages"))
    # a class without tags has no place in the template; its texts alone show nothing
    classes = often.groupBy("host", "vector").agg(F.count("*").alias("members"), F.count_if(F.col("kind") == "tag").alias("tags"))
    often = materialize(often.join(classes.where("members > 1 and tags > 0"), ["host", "vector"]))
    tags = often.where("kind = 'tag'").select("host", "vector", "token")
    outer = tags.select("host", F.col("vector").alias("parent"), F.col("token").alias("around"))
    inner = tags.select("host", "vector", "token", F.explode(_around(F.col("token"))).alias("around"))
    near = inner.join(outer, ["host", "around"]).where("parent <> vector")
    near = near.groupBy("host", "vector", "token").agg(F.max_by("parent", F.length("around")).alias("parent"))
    placed = tags.join(near, ["host", "vector", "token"], "left")
    nested = placed.groupBy("host", "vector").agg(F.max("parent").alias("parent"), F.countDistinct("parent").alias("_some"), F.count_if(F.col("parent").isNull()).alias("_none"))
    nested = nested.where("_some + least(_none, 1) = 1").select("host", "vector", "parent")
    return often.join(nested, ["host", "vector"]).select("host", "vector", "kind", "token", "path", "parent", "most")


def holders(occurring: DataFrame, template: DataFrame) -> DataFrame:
    """host, holder: the deepest template element, once to a page, that holds at least half of the characters that vary."""
    repeated = template.where("kind = 'text'").select("host", "token")
    varying = occurring.where("kind = 'text'").join(repeated, ["host", "token"], "left_anti")
    weights = varying.groupBy("host", "path").agg(F.sum(F.col("size") * F.col("pages")).alias("weight"))
    total = weights.groupBy("host").agg(F.sum("weight").alias("total"))
    around = weights.select("host", "weight", F.explode(_around(F.col("path"))).alias("token")).groupBy("host", "token").agg(F.sum("weight").alias("weight"))
    name = F.regexp_extract("token", r"([^/.]*)(?:\.[^/]*)?$", 1)
    single = template.where("kind = 'tag' and most = 1").where(name.isin(*HOLDERS)).select("host", "token")
    most = around.join(total, "host").where("2 * weight >= total").join(single, ["host", "token"])
    return most.groupBy("host").agg(F.max_by("token", F.struct(F.size(F.split("token", "/")), "weight", "token")).alias("holder"))


def extract_text(
    pages: DataFrame, url: str = "url", html: str = "html", support: float = SUPPORT, min_pages: int = MIN_PAGES,
) -> DataFrame:
    """Columns of ``pages`` with text and slots; columns of those names are replaced.

    ``text`` is the article's blocks in page order, joined by line feeds: references decoded, white space in a block
    made one space, blocks trimmed, empty ones left out. ``slots`` are (path, text) of the same blocks. A null page
    is empty, a null url has the empty host. Equal rows give equal results; an empty table gives none. Unclosed and stray tags
    are read as browsers do, roughly.

    Templates have some tokens to a host. They come to the pages as one array per host, joined on the host.
    """
    source = pages.drop("text", "slots")
    read = source.select(host_of(F.col(url)).alias("host"), F.coalesce(html, F.lit("")).alias("html"), F.xxhash64(html).alias("page"))
    occurring = materialize(occurrences(read))
    found = materialize(templates(occurring, support, min_pages))
    per_host = found.groupBy("host").agg(
        F.collect_set(F.when(F.col("kind") == "tag", F.col("token"))).alias("tags"), F.collect_set(F.when(F.col("kind") == "text", F.col("token"))).alias("texts"))
    per_host = materialize(per_host.join(holders(occurring, found), "host", "left").select("host", "tags", "texts", "holder"))
    joined = source.withColumn("__host", host_of(F.col(url))).join(per_host.toDF("__host", "__tags", "__texts", "__holder"), "__host", "left")
    schema = f"{source._jdf.schema().toDDL()}, text string, slots array<struct<path: string, text: string>>"
    kind = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string())]))
    names = source.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[frozenset, frozenset, str | None]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, slots = [], []
                for i, (host, page) in enumerate(zip(part.column("__host").to_pylist(), part.column(html).to_pylist(), strict=True)):
                    if host not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[host] = *(frozenset(part.column(c)[i].as_py() or ()) for c in ("__tags", "__texts")), part.column("__holder")[i].as_py()
                    own = article(page or "", *known[host])
                    texts.append("\n".join(t for _, t in own))
                    slots.append([{"path": p, "text": t} for p, t in own])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(texts, pa.string()), pa.array(slots, kind)], [*names, "text", "slots"])

    return joined.select(*names, "__host", "__tags", "__texts", "__holder").mapInArrow(run, schema)


def article(page: str, tags: frozenset[str], texts: frozenset[str], holder: str | None = None) -> list[tuple[str, str]]:
    """(path, text) of the slots that hold the article, given the template's tags and texts and its ``holder``."""
    blocks = [(p, t) for p, left, t in blocks_of(parse(page)) if left is False or isinstance(left, str) and left not in tags]

    def content(path: str) -> bool:
        m = CONTENT.search(path)
        # the element is the template's, or the host has no template
        return bool(m) and (not tags or path[:m.end()] in tags or not any(CONTENT.search(t) for t in tags))

    inside = [(p, t) for p, t in blocks if content(p)]
    if inside:
        return inside
    # no article element: all that stands in the holder, elsewhere what the template does not repeat
    held = lambda path: holder is not None and (path == holder or path.startswith(holder + "/"))
    return [(p, t) for p, t in blocks if held(p) or text_token(p, t) not in texts]
