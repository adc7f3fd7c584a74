"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: its block elements, each by its path and
classes, and its blocks of text. Over the distinct pages of a host, tokens that
occur equally often in every page form an equivalence class. A class is valid
if most of the host's pages have it and it stands in the same order in them;
valid classes nest where each element's enclosing one is in one too, and
these are the host's template: its elements are slots, its texts are the same on
every page.

What fills the slots tells them apart: the main slot is that which has the
largest share of the pages' running text. A page's own text is what fills the main slot,
the headings of the elements around it, and that element's other slots where the slot is in an article or
main, else those of lists, tables and headings beside it. Texts of the template that stand between such
texts of the page's own are part of it (the headings of a recipe, the questions
of a form of answers), and so are those after the last one in an article or
main, unless they are in an element of a class that has nothing of the page's
own. Others of its texts, such as a notice before the first, and other slots (menus, adverts, reader comments,
footers, whatever they are called) are left out. Where a host has too few pages
for a template, the page's own markup decides.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from seasight.llm.common import cut, pieces, table

#: Distinct pages of a host from which a template is deduced, and the share of them that has its classes.
LEAST_PAGES, SHARE = 5, 0.8
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_SKIP = frozenset("nav footer aside form head button select option input object canvas dialog audio video map menu datalist fieldset".split()) | _RAW
_MAIN = frozenset(["article", "main"])
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of running text, which stand in something that holds a text.
_FLOW = _HEADING | frozenset("p ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption".split())
#: Words of a class, id or role that name what isn't main text: for what no template has, and for what fills a main slot.
_ROLES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog disqus footer gdpr masthead menu modal nav navbar navigation newsletter "
    "notice notices pagination popup promo promotion related replies search share sharing sidebar social sponsor sponsored subscribe toolbar widget widgets".split()
)
_CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>]+)))?")


def _attributes(attrs: str) -> dict[str, str]:
    """Values by name in lower case; of a repeated name the first counts, and one without a value has an empty one."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _named(attrs: dict[str, str]) -> bool:
    """Whether an element is hidden, or its class, id or role say that it isn't main text."""
    if "hidden" in attrs or attrs.get("aria-hidden", "").strip().lower() == "true":
        return True
    for name in " ".join(attrs.get(x, "") for x in ("class", "id", "role")).lower().split():
        parts = re.split(r"[-_]+", name)
        if (parts[0] in _ROLES or parts[-1] in _ROLES) and not {"no", "not", "has", "with", "without"} & set(parts):
            return True
    return False


def _classes(attrs: dict[str, str]) -> str:
    return "".join(f".{x}" for x in attrs.get("class", "").split())


def parse(page: str | None) -> tuple[list[tuple[int, str, bool, int]], list[list]]:
    """The page's blocks (element, text, aside, characters outside links) in order, and its distinct block elements.

    Aside is what the markup itself sets apart: menus, footers, forms, hidden
    elements, and what a class, id or role names. An element is [path, its
    parent's number or -1, in main, times, first place]; a place counts elements
    opened before.
    """
    src = page or ""
    out: list[tuple[int, str, bool, int]] = []
    elements: list[list] = [["", -1, False, 1, 0]]
    number: dict[str, int] = {"": 0}
    opened = 0
    stack: list[tuple[str, bool, int, bool]] = []  # name, aside, element, in main
    words: list[str] = []
    plain = [0]

    def flush() -> None:
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            out.append((stack[-1][2] if stack else 0, text, bool(stack) and stack[-1][1], min(plain[0], len(text))))
        plain[0] = 0

    def close(n: int) -> None:
        if any(x[0] not in _INLINE for x in stack[n:]):
            flush()
        del stack[n:]

    at = 0
    while at < len(src):
        m = _TOKEN.search(src, at)
        upto = m.start() if m else len(src)
        if upto > at:
            names = [x[0] for x in stack]
            if not stack or not stack[-1][1] or names[[x[1] for x in stack].index(True)] not in _INLINE:  # else set apart within a line
                words.append(part := html.unescape(src[at:upto]))
                plain[0] += 0 if "a" in names else len(part)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == name:
                    close(n)
                    break
                if stack[n][0] in ("article", "body") and name in _INLINE:
                    break
            continue
        if name == "br":
            words.append(" ")
            continue
        if name in _VOID:
            if name == "hr":
                flush()
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(src, at)
            at = end.end() if end else len(src)
            words.append(" " if name in ("iframe", "svg", "math") else "")
            continue
        if name not in _INLINE:
            if name in _CLOSES_P:  # an open paragraph ends here, with what is open inside it
                for n in range(len(stack) - 1, -1, -1):
                    if stack[n][0] == "p":
                        close(n)
                        break
                    if stack[n][0] not in _INLINE:
                        break
            ends = _CLOSED_BY.get(name)
            for n in range(len(stack) - 1, -1, -1) if ends else ():
                if stack[n][0] in ends:
                    close(n)
                    break
                if stack[n][0] in ("ul", "ol", "dl", "table", "select"):
                    break
            flush()
        skipped = bool(stack) and stack[-1][1]
        main = bool(stack) and stack[-1][3] or name in _MAIN
        attrs = _attributes(m[3] or m[6] or "") if name not in _WHOLE else {}
        skip = skipped or name in _SKIP or (name == "header" and not main) or _named(attrs)
        if m[3] and m[3].endswith("/"):
            continue
        at_element = stack[-1][2] if stack else 0
        if name not in _INLINE:
            path, parent = f"{elements[at_element][0]}/{name}{_classes(attrs)}", at_element
            opened += 1
            at_element = number.setdefault(path, len(elements))
            if at_element == len(elements):
                elements.append([path, parent, main, 0, opened])
            elements[at_element][3] += 1
        stack.append((name, skip, at_element, main))
    flush()
    return out, elements


def blocks(page: str | None) -> list[tuple[str, str, bool]]:
    """(path, text, in main) of the page's blocks that its markup doesn't set apart."""
    found, elements = parse(page)
    return [(elements[e][0], text, elements[e][2]) for e, text, aside, _ in found if not aside]


_WHOLE = _MAIN | {"html", "body"}


def _hash(text: str) -> int:
    x = xxh64_intdigest(text.encode("utf-8", "replace"))
    return x - (1 << 64) if x >= 1 << 63 else x


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


_BLOCK = pa.list_(pa.struct([("element", pa.int32()), ("token", pa.int64()), ("aside", pa.bool_()), ("plain", pa.int32())]))
_ELEMENT = pa.list_(pa.struct([("token", pa.int64()), ("up", pa.int32()), ("main", pa.bool_()), ("opens", pa.bool_()), ("heading", pa.bool_()), ("classed", pa.bool_()), ("flow", pa.bool_())]))
_TOKEN_OF_PAGE = pa.list_(pa.struct([("token", pa.int64()), ("up", pa.int64()), ("depth", pa.int32()), ("n", pa.int32()), ("pos", pa.int32())]))
_READ = (
    "host string, page_key long, texts array<string>, blocks array<struct<element:int,token:long,aside:boolean,plain:int>>, elements array<struct<token:long,up:int,main:boolean,opens:boolean,heading:boolean,classed:boolean,flow:boolean>>, "
    "tokens array<struct<token:long,up:long,depth:int,n:int,pos:int>>"
)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, 256):
        keys, texts_of, blocks_of, elements_of, tokens_of = [], [], [], [], []
        for value in b.column("html"):
            found, elements = parse(value.as_py())
            of = [_hash(x[0]) for x in elements]
            own = [_hash(f"{elements[e][0]}\n{text}") for e, text, _, _ in found]
            depth = [0]
            for x in elements[1:]:  # a parent comes before its children
                depth.append(depth[x[1]] + 1)
            tokens = {of[i]: [of[i], of[up], depth[i], n, pos] for i, (_, up, _, n, pos) in enumerate(elements) if i}
            for (e, *_), token in zip(found, own):
                tokens.setdefault(token, [token, None, depth[e] + 1, 0, elements[e][4]])[3] += 1
            texts_of.append([x[1] for x in found])
            blocks_of.append([{"element": e, "token": t, "aside": aside, "plain": n} for (e, _, aside, n), t in zip(found, own)])
            names = [x[0].rsplit("/", 1)[-1].split(".")[0] for x in elements]
            elements_of.append([{"token": of[i], "up": x[1], "main": x[2], "opens": names[i] in _MAIN, "heading": names[i] in _HEADING, "classed": "." in x[0].rsplit("/", 1)[-1], "flow": names[i] in _FLOW} for i, x in enumerate(elements)])
            tokens_of.append([dict(zip(("token", "up", "depth", "n", "pos"), x)) for x in tokens.values()])
            keys.append(_hash("\n".join([*(f"{x[0]} {x[3]}" for x in elements), *(x[1] for x in found)])))
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), b.column("host"), pa.array(keys, pa.int64()), pa.array(texts_of, pa.list_(pa.string())), pa.array(blocks_of, _BLOCK), pa.array(elements_of, _ELEMENT), pa.array(tokens_of, _TOKEN_OF_PAGE)],
            names=["page_id", "url", "host", "page_key", "texts", "blocks", "elements", "tokens"],
        )


def slots_of(elements: list[dict], template: set[int]) -> list[int]:
    """For every element the innermost element of the template around it, itself included; 0 is the page."""
    slot: list[int] = []
    for i, e in enumerate(elements):
        slot.append(i if i and e["token"] in template else slot[e["up"]] if i else 0)
    return slot


def shares(found: list[dict], elements: list[dict], template: set[int]) -> dict[int, int]:
    """By slot's token, thousandths of the page's running text: not aside, not in links, not the template's own."""
    slot, sums = slots_of(elements, template), {}
    for x in found:
        if not x["aside"] and x["token"] not in template:
            token = elements[slot[x["element"]]]["token"]
            sums[token] = sums.get(token, 0) + x["plain"]
    total = sum(sums.values())
    return {t: n * 1000 // total for t, n in sums.items()} if total else {}


def fill(found: list[dict], elements: list[dict], template: set[int], main_slot: int | None) -> tuple[list[int], int, int]:
    """What a page fills its host's main slot with: the blocks' numbers, the slots they are from, blocks dropped by the template.

    A page without the main slot, or a host without a template (main_slot
    None), goes by its own markup: what is in an article or main, or all if
    there is none, less the template's texts that aren't part of an article.
    """
    slot = slots_of(elements, template)
    at = next((i for i, e in enumerate(elements) if e["token"] == main_slot and slot[i] == i), None) if main_slot is not None else None
    if at is None:
        free = [i for i, x in enumerate(found) if not x["aside"]]
        marked = [i for i in free if elements[found[i]["element"]]["main"]]
        own = marked or free
        kept = _own(found, elements, template, own, set(marked), bool(marked))
        return kept, len({slot[found[i]["element"]] for i in kept}), len(own) - len(kept)
    around, i = {at}, at
    while i:
        i = elements[i]["up"]
        around.add(i)
    inner = at  # the innermost article or main around the slot; 0 if there is none
    while inner and not elements[inner]["opens"]:
        inner = elements[inner]["up"]
    root = inner or at
    while not inner and elements[root]["flow"]:
        root = elements[root]["up"]
    good = set()
    for n in {slot[x["element"]] for x in found}:
        up = n
        while up and up != root and (inner or elements[up]["flow"]):
            up = elements[up]["up"]
        inside = up == root > 0
        # another slot: of the same article or main, or the heading of an element around the main slot
        if n == at or inside or (elements[n]["heading"] and slot[elements[n]["up"]] in around):
            good.add(n)
    own, gone = [], 0
    for i, x in enumerate(found):
        e, n = elements[x["element"]], slot[x["element"]]
        # also an article or main of the page's own, inside what is around the main slot
        if n not in good and not (e["main"] and n in around):
            gone += 1
        elif not x["aside"]:
            own.append(i)
    under = [i == root for i in range(len(elements))]
    for i in range(1, len(elements)):
        under[i] = under[i] or under[elements[i]["up"]]
    kept = _own(found, elements, template, own, {i for i in own if under[found[i]["element"]]}, inner > 0)
    return kept, len({slot[found[i]["element"]] for i in kept}), gone + len(own) - len(kept)


def _own(found: list[dict], elements: list[dict], template: set[int], among: list[int], whole: set[int], article: bool) -> list[int]:
    """Of the blocks ``among``, those not the template's, and its texts that are part of the ``whole``: between the page's own, or after them in an article in an element that has something of the page's own, or is of no class."""
    own = [i for i in among if found[i]["token"] not in template]
    run = [i for i in own if i in whole]
    if not run:
        return own
    varied = {found[i]["element"] for i in run}

    def stays(i: int) -> bool:
        e = found[i]["element"]
        return i in whole and (run[0] < i < run[-1] or (article and i > run[-1] and (e in varied or not elements[e]["classed"])))

    return [i for i in among if found[i]["token"] not in template or stays(i)]


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, slot, n: every page's ``shares``."""
    for b in batches:
        hosts, slots, n = [], [], []
        for host, found, elements, template in zip(*(b.column(c) for c in ("host", "blocks", "elements", "template"))):
            own = shares(found.as_py(), elements.as_py(), set(template.as_py()))
            hosts += [host.as_py()] * len(own)
            slots += own.keys()
            n += own.values()
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(slots, pa.int64()), pa.array(n, pa.int64())], names=["host", "slot", "n"])


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, slots, dropped = [], [], []
        for own, found, elements, template, main in zip(*(b.column(c) for c in ("texts", "blocks", "elements", "template", "main_slot"))):
            kept, n, gone = fill(found.as_py(), elements.as_py(), set(template.as_py() or ()), main.as_py())
            texts.append("\n\n".join(own[i].as_py() for i in kept))
            slots.append(n)
            dropped.append(gone)
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(slots, pa.int64()), pa.array(dropped, pa.int64())],
            names=["page_id", "url", "text", "n_chars", "n_slots", "n_template"],
        )


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars, n_slots (that the text is from), n_template (blocks that the template drops).

    A host has a template if it has ``least_pages`` distinct pages or more; its
    tokens are in at least ``share`` of them, as often in each. Equal pages count
    as one. Elements that a page has beside the template count for the slot
    around them. Of slots with equal shares the one with the smaller token is
    the main slot. Null or empty html gives an empty text; a null
    or odd url makes a host of its own kind; repeated rows each give a row, and
    an empty table gives an empty result.
    """
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    kind = p.schema["page_id"].dataType.simpleString()
    read = cut(p.mapInArrow(_read, f"page_id {kind}, url string, {_READ}"))
    # tables of their own: their sizes are known before the joins, which send them to all tasks if they are small and split hot hosts if not
    templates = cut(host_templates(read, least_pages, share))
    votes = read.select("host", "blocks", "elements").join(templates, "host").mapInArrow(_vote, "host string, slot long, n long")
    votes = votes.groupBy("host", "slot").agg(F.sum("n").alias("n")).groupBy("host").agg(F.max_by("slot", F.struct("n", -F.col("slot"))).alias("main_slot"))
    templates = cut(templates.join(votes, "host", "left"))
    filled = read.select("page_id", "url", "host", "texts", "blocks", "elements").join(templates, "host", "left").drop("host")
    return filled.mapInArrow(_write, f"page_id {kind}, url string, text string, n_chars long, n_slots long, n_template long")


def host_templates(read: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """host, template: the tokens of the valid, nested equivalence classes of each host."""
    counts = read.select("host", "page_key", F.explode("tokens").alias("t")).select("host", "page_key", "t.*").dropDuplicates(["host", "page_key", "token"])
    sizes = read.select("host", "page_key").distinct().groupBy("host").agg(F.count("*").alias("n_pages")).filter(F.col("n_pages") >= least_pages)
    # of a token: the pages that have it, and its occurrence vector, as a sum without order over page and count
    vectors = counts.groupBy("host", "token").agg(
        F.count("*").alias("support"), F.bit_xor(F.xxhash64("page_key", "n")).alias("vector"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("up").alias("up"), F.min("depth").alias("depth")
    )
    wide = cut(vectors.join(sizes, "host").filter((F.col("support") >= share * F.col("n_pages")) & (F.col("least") == F.col("most"))).select("host", "token", "vector", "up", "depth"))
    # a class stands in the same order in every page that has it
    ordered = counts.select("host", "page_key", "token", "pos").join(wide.select("host", "token", "vector"), ["host", "token"]).groupBy("host", "vector", "page_key").agg(F.hash(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"])).alias("order"))
    valid = ordered.groupBy("host", "vector").agg(F.min("order").alias("a"), F.max("order").alias("b")).filter("a = b").select("host", "vector")
    # from the outside in: a token is nested if the element around it is; a host's tokens are about those of one page
    tokens = wide.join(valid, ["host", "vector"]).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("depth", "token", "up"))).alias("x"))
    nested = F.aggregate("x", F.expr("cast(array() as array<bigint>)"), lambda got, x: F.when((x["depth"] == 1) | x["up"].isNull() | F.array_contains(got, x["up"]), F.concat(got, F.array(x["token"]))).otherwise(got))
    return tokens.select("host", nested.alias("template"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
