"""HTML main text by equivalence classes: tokens with the same occurrence vector over a host's pages make its template.

A token is a tag with its telling attributes, or a whole run of text. Its occurrence vector (how often it occurs on each page)
is never built: an XOR of hashes of (page, count) with the number of pages and occurrences stands for it, so hosts of any size are
counted by plain partial aggregation. Tokens of equal vectors on most pages make a class; a class is valid if its tokens stand
together in the same page, and is nested in the slot of the surrounding class that holds all of it. Template text is left out, in
articles too; what remains in article and main elements, or without such in slots that are not mostly links, outside menus, adverts,
forms and the like, is the text.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import extended, in_batches
from terrasift.llm.urls import host
from terrasift.session import cut

TAG_SHARE, TEXT_SHARE, LEAST_PAGES = 0.5, 0.9, 8
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header
    hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul""".split())
#: Parts that belong to the list or table around them, and those; a constant label in a list of other texts is no template.
PARTS = set("li dd dt tr td th caption tbody thead tfoot option hgroup figcaption summary legend".split())
HELD = set("ul ol dl table menu select".split())
APART = set("head script style title noscript template nav footer aside form button select textarea iframe svg object canvas audio video dialog menu xmp noembed noframes".split())
#: Words of a class or id that mark what is no part of the article.
MARKS = set("""ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert alerts popup modal
    overlay newsletter subscribe subscription signup sidebar aside menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead toolbar share sharing
    social related recommended recommendations trending comment comments commentlist disqus respond reply replies widget widgets login search skip""".split())
OUTSIDE, ARTICLE, MARKED, SPARE = range(4)
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw.strip() else {}


def tokens(html: str):
    """(kind, name, attributes or text) in page order; kind is open, close, text or note. Raw elements' contents are left out."""
    at = 0
    while at < len(html):
        m = _TOKEN.search(html, at)
        if m is None:
            break
        if m.start() > at:
            yield "text", "", html[at : m.start()]
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            yield "note", "", re.sub(r"\d+", "#", m[0])
        elif m[1] or m[4]:
            yield "close", name, ""
        else:
            raw = m[3] if m[2] else m[6]
            yield "open", name, raw
            if name in RAW and not raw.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b", re.I).search(html, at)
                at = end.start() if end else len(html)
    if at < len(html):
        yield "text", "", html[at:]


def key(kind: str, name: str, rest: str) -> int | None:
    """64-bit name of a token; white space is none."""
    if kind == "text":
        rest = " ".join(entities.unescape(rest).split())
        if not rest:
            return None
    elif kind == "open":
        a = attributes(rest)
        rest = "|".join(f"{k}={a[k]}" for k in ("class", "id", "role") if k in a)
    return int.from_bytes(hashlib.blake2b(f"{kind[0]}{name}|{rest}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def vectors(pages: DataFrame) -> DataFrame:
    """(host, token, is_text, page, n, pos) of every distinct token of every page (host, page, html)."""

    def work(batches):
        for b in batches:
            rows: list[tuple] = []
            for h, page, html in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                seen: dict[int, list[int]] = {}
                for pos, (kind, name, rest) in enumerate(tokens(html)):
                    k = key(kind, name, rest)
                    if k is not None:
                        seen.setdefault(k, [0, pos, kind == "text"])[0] += 1
                rows += [(h, k, t, page, n, pos) for k, (n, pos, t) in seen.items()]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["host", "token", "is_text", "page", "n", "pos"])

    return in_batches(pages, work, "host string, token long, is_text boolean, page long, n long, pos long")


def templates(pages: DataFrame) -> DataFrame:
    """(host, root, texts): the template's tokens that occur once on every page, in order, and its constant texts.

    The tokens of a host that are on most of its pages are at most a few times those of one page, so they meet in one task.
    """
    per = vectors(pages).groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"),
        F.min(F.struct("page", "pos")).alias("first"), F.bool_and("is_text").alias("is_text"))
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("all"))
    usual = per.join(sizes, "host").filter((F.col("all") >= LEAST_PAGES) & (F.col("pages") >= F.when(F.col("is_text"), TEXT_SHARE).otherwise(TAG_SHARE) * F.col("all")))

    def nest(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        classes: dict[tuple, list[dict]] = {}
        for r in rows:
            classes.setdefault((r["vector"], r["pages"], r["total"]), []).append(r)
        valid = [sorted(c, key=lambda r: (r["first"]["pos"], r["token"])) for c in classes.values() if len({r["first"]["page"] for r in c}) == 1]
        roots = [c for c in valid if c[0]["pages"] == c[0]["all"] == c[0]["total"]]
        root = max(roots, key=len, default=[])
        edges = [r["first"]["pos"] for r in root]

        def slot(r):
            return sum(e < r["first"]["pos"] for e in edges) if not root or r["first"]["page"] == root[0]["first"]["page"] else None

        nested = [c for c in valid if c is root or len({slot(r) for r in c}) == 1]
        texts = sorted({r["token"] for c in nested for r in c if r["is_text"]})
        return pa.table({"host": [rows[0]["host"]], "root": pa.array([[r["token"] for r in root]], pa.list_(pa.int64())), "texts": pa.array([texts], pa.list_(pa.int64()))})

    return usual.groupBy("host").applyInArrow(nest, "host string, root array<long>, texts array<long>")


def _apart(name: str, a: dict[str, str], inside: int) -> int:
    """2: the element and all in it are no part of the article. 1: so it seems by a class, an id or a form, unless it holds an article.

    ``inside``: 0 in neither, 1 in a main, 2 in an article element, where 1 is as good as 2. A class or id counts only as a whole:
    cookie-banner is made of marks, has-sidebar is not.
    """
    if (name in APART and name != "form") or (name == "header" and not inside) or "hidden" in a or (a.get("role", "").lower() in ROLES - {"form"}):
        return 2
    if name in ("html", "body", "main"):
        return 0
    marked = name == "form" or a.get("role", "").lower() == "form"
    for c in f"{a.get('class', '')} {a.get('id', '')}".split():
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", c).lower()) if w]
        marked |= bool(words) and MARKS.issuperset(words)
        if "header" in words and not inside and MARKS.union(("header", "site", "page")).issuperset(words):
            marked = True
    return (2 if inside == 2 else 1) if marked else 0


def main_text(html: str, root: list[int] | None = None, texts: list[int] | None = None) -> str:
    """The article's blocks, joined by newlines. ``root`` and ``texts``: the host's template.

    In an article, an element (a list or table as a whole) of nothing but constant texts is template; constant words in a varying
    element are part of it. An article of constant texts alone is kept, since the host's pages are copies then.

    Marks never drop an article that is in no other: one that is marked, or stands in a marked element or a form, is left out only
    where the unmarked articles have at least as much text. What else is marked is taken only on pages without any other text.
    """
    order, constant = {k: i for i, k in enumerate(root or [])}, set(texts or [])
    stack: list[tuple] = []  # name, apart, inside a main (1) or article (2), marked article, element of its own, whether that is a list or table
    blocks: list[list] = []  # group, slot, text, text in links, element
    varying: set[int] = set()  # elements with text that is not constant
    now: list[list] = []
    slot = links = elements = 0

    def close_block():
        nonlocal now
        for group in (OUTSIDE, ARTICLE, MARKED, SPARE):
            part = [x for x in now if x[0] == group]
            text = " ".join(entities.unescape("".join(x[2] for x in part)).split())
            if text:
                linked = " ".join(entities.unescape("".join(x[2] for x in part if x[3])).split())
                blocks.append([group, part[0][1], text, len(linked), part[0][4]])
                if any(x[5] for x in part):
                    varying.add(part[0][4])
        now = []

    def pop(to: int):
        nonlocal links
        for name, *_ in stack[to:]:
            links -= name == "a"
        del stack[to:]

    def end(names: set[str], stop: set[str]):
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                return pop(i)
            if stack[i][0] in stop:
                return None
        return None

    for kind, name, rest in tokens(html):
        k = key(kind, name, rest) if kind != "text" or constant else None
        if k in order and order[k] >= slot:
            slot = order[k] + 1
        if kind == "text":
            apart, inside, marked, element = stack[-1][1:5] if stack else (0, 0, False, 0)
            group = SPARE if apart else MARKED if marked else ARTICLE if inside else OUTSIDE
            if apart < 2 and (group in (ARTICLE, MARKED) or k not in constant):
                now.append((group, slot, rest, links > 0, element, bool(rest.strip()) and k not in constant))
        elif kind == "open":
            if name in BLOCK:
                close_block()
                end({"p"}, {"article", "main", "section", "div", "td", "th", "li", "blockquote", "button"})
                if name in ("li", "dd", "dt", "tr", "td", "th", "option"):
                    end({"dd", "dt"} if name in ("dd", "dt") else {"td", "th"} if name in ("td", "th") else {name}, {"ul", "ol", "dl", "table", "select", "menu"} | ({"tr"} if name in ("td", "th") else set()))
            elif name == "br":
                now.append((*(now[-1][:2] if now else (OUTSIDE, slot)), " ", False, now[-1][4] if now else stack[-1][4] if stack else 0, False))
            if name not in VOID and not rest.rstrip().endswith("/"):
                above = stack[-1] if stack else ("", 0, 0, False, 0, False)
                a = attributes(rest)
                role = a.get("role", "").lower()
                inside = 2 if name == "article" or role == "article" else max(above[2], 1) if name == "main" or role == "main" else above[2]
                inside, marked, apart = max(inside, above[2]), above[3], max(above[1], _apart(name, a, above[2]))
                if inside > above[2] and apart == 1:
                    marked, apart = True, 0
                if name in BLOCK and name not in PARTS and not above[5]:
                    elements += 1
                    own = (elements, name in HELD)
                else:
                    own = above[4:]
                stack.append((name, apart, inside, marked, *own))
                links += name == "a"
        elif kind == "close":
            if name in BLOCK:
                close_block()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
                if stack[i][0] in ("article", "main", "body") and name not in BLOCK:
                    break
    close_block()
    length = {g: sum(len(b[2]) for b in blocks if b[0] == g) for g in (ARTICLE, MARKED)}
    wanted = (ARTICLE, MARKED) if length[MARKED] > length[ARTICLE] else (ARTICLE,)
    found = [b for b in blocks if b[0] in wanted]
    if found:
        left = [b for b in found if b[4] in varying]
        return "\n".join(b[2] for b in left or found)
    # no article element: the slots whose text is not mostly links
    for group in (OUTSIDE, SPARE):
        size: dict[int, list[int]] = {}
        rest = [b for b in blocks if b[0] == group]
        for _, s, t, linked, _ in rest:
            x = size.setdefault(s, [0, 0])
            x[0] += len(t)
            x[1] += linked
        text = "\n".join(t for _, s, t, *_ in rest if 2 * size[s][1] <= size[s][0])
        if text:
            return text
    return ""


def extract(pages: DataFrame, *, id: str = "page_id", url: str = "url", html: str = "html", small: int = 8 << 20) -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    A null page is empty and has the empty text. Hosts of fewer than LEAST_PAGES pages have no template, so there only the
    elements decide; null urls share the empty host. Unclosed paragraphs, list items and cells end where the next begins.
    Templates up to ``small`` bytes are broadcast, larger ones are joined by host.
    """
    rows = pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"), host(F.col(url)).alias("host"))
    found = cut(templates(rows.select("host", F.xxhash64("page_id", "url").alias("page"), "html")))
    held = found.agg(F.sum(8 * (F.size("root") + F.size("texts")) + F.octet_length("host"))).first()[0] or 0
    joined = rows.join(F.broadcast(found) if held <= small else found, "host", "left").select("page_id", "url", "html", "root", "texts")

    def work(batches):
        for b in batches:
            out = [main_text(h, r, t) for h, r, t in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return in_batches(joined, work, extended(rows.select("page_id", "url"), "text string, n_chars long"))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
