"""Main text of web pages by template deduction over pages of one host.

Tokens (tags with their path, and words) that occur equally often on each page
of a group form equivalence classes. Classes whose tokens keep their order and that
nest in one another are the template; what lies between their tokens is a slot. Slots
of the article are the text; words of the template and slots of menus, adverts,
notices, forms, comments and the like are not.
"""

from __future__ import annotations

import html as entities
from bisect import bisect
from collections import Counter, defaultdict
from itertools import chain, count, pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cache, read, small_batches

#: Pages that one template is deduced from, pages of a host dealt to one place, hosts that may be dealt to several, and pages of a task on average: bounds on memory and time, not on pages.
GROUP, DEALT, MOST_HOT, TASK = 64, 128, 65_536, 2048
#: Share of an article's words that are template, beyond which it is taken for a near copy of other articles.
COPIED = 0.8

#: Element names by what they mean.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
RAW = "script|style|noscript|template|textarea|title|iframe|svg|noembed|noframes|xmp"
NOT_TEXT = frozenset("nav footer aside form head button select dialog menu search datalist canvas audio video map".split())
NOT_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
NOT_TEXT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay "
    "newsletter subscribe subscription signup paywall sidebar sidebars widget widgets related recommended recommendations share sharing social side breadcrumb breadcrumbs menu menus nav navbar navigation "
    "footer header masthead topbar comment comments commentlist respond disqus reply replies discussion login search toolbar skip pagination pager copyright disclaimer".split()
)
#: Those of them that, as a class or a whole id, name no part of an article's subject.
SURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense adsbygoogle sponsored gdpr newsletter signup paywall breadcrumb breadcrumbs navbar comment comments commentlist respond disqus "
    "pagination pager topbar share sharing popup popups modal sidebar sidebars widget widgets toolbar".split()
)
#: Names that, where a page marks no article, may be those of its text: such an element goes only if no more of its words are plain than in links.
OPEN_NAMES = frozenset("discussion related recommended recommendations search reply replies skip overlay social widget widgets".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of the first kind ends where one of the second begins.
ENDS = {"p": BLOCKS - {"option", "optgroup", "td", "th"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}


def _tags(attributes: str, else_: str) -> regex.Pattern:
    """Comments, elements whose content is no markup, tags, and what a browser drops as a broken tag. Nothing is matched twice, so a page takes time in proportion to its length."""
    return regex.compile(
        rf"<!--.*?(?:-->|$)|<(?P<raw>{RAW})\b{attributes}(?:>.*?(?:</(?P=raw)[^>]*+(?:>|$)|$))|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>{attributes})>|{else_}|<[!?/][^>]*+(?:>|$)",
        regex.S | regex.I,
    )


#: Tags with quoted values, where a quote elsewhere is a sign like any other; from the first one whose quotes don't close, tags end at the next ">".
QUOTED = _tags(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+", r"(?P<broken></?[a-zA-Z])")
PLAIN = _tags(r"[^>]*+", r"(?P<broken></?[a-zA-Z][^>]*+$)")
ATTRIBUTE = regex.compile(r"""([^\s=/"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
WORDS = regex.compile(r"[^\W_]+")
#: An address says nothing of its element.
HREF = regex.compile(r""" href=(?:"[^"]*+"|'[^']*+')""")
#: An element whose end may be implied ends where one of these begins.
ENDING = frozenset().union(*ENDS.values())


CAMEL, LETTERS = regex.compile(r"([a-z])([A-Z])"), regex.compile(r"[a-z]+")


def _name_parts(value: str) -> frozenset:
    return frozenset(LETTERS.findall(CAMEL.sub(r"\1 \2", value).lower())) if value else frozenset()


class Element:
    """What a start tag says of its element."""

    def __init__(self, tag: str):
        m = ELEMENT.match(tag)
        self.name, rest = m["name"].lower(), m["rest"]
        attributes = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(rest)} if rest else {}
        classes, ids = _name_parts(attributes.get("class", "")), _name_parts(attributes.get("id", ""))
        self.label = self.name + (f".{attributes['class']}" if attributes.get("class") else "")
        self.names = classes | ids
        self.hits = self.names & NOT_TEXT_NAMES
        self.sure = bool(classes & SURE_NAMES or ids & SURE_NAMES and ids <= NOT_TEXT_NAMES)  # named as what is no text wherever it stands
        role = attributes.get("role", "").lower()
        hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        self.skip = self.name in NOT_TEXT or role in NOT_TEXT_ROLES or hidden  # by its own name or role
        self.block, self.ending, self.heading, self.link = self.name in BLOCKS, self.name in ENDING, self.name in HEADINGS, self.name in ("a", "button")
        self.main = (self.name == "article" and "comment" not in self.names) or self.name == "main" or role == "main"
        self.open = self.name not in VOID and (not rest.rstrip().endswith("/") or self.block)


ELEMENT = regex.compile(r"<(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>.*)>", regex.S)
ROOT = Element("<html>")


class Page:
    """Elements (number 0 holds all), text runs and block boundaries in page order."""

    def __init__(self) -> None:
        self.nodes: list[Element] = [ROOT]
        self.parents, self.paths = [-1], [0]
        self.runs: list[tuple[int, str]] = []  # (element, text)
        self.breaks: list[int] = []  # numbers of runs before which a block begins or ends
        self.events: list[tuple[int, int]] = []  # (number of runs before it, path of a tag; -1 - path at its end)


def parse(source: str | None, elements: Cache | None = None, paths: dict | None = None) -> Page:
    """The page's elements, text runs and block boundaries. Lenient: unclosed and stray tags are taken as browsers mostly do.

    ``elements`` and ``paths`` hold what start tags say and the numbers of paths, for pages that are compared.
    """
    elements, paths = Cache(Element, 20_000, 256) if elements is None else elements, {} if paths is None else paths
    page, text, at = Page(), source or "", 0
    nodes, runs, breaks, events = page.nodes, page.runs, page.breaks, page.events
    stack, blocks, open_names = [0], [], Counter()  # blocks: places on the stack of those that are blocks
    found, tags = QUOTED.finditer(text), QUOTED
    while (m := next(found, None)) is not None:
        begin = m.start()
        if begin > at:
            runs.append((stack[-1], text[at:begin]))
        at = m.end()
        kind = m.lastgroup
        if m["broken"]:
            if tags is QUOTED:
                tags, at = PLAIN, begin
                found = PLAIN.finditer(text, begin)
            continue
        if m["raw"] or kind is None:
            continue
        if m["end"]:
            name = m["name"].lower()
            if open_names[name]:
                block = False
                while True:
                    node = stack.pop()
                    if nodes[node].block:
                        block = True
                        blocks.pop()
                    open_names[nodes[node].name] -= 1
                    if nodes[node].name == name:
                        break
                if block:
                    breaks.append(len(runs))
                events.append((len(runs), -1 - page.paths[node]))
            elif name in BLOCKS:
                breaks.append(len(runs))
            continue
        tag = m[0]
        e = elements[HREF.sub("", tag, 1) if tag.startswith("<a href") else tag]
        if e.ending:  # elements whose end is implied, which are blocks
            while blocks and e.name in ENDS.get(nodes[stack[blocks[-1]]].name, ()):
                depth = blocks.pop()
                open_names.subtract([nodes[i].name for i in stack[depth:]])
                del stack[depth:]
                breaks.append(len(runs))
        if e.block:
            breaks.append(len(runs))
        if e.name == "br":
            runs.append((stack[-1], " "))
        if e.name in VOID:
            continue
        parent, node = stack[-1], len(nodes)
        nodes.append(e)
        page.parents.append(parent)
        page.paths.append(paths.setdefault((page.paths[parent], e.label), len(paths) + 1))
        events.append((len(runs), page.paths[node]))
        if e.open:
            if e.block:
                blocks.append(len(stack))
            stack.append(node)
            open_names[e.name] += 1
    if at < len(text):
        runs.append((stack[-1], text[at:]))
    page.runs = [(node, entities.unescape(x) if "&" in x else x) for node, x in runs]
    return page


def _words_under(page: Page, words: list[list[str]]) -> tuple[list[int], list[int], list[bool]]:
    """Words in and outside links under each element, and whether it holds a heading."""
    parents, linked = page.parents, [False]
    for node, parent in zip(page.nodes[1:], parents[1:], strict=True):
        linked.append(linked[parent] or node.link)
    plain, links, headed = [0] * len(parents), [0] * len(parents), [False] * len(parents)
    for (node, _), found in zip(page.runs, words, strict=True):
        (links if linked[node] else plain)[node] += len(found)
    for i in range(len(parents) - 1, 0, -1):
        plain[parents[i]] += plain[i]
        links[parents[i]] += links[i]
        headed[parents[i]] |= headed[i] or page.nodes[i].heading
    return plain, links, headed


def skipped(page: Page, words: list[list[str]]) -> list[bool]:
    """Whether an element, or one around it, is a menu, header, footer, sidebar, notice, advert, form, comment or hidden. words: those of each run.

    In an article a name may be that of its subject: headings and what is around them stay
    whatever their names, and an element whose name isn't sure goes only if no more of its words are
    plain than in links. What repeats in it is for the template. On a page that marks no article the same holds of elements whose names are
    all open ones, or have "side" among others.
    """
    nodes, parents = page.nodes, page.parents
    holds_main = [False] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        if (nodes[i].main or holds_main[i]) and not nodes[i].names & {"comment", "comments"}:
            holds_main[parents[i]] = True
    # of the words under each element, which only names ask for
    unmarked = not any(holds_main) and not any(node.main for node in nodes)
    plain, links, headed = _words_under(page, words) if any(node.hits for node in nodes) else ([], [], [])
    out, inside = [False], [False]
    for i in range(1, len(nodes)):
        node, parent = nodes[i], parents[i]
        named = bool(node.hits) and node.name not in ("html", "body", "main", "article") and not holds_main[i]
        if named and inside[parent]:
            heading = node.heading or headed[i] and node.hits <= {"header", "masthead", "banner"}
            named = not heading and (node.sure or plain[i] <= links[i])
        elif named and unmarked and (node.hits <= OPEN_NAMES or node.hits == {"side"} < node.names):
            named = plain[i] <= links[i]
        header = node.name == "header" and not inside[parent]
        out.append(out[parent] or node.skip or named or header)
        inside.append(inside[parent] or (node.main and not out[i]))
    return out


def main_nodes(page: Page, skip: list[bool]) -> list[bool]:
    """Whether an element is in the article, else in the main part; all False if the page marks neither."""
    for wanted in (lambda n: n.main and n.name == "article", lambda n: n.main):
        out = [False]
        for i, node in enumerate(page.nodes[1:], 1):
            out.append(not skip[i] and (out[page.parents[i]] or wanted(node)))
        if any(out):
            return out
    return [False] * len(page.nodes)


def equivalence_classes(pages: list[list], least_pages: int = 2) -> dict[tuple[int, ...], list]:
    """Tokens by their occurrence vector (how often on each page), where at least half of the pages, and ``least_pages``, have them."""
    counts = [Counter(tokens) for tokens in pages]
    seen = Counter(chain.from_iterable(counts))
    classes: dict[tuple[int, ...], list] = defaultdict(list)
    for t, n in seen.items():
        if n >= max(least_pages, len(pages) / 2):
            classes[tuple([c[t] for c in counts])].append(t)
    return classes


def template(pages: list[list]) -> list:
    """Tokens of the template: those of the root class in their order, then those of the classes nested in its gaps, then those nested in theirs.

    A class is valid if its tokens come in the same order on every page that has
    them, and if between two tokens of the classes found before it each page has all of the
    class's tokens equally often; a class of one token only if all pages have it, in
    the same gaps and equally often. Tokens that break this are data.
    """
    classes = equivalence_classes(pages)
    once = {t for v, ts in classes.items() if max(v) == 1 for t in ts}
    places = [{t: i for i, t in enumerate(tokens) if t in once} for tokens in pages]
    root: list = []
    rank: list[list[int]] = [[] for _ in pages]  # places on the page of the root's tokens, in order
    order: list[list] = [[] for _ in pages]
    at: dict = {}
    # large classes that most pages have come first, so that a word that is there by chance displaces none of theirs
    for v in sorted((v for v in classes if max(v) == 1), key=lambda v: (-sum(v), -len(classes[v]))):
        if len(classes[v]) == 1 and 0 in v:
            continue  # a lone word that some pages lack is data
        for t in sorted(classes[v], key=places[v.index(1)].__getitem__):
            where = [(k, bisect(rank[k], places[k][t])) for k, n in enumerate(v) if n]
            low = max((at[order[k][i - 1]] for k, i in where if i), default=-1)
            high = min((at[order[k][i]] for k, i in where if i < len(order[k])), default=len(root))
            if low < high:
                root.insert(low + 1, t)
                at.update((x, i) for i, x in enumerate(root[low + 1 :], low + 1))
                for k, i in where:
                    rank[k].insert(i, places[k][t])
                    order[k].insert(i, t)
    out, fixed = list(root), set(root)
    rest = {t: v for v, ts in classes.items() if max(v) > 1 for t in ts}
    while rest:
        inner = _nested(pages, fixed, rest)
        if not inner:
            break
        out += inner
        fixed.update(inner)
        found = {rest[t] for t in inner}
        rest = {t: v for t, v in rest.items() if v not in found}
    return out


def _nested(pages: list[list], fixed: set, rest: dict) -> list:
    """Of the tokens of ``rest`` (by token their class), those of the valid classes in the gaps between tokens of ``fixed``."""
    profile: dict = {t: [] for t in rest}
    for k, tokens in enumerate(pages):
        gap, per = -1, Counter()
        for t in tokens:
            if t in fixed:
                gap = t
            elif t in rest:
                per[t, gap] += 1
        for (t, g), n in per.items():
            profile[t].append((k, g, n))
    alike: dict = defaultdict(lambda: defaultdict(list))
    for t, where in profile.items():
        alike[rest[t]][tuple(sorted(where, key=repr))].append(t)
    out = []
    for v, groups in alike.items():
        valid, members = max(groups.items(), key=lambda x: len(x[1]))
        if len(members) > 1 or len(groups) == 1 and 0 not in v and _agree(valid, len(pages)):
            out += members
    return out


def _agree(gaps: tuple, pages: int) -> bool:
    """Whether all pages have a token in the same gaps and equally often, by its (page, gap, count)."""
    return len(gaps) == pages * len({(g, n) for _, g, n in gaps})


def extract(sources: list[str | None], elements: Cache | None = None) -> list[str]:
    """The main text of each page of a group (pages of one host).

    A run of text is template if all its words are and it stands, as a whole, on half of the
    pages that differ. Pages with equal articles count as one, and an article of which
    over COPIED is template is a near copy of others and stays whole. Of two or three pages that differ, a run must stand on all, marked articles
    are taken as they are, and so is an unmarked page that is a near copy: so few say too little of what repeats in an article. One page has no template. elements: what is known of start tags.
    """
    paths: dict = {}
    pages = [parse(s, elements, paths) for s in sources]
    after = count(len(paths) + 1)
    numbers: defaultdict = defaultdict(lambda: defaultdict(after.__next__))  # of words by their path; tags have those up to the paths'
    words = [[WORDS.findall(text) for _, text in page.runs] for page in pages]
    skips = [skipped(p, w) for p, w in zip(pages, words, strict=True)]
    mains = [main_nodes(p, s) for p, s in zip(pages, skips, strict=True)]
    tokens, places, articles = [], [], []
    for page, main, found in zip(pages, mains, words, strict=True):
        marked = any(main)
        seq: list[int] = []
        place: list[tuple[int, int]] = []
        article: list[str] = []
        events = iter([*page.events, (len(page.runs) + 1, 0)])
        nxt = next(events)
        for r, (node, _) in enumerate(page.runs):
            while nxt[0] <= r:
                seq.append(nxt[1])
                nxt = next(events)
            begin, path = len(seq), page.paths[node]
            seq += map(numbers[path].__getitem__, found[r])
            place.append((begin, len(seq)))
            if marked and main[node]:
                article += found[r]
        tokens.append(seq)
        places.append(place)
        articles.append((marked, tuple(article if marked else seq)))
    different = list({a: k for k, a in enumerate(articles)}.values())  # copies of a page say nothing of its template
    known = set(template([tokens[k] for k in different])) if len(different) >= 2 else set()
    runs = Counter(chain.from_iterable({tuple(tokens[k][a:b]) for a, b in places[k] if known.issuperset(tokens[k][a:b])} for k in different)) if known else Counter()
    out, least = [], len(different) / 2 if len(different) >= 4 else len(different)
    for page, skip, main, seq, place in zip(pages, skips, mains, tokens, places, strict=True):
        marked = any(main)
        keep = [(main[node] or not marked) and not skip[node] for node, _ in page.runs]
        few = len(different) < 4
        if known and not (marked and few) and not ((marked or few) and _share(seq, place, keep, known) > COPIED):
            for r, (a, b) in enumerate(place):
                if b > a and keep[r] and known.issuperset(seq[a:b]) and runs[tuple(seq[a:b])] >= least:
                    keep[r] = False
        out.append(_blocks(page, keep))
    return out


def _share(seq: list[int], place: list[tuple[int, int]], keep: list[bool], known: set) -> float:
    """Share of the kept words that are template."""
    kept = list(chain.from_iterable(seq[a:b] for (a, b), k in zip(place, keep, strict=True) if k))
    return sum(map(known.__contains__, kept)) / max(1, len(kept))


def _blocks(page: Page, keep: list[bool]) -> str:
    edges = sorted({0, *page.breaks, len(page.runs)})
    lines = (" ".join("".join(page.runs[r][1] for r in range(a, b) if keep[r]).split()) for a, b in pairwise(edges))
    return "\n".join(x for x in lines if x)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def windows(rows: list) -> list[list]:
    """The rows in as few windows of at most GROUP as hold them, of equal sizes but for one row."""
    n = -(-len(rows) // GROUP)
    return [rows[len(rows) * k // n : len(rows) * (k + 1) // n] for k in range(n)]


def main_text(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text of each row of ``pages`` (page_id, url, html; other columns are ignored).

    Null or empty html has an empty text; a null or odd url counts as a host of
    its own name ''. Repeated rows stay. Pages of a host are dealt in
    groups of at most GROUP, in the order of their ids, the last two of equal size; a host with many pages is dealt to
    several tasks. Html moves once.
    """
    small_batches(spark)
    tagged = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    counts = tagged.groupBy("host").count()
    n = pages.count()
    # as they have over 1/65,536 of all pages each, these are that many hosts at most
    hot = counts.where(F.col("count") > max(DEALT, n // MOST_HOT)).select("host", F.ceil(F.col("count") / DEALT).alias("salts"))
    dealt = tagged.join(F.broadcast(hot), "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.coalesce("salts", F.lit(1))))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK))
    dealt = dealt.select("host", "salt", "page_id", "url", "html").repartition(parts, "host", "salt").sortWithinPartitions("host", "salt", "page_id", "html")

    def run(batches):
        held: list[tuple] = []
        elements = Cache(Element, 20_000, 256)

        def done(rows):
            texts = extract([h for *_, h in rows], elements)
            return pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.string()), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

        for batch in batches:
            for i in range(0, batch.num_rows, GROUP):
                for row in zip(*[c.to_pylist() for c in batch.slice(i, GROUP).columns], strict=True):
                    if held and row[:2] != held[0][:2]:
                        yield from map(done, windows(held))
                        held = []
                    elif len(held) >= 2 * GROUP:
                        # at least GROUP pages are left, so that no short window ends the host
                        yield done(held[:GROUP])
                        held = held[GROUP:]
                    held.append(row)
        if held:
            yield from map(done, windows(held))

    return dealt.mapInArrow(run, "page_id long, url string, text string")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages: page_id, url, text, n_chars. Nulls, ties and repeated rows: see main_text."""
    return main_text(spark, read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
