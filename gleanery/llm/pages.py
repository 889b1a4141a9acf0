"""Main-text extraction by equivalence classes of template tokens.

Pages of one host are dealt into groups of bounded size. In a group, tokens (tags with their class, and words, each
under the path of open elements) that have the same occurrence vector over the pages form a class; a class is valid
if its tokens come in one order on every page. The class of tokens that every page has once is the template's root:
between its tokens are slots. A further class nests in a slot of a class that holds it, the same one wherever it
occurs, and has slots of its own; a class that crosses others or changes its slot is none. Tokens of the nested classes
are template; what remains in the slots is extracted: the article is the run of the root's slots from the first to
the last that hold varying text outside of menus, forms and the like, without the lines that all pages share.

What an element is for is told by HTML's own elements, roles and hidden marks. Names of classes and ids are hints, which
varying prose overrules: an element called like a notice, a share box or a sidebar is dropped if it holds less than
``PROSE`` varying words or mostly links, or if it stands outside of the element that holds the other text. Adverts and
reader comments by their own names (``NEVER``) are dropped wherever other text is. On pages with <article> or <main>,
text outside of them stays if it is prose of its own or a heading of first rank.

Groups of fewer than ``LEAST`` different pages have no template of their own: there all words vary.

A host's groups are told by its different rows. A row that repeats more often than a group has room is extracted once,
so that no group grows with its copies. Reading a page takes time in proportion to its length, however broken it is.

Defined cases: a null or empty html has an empty text; a null or odd url counts as one host; repeated rows all have
their text in the result; an empty table gives no rows; pages without markup are text; a tag that never ends is text; of
an odd number of quotes the tags behind are read without regard to quotes; elements that are not closed end with their
parents; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import stash

GROUP, LEAST, MOST_BROADCAST = 64, 4, 50_000
PROSE = 20  # varying words that overrule a name
#: Elements by what they are for in HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul", "aside"}
ASIDE = {"nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "head", "title", "iframe", "object", "canvas", "noscript", "template", "svg", "math", "audio", "video", "map", "label", "textarea"}
SELF_CLOSING = {"p": {"p", "li", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "article", "section", "footer", "nav", "aside", "form", "header", "main", "blockquote", "pre"}, "li": {"li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu"}
#: What is skipped up to its closing tag.
RAW = {"script", "style", "noscript", "template", "svg", "title", "textarea", "iframe"}
#: Names that hint at what is no article, as the whole of a class or id or as a part of it.
NAMES = set("ad ads banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription sidebar sidenav side menu nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social related recommended comment comments reply replies disqus widget toolbar login signup search pagination pager skip".split())
HINT_PARTS = re.compile(r"^(?:advert|promo|sponsor)")
#: Names of adverts and reader comments.
NEVER = re.compile(r"^(?:ads?|adverts?|advertisements?|sponsored|promo|promoted|(?:(?:user|reader)[-_])?(?:comments?|replies|disqus)(?:[-_](?:list|area|section|body|thread|item|items|box|wrapper|container))?|disqus_thread|commentlist|respond)$")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^<>\"]*\"|'[^<>']*')*+)>|([^<]++)")
TAG_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
SPACES = re.compile(r"[\s/]*")
NAME_PART = re.compile(r"[^\s=>/][^\s=>/]*")
VALUE = re.compile(r"\s*=\s*")
BARE = re.compile(r"[^\s>]*")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


class Markup:
    """Pieces of a source in order: (text, None, None) or (None, tag, attributes), a closing tag with its slash."""

    def __init__(self, source: str):
        self.source, self.quotes = source, True
        self.missing: set[str] = set()  # what does not occur any more from here on

    def _find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.source.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def _tag_end(self, at: int) -> int:
        """The place of a tag's end, whose name ends at a place; -1 if it has none."""
        s, n = self.source, len(self.source)
        if self.quotes:
            k = at
            while k < n:
                k = SPACES.match(s, k).end()
                if k >= n:
                    break
                if s[k] == ">":
                    return k
                m = NAME_PART.match(s, k)
                k = m.end() if m else k + 1
                m = VALUE.match(s, k)
                if m:
                    k = m.end()
                    if k < n and s[k] in "\"'":
                        close = self._find(s[k], k + 1)
                        k = close + 1 if close >= 0 else BARE.match(s, k).end()
                    else:
                        k = BARE.match(s, k).end()
            self.quotes = False  # some quote has no partner: from here on they mean nothing
            self.missing.clear()
        return self._find(">", at)

    def __iter__(self):
        s, n, at = self.source, len(self.source), 0
        plain = PLAIN_TAG.match
        while at < n:
            m = plain(s, at)
            if m:
                at = m.end()
                if m.lastindex == 4:
                    yield m.group(4), None, None
                    continue
                slash, name, told = m.group(1, 2, 3)
            elif s.startswith("<!--", at):
                end = self._find("-->", at + 4)
                at = n if end < 0 else end + 3
                continue
            elif s.startswith(("<!", "<?"), at) and (end := self._find(">", at)) >= 0:
                at = end + 1
                continue
            else:
                m = TAG_NAME.match(s, at)
                end = self._tag_end(m.end()) if m else -1
                if end < 0:
                    yield "<", None, None
                    at += 1
                    continue
                slash, name, told, at = m.group(1), m.group(2), s[m.end() : end], end + 1
            name = name.lower()
            if not slash and name in RAW and not told.rstrip().endswith("/"):
                close = None if f"</{name}" in self.missing else re.compile(rf"</{name}\s*>", re.I).search(s, at)
                if close or name in ("script", "style"):
                    at = close.end() if close else n
                    continue
                self.missing.add(f"</{name}")  # it is an element as others are, then
            yield None, slash + name, told


def hint_of(marks: str) -> str:
    """What class and id hint at: "never", "strong" for a whole name, "weak" for a part of one, or nothing."""
    found = ""
    for token in marks.lower().split():
        if NEVER.match(token):
            return "never"
        if token in NAMES or HINT_PARTS.match(token):
            found = "strong"
        elif not found and ("-" in token or "_" in token) and any(x in NAMES or HINT_PARTS.match(x) for x in re.split("[-_]", token)):
            found = "weak"
    return found


class Page:
    """A page as tokens: (kind, value, path, element); kind: open, close or text. Paths are numbers, the same in pages
    that share ``paths``. Of every element: parent, name, tokens from and to, aside (by HTML), hint (by name), link."""

    def __init__(self, source: str | None, paths: dict | None = None):
        shared = {} if paths is None else paths
        self.tokens: list[tuple] = []
        self.parent, self.name, self.begin, self.end = [0], [""], [0], [0]
        self.aside, self.hint, self.link, self.article = [False], [""], [False], [0]
        stack: list[tuple[str, str, int, int]] = []  # name, token, element, path outside
        open_: Counter = Counter()
        path, element = 0, 0
        add = self.tokens.append

        def leave():
            nonlocal path, element
            name, _, own, path = stack.pop()
            open_[name] -= 1
            self.end[own] = len(self.tokens)
            element = self.parent[own]

        for text, name, told in Markup(source or ""):
            if text is not None:
                add(("text", text, path, element))
                continue
            if name[0] == "/":  # a closing tag closes what is open up to its element
                name = name[1:]
                if open_[name]:
                    while stack[-1][0] != name:
                        leave()
                    token = stack[-1][1]
                    add(("close", token, stack[-1][3], element))
                    leave()
                continue
            while stack and name in SELF_CLOSING.get(stack[-1][0], ()):
                leave()
            token, aside, hint = name, name in ASIDE, ""
            if told and ("=" in told or "hidden" in told):
                said = {a.lower(): x or y or z or "" for a, x, y, z in ATTRIBUTE.findall(told)}
                if said.get("class"):
                    token += "." + said["class"]
                if name not in ("html", "body", "article", "main"):
                    hint = hint_of(f"{said.get('class', '')} {said.get('id', '')}")
                aside |= said.get("role", "").lower() in ASIDE_ROLES or said.get("aria-hidden") == "true" or "hidden" in said
            if name == "header" and not (open_["article"] or open_["main"]):
                aside = True
            own = len(self.parent)
            self.parent.append(element)
            self.name.append(name)
            self.begin.append(len(self.tokens))
            self.end.append(len(self.tokens) + 1)
            self.aside.append(aside or self.aside[element])
            self.hint.append(hint)
            self.link.append(name == "a" or self.link[element])
            self.article.append(own if name in ("article", "main") else self.article[element])
            add(("open", token, path, own))
            if name not in VOID and not told.rstrip().endswith("/"):
                stack.append((name, token, own, path))
                open_[name] += 1
                path = shared.setdefault((path, token), len(shared) + 1)
                element = own
        while stack:
            leave()
        self.end[0] = len(self.tokens)

    def roles(self):
        """Template tokens in order: tags and words under their path."""
        for kind, value, path, _ in self.tokens:
            if kind == "text":
                for word in value.split():
                    yield ("word", word, path)
            else:
                yield (kind, value, path)

    def kept(self, words: set) -> list[bool]:
        """Of every token, whether it is text of the article as far as this page tells. words: the template's."""
        counts = []  # varying words of each text outside of asides
        for kind, value, path, e in self.tokens:
            counts.append(0 if kind != "text" or self.aside[e] else sum((w, path) not in words for w in value.split()))
        size = len(self.parent)
        hints = list(self.hint)
        for k in range(8):
            outer = [0] * size  # the outermost element with a hint that an element lies in
            for e in range(1, size):
                outer[e] = outer[self.parent[e]] or (e if hints[e] else 0)
            free, links, inside = [0] * size, [0] * size, Counter()
            upto = [0]  # varying words without any hint before each token
            for (_, _, _, e), n in zip(self.tokens, counts, strict=True):
                h = outer[e]
                free[e] += 0 if h else n
                links[e] += n if self.link[e] else 0
                if h and n:
                    inside[h] += n
                upto.append(upto[-1] + (0 if h else n))
            total = upto[-1]
            # one that holds nearly all is no part of a page, whatever its name
            most = max((h for h in inside if hints[h] != "never"), key=lambda h: (inside[h], -h), default=0)
            if not most or total * (4 if hints[most] == "weak" else 1000) >= inside[most]:
                break
            hints = [h if h == "never" or k < 6 and e != most else "" for e, h in enumerate(hints)]
        sums = list(free)
        for e in range(size - 1, 0, -1):
            sums[self.parent[e]] += sums[e]
            links[self.parent[e]] += links[e]
        heavy = {}
        for e in range(1, size):
            if total and sums[e] * 100 >= 85 * total:
                heavy[self.parent[e]] = e
        box = 0
        while box in heavy:
            box = heavy[box]
        own_box = self.name[box] not in ("", "html", "body")

        def overruled(h: int) -> bool:
            n, p = inside[h], self.parent[h]
            if hints[h] == "never" or n < PROSE or 2 * links[h] > n:
                return False
            within = self.begin[box] <= self.begin[h] and self.end[h] <= self.end[box]
            between = upto[self.begin[h]] > upto[self.begin[p]] and upto[self.end[p]] > upto[self.end[h]]
            return within and (hints[h] == "weak" or between) if own_box else hints[h] == "weak" and between

        good = {0: True} | {h: overruled(h) for h in range(1, size) if outer[h] == h}
        # inside of what stays, further hints are judged by their own prose
        fine = [True] * size
        for e in range(1, size):
            up = fine[self.parent[e]]
            if outer[e] == e:
                fine[e] = up and good[e]
            elif hints[e] and up:
                fine[e] = hints[e] == "weak" and self._words(e, counts) >= PROSE
            else:
                fine[e] = up
        if any(self.article[e] and fine[e] and not self.aside[e] for e in range(1, size)):
            self._beside_articles(fine, sums, links)
        return [kind == "text" and not self.aside[e] and fine[e] for kind, _, _, e in self.tokens]

    def _words(self, e: int, counts: list[int]) -> int:
        return sum(counts[self.begin[e] : self.end[e]])

    def _beside_articles(self, fine: list[bool], sums: list[int], links: list[int]) -> None:
        """Takes away what stands outside of articles and is neither prose nor a heading of first rank."""
        size = len(self.parent)
        holds = [False] * size
        for e in range(size - 1, 0, -1):
            if self.article[e] == e and fine[e]:
                holds[e] = True
            holds[self.parent[e]] |= holds[e]
        if not holds[0]:
            return
        for e in range(1, size):
            if self.article[e] or holds[e]:
                continue
            if holds[self.parent[e]]:  # the outermost element without an article
                fine[e] = fine[e] and (self.name[e] == "h1" or sums[e] >= PROSE and 2 * links[e] <= sums[e])
            else:
                fine[e] = fine[e] and fine[self.parent[e]]

    def lines(self, inside, drop: set) -> list[str]:
        """The blocks of the texts for whose places inside(k) holds, without the lines to drop."""
        out: list[str] = []
        block: list[str] = []

        def end():
            line = " ".join("".join(block).split())
            if line:
                out.append(line)
            block.clear()

        for k, (kind, value, path, _) in enumerate(self.tokens):
            if kind != "text":
                name = value.partition(".")[0]
                if name in BLOCKS:
                    end()
                elif name in ("td", "th"):
                    block.append(" ")
            elif inside(k):
                if drop and (path, " ".join(value.split())) in drop:
                    continue
                block.append(entities.unescape(value) if "&" in value else value)
        end()
        return out


def equivalence_classes(pages: list[Page]) -> list[list[tuple]]:
    """Valid classes: roles of one occurrence vector, in their one order; the class of tokens met once a page first."""
    vectors: dict[tuple, dict[int, int]] = defaultdict(dict)
    orders = []
    for k, page in enumerate(pages):
        roles = list(page.roles())
        orders.append(roles)
        for role, n in Counter(roles).items():
            vectors[role][k] = n
    support = max(2, -(-len(pages) * 3 // 5))
    classes: dict[tuple, list[tuple]] = defaultdict(list)
    for role, found in vectors.items():
        if len(found) >= support:
            classes[tuple(sorted(found.items()))].append(role)
    valid = []
    for vector, roles in classes.items():
        own, order, fine = set(roles), None, True
        for k, n in vector:
            met = [r for r in orders[k] if r in own]
            round_ = met[: len(roles)]
            order = order or round_
            if round_ != order or met != order * n:
                fine = False
                break
        if fine:
            valid.append((len(vector) == len(pages) and all(n == 1 for _, n in vector), order))
        elif len(vector) == len(pages) and all(n == 1 for _, n in vector):
            # of tokens that change places, those of the first page's longest common order stay
            kept = orders[vector[0][0]]
            kept = [r for r in kept if r in own]
            for k, _ in vector[1:]:
                at = {r: i for i, r in enumerate(x for x in orders[k] if x in own)}
                run, last = [], -1
                for r in kept:
                    if at[r] > last:
                        run.append(r)
                        last = at[r]
                kept = run
            valid.append((True, kept))
    return [order for once, order in sorted(valid, key=lambda x: not x[0])]


class Template:
    """The nested classes of pages. ``root``: place of each token of the root; ``nested``: of every other class that
    nests, by its number, its parent's number (0: the root) and the slot in it; ``words``: the template's words and paths."""

    def __init__(self, pages: list[Page], classes: list[list[tuple]]):
        self.root = {role: k for k, role in enumerate(classes[0])}
        places = {role: (c, k) for c, order in enumerate(classes) if c == 0 or len(order) > 1 for k, role in enumerate(order)}
        met = [[x for x in map(places.get, page.roles()) if x] for page in pages]
        last = [len(order) - 1 for order in classes]
        live = {c for c, _ in places.values()}
        loose: set[int] = set()  # places of the root's words that other classes hold: content that happens to be on every page once
        while True:
            slots: dict[int, tuple[int, int]] = {}
            wrong, before = set(), len(loose)
            for page in met:
                open_: list[list[int]] = []  # class and the place of its latest token, outermost first
                for c, k in page:
                    if c not in live or not c and k in loose:
                        continue
                    if not c and open_ and open_[-1][0] and classes[0][k][0] == "word":
                        loose.add(k)
                        continue
                    if k == 0 or not c and not open_:
                        slot = tuple(open_[-1]) if open_ else (0, -1)
                        if c and slots.setdefault(c, slot) != slot:
                            wrong.add(c)
                        open_.append([c, k])
                    elif all(x[0] != c for x in open_):  # has been crossed
                        wrong.add(c)
                        continue
                    else:
                        while open_[-1][0] != c:  # what is still open crosses
                            wrong.add(open_.pop()[0])
                        open_[-1][1] = k
                    if k == last[c] and c:
                        open_.pop()
            wrong.discard(0)
            if not wrong and len(loose) == before:
                break
            live -= wrong
        self.root = {role: k for role, k in self.root.items() if k not in loose}
        self.nested = {c: slots[c] for c in live if c in slots}
        self.words = {(value, path) for order in classes for kind, value, path in order if kind == "word"}

    def spans(self, page: Page) -> list[tuple[int, int]]:
        """Of every token the slots of the root that it reaches from and to; slot k follows the root's k-th token."""
        out, at = [], 0
        root = self.root.get
        for kind, value, path, _ in page.tokens:
            before = None
            for role in [("word", w, path) for w in value.split()] if kind == "text" else [(kind, value, path)]:
                k = root(role)
                if k is not None:
                    at = k + 1
                    before = k if before is None else before
                elif before is None:
                    before = at
            out.append((at if before is None else before, at))
        return out


def distinct_pages(pages: list[Page]) -> list[Page]:
    return list({tuple(t[1] for t in p.tokens if t[0] == "text"): p for p in pages}.values())


def template_of(sample: list[Page]) -> Template | None:
    """The template of different pages; None if they are too few or share no token."""
    classes = equivalence_classes(sample) if len(sample) >= LEAST else []
    if not classes or any(sum(r == classes[0][0] for r in p.roles()) != 1 for p in sample):
        return None
    return Template(sample, classes)


def template_lines(sample: list[Page], kept: list[list[bool]]) -> set:
    """(path, line) of the texts that all pages have, where they are enough to have a template."""
    lines: Counter = Counter()
    for page, good in zip(sample, kept, strict=True):
        lines.update({(path, " ".join(value.split())) for (kind, value, path, _), x in zip(page.tokens, good, strict=True) if x and path and value.strip()})
    return {line for line, n in lines.items() if n == len(sample)} if len(sample) >= LEAST else set()


def extract_group(sources: list[str | None]) -> list[str]:
    """Main texts of pages of one host."""
    paths: dict = {}
    pages = [Page(s, paths) for s in sources]
    sample = distinct_pages(pages)
    template = template_of(sample)
    words = template.words if template else set()
    kept = {id(page): page.kept(words) for page in pages}
    drop = template_lines(sample, [kept[id(page)] for page in sample]) if template else set()
    chosen: tuple[int, int] | None = None
    spans: dict[int, list] = {}
    if template:
        for page in pages:
            spans[id(page)] = template.spans(page)
        held = [span for page in sample for (_, value, path, _), span, good in zip(page.tokens, spans[id(page)], kept[id(page)], strict=True) if good and any((w, path) not in words for w in value.split())]
        chosen = (min(a for a, _ in held), max(b for _, b in held)) if held else None
    out = []
    for page in pages:
        good = kept[id(page)]
        if chosen:
            run = [x and b >= chosen[0] and a <= chosen[1] for x, (a, b) in zip(good, spans[id(page)], strict=True)]
            if _held(page, run, drop) * 2 >= _held(page, good, drop):  # else a page of another make
                good = run
        out.append("\n\n".join(page.lines(good.__getitem__, drop)))
    return out


def _held(page: Page, good: list[bool], drop: set) -> int:
    """Letters of the texts that are good, but for lines to drop."""
    return sum(sum(map(len, value.split())) for (_, value, path, _), x in zip(page.tokens, good, strict=True) if x and not (drop and (path, " ".join(value.split())) in drop))


def extract_main_text(rows: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group: int = GROUP) -> DataFrame:
    """id, url, text of every page."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))
    named = rows.select(F.col(id_col), F.col(url_col), F.col(html_col), host.alias("_host"), F.xxhash64(id_col, url_col, html_col).alias("_row"))
    seen = stash(named.groupBy("_host", "_row").agg(F.count("*").alias("_times")), "pages-seen")
    large = _small(seen.groupBy("_host").agg(F.count("*").alias("_n")).filter(F.col("_n") > group).select("_host", F.ceil(F.col("_n") / group).cast("int").alias("_parts")))
    often = seen.filter(F.col("_times") > group).select("_row").distinct()
    once = named.withColumn("_copies", F.lit(1).cast("long"))
    if not often.isEmpty():
        often, own = _small(often), [id_col, url_col, html_col, "_host", "_row"]
        held = named.join(often, "_row", "left_semi").groupBy(*own).agg(F.count("*").alias("_copies"))
        once = once.join(often, "_row", "left_anti").unionByName(held)
    deal = F.pmod(F.col("_row"), F.coalesce("_parts", F.lit(1)))
    dealt = once.join(large, "_host", "left").select(id_col, url_col, html_col, "_copies", "_host", deal.alias("_part"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(id_col, url_col).schema) + ", text string, _copies long"

    def run(pdf):
        sources = [None if x is None or x != x else x for x in pdf[html_col]]
        return pdf[[id_col, url_col]].assign(text=extract_group(sources), _copies=pdf["_copies"])

    texts = dealt.groupBy("_host", "_part").applyInPandas(run, schema)
    return texts.withColumn("_copies", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).drop("_copies")


def _small(keys: DataFrame) -> DataFrame:
    """Marked for a broadcast if there are few."""
    return F.broadcast(keys) if keys.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else keys
