"""HTML extraction by site style trees.

The DOMs of one host are merged: elements with the same path of tags and classes
are one node of the host's style tree. Over the m pages that have a node,

* presentation importance is the entropy (base m) of the forms its branch takes;
* a word's entropy H (base m) over those pages is 1 if all pages have it alike, 0 if one page alone has it;
* novelty is the mean of 1 - H over the different words of the branch;
* content importance is the branch's information a page (1 - H of each of its
  words, and a little for any word) as a share of that of the host's pages.
  Words of links are no running text and count nothing, so menus have none,
  whether their words change from page to page or not.

A node's importance joins presentation and content as

    (1 - 0.9^l) * presentation + 0.9^l * content    (l: kinds of children).

The tree decides about every branch of a page: sections, lists and tables outside
of an article, and elements that name themselves as something else, stay from a
threshold of importance on. Headings, paragraphs and the like, article and main
elements and what is in them stay with their branch unless their words are the
same on most pages. The markup's own word is a weight: what is named as a menu,
header, footer, advert, form and so on counts half, and what is named as comments
a fifth, as entropies can't tell comments from articles. It decides alone only
where a host has too few pages to compare. Nothing but what is no text at all
(scripts, styles, controls of forms, hidden elements) goes without a look at the
tree.

Statistics are sums over (host, path, word) with a map-side count, so a host of
any size is never gathered in one place. Pages are read twice where they lie; the
tree travels, up to BROADCAST_NODES nodes, else the nodes of its own paths meet
each page.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from math import log
from types import MappingProxyType
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session_of, settle
from .simhash import whole_groups

THRESHOLD = 0.25
#: Novelty below which words are the same on most pages.
REPEATED = 0.2
#: Importance from which a branch is most of a page, and isn't dropped for its repetition.
MOST = 0.5
#: What importance is multiplied with.
NAMED_WEIGHT, COMMENT_WEIGHT = 0.5, 0.2
#: Information of a word that all pages have.
LEAST_INFORMATION = 0.02
GAMMA = 0.9
#: Nodes of style trees that are broadcast at most, behind a count.
BROADCAST_NODES = 200_000
#: Parts of all words, by their hashes, in which statistics are added up.
PARTS = 64
#: A node on fewer pages of its host has importance 1: there is nothing to compare.
LEAST_PAGES = 3
COUNTED_AT_ONCE = 500_000

# HTML's element kinds, and words by which branches name what is not the article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - set("br html head body title option td th tr tbody thead tfoot caption li dd dt".split()) | {"li", "dd", "dt"}
#: An opening tag closes an open one of these, up to the nearest of those.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
NEVER_TEXT = set("head script style noscript template iframe noembed noframes xmp svg math textarea title select button input dialog object canvas audio video".split())
#: Elements whose tag names what is not the article; in an article, its own header is its title.
NAMED_TAGS = set("nav aside footer menu form header".split())
#: Branches that importance is asked of: these anywhere, those outside of an article.
BRANCHES = set("div section article main nav aside header footer form menu center fieldset details".split())
LISTS = set("ul ol dl table".split())
BOILERPLATE_WORDS = set(
    "nav navbar navigation navi menu menubar topbar masthead header footer sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription social share sharing comment comments commentlist respond reply replies "
    "disqus related recommended breadcrumb breadcrumbs pagination pager login signup search searchbox widget toolbar skip copyright".split()
)
#: In an article, its own header is its title.
NOT_IN_ARTICLE = {"header", "masthead"}
MAIN = {"article", "main"}
#: In an article, ids of these are targets of links; only those that name comments are judged.
TARGETS = set("h1 h2 h3 h4 h5 h6 section p a span li dt dd".split())
COMMENT_WORDS = {"comment", "comments", "commentlist", "respond", "reply", "replies", "disqus"}

TAG = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>?")
#: One attribute with its value, so that a value is never searched for names.
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
DIGITS = re.compile(r"\d+")
WORD = re.compile(r"[A-Za-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Page:
    """A page's element nodes in document order and its texts.

    parent, tag, path, named (words of class and role), by_id (words of the id),
    hidden: a value for each node; node 0 is the page. pieces: (node, text), a text of one space
    where a block begins or ends.
    """

    def __init__(self, html: str):
        self.parent, self.tag, self.path, self.named, self.by_id, self.hidden = [0], [""], [""], [frozenset()], [frozenset()], [False]
        self.pieces: list[tuple[int, str]] = []
        self._read(html)

    def _read(self, html: str) -> None:
        stack, pos, end = [0], 0, len(html)
        parent, tags, paths, pieces = self.parent, self.tag, self.path, self.pieces
        while pos < end:
            m = TAG.search(html, pos)
            at = m.start() if m else end
            if at > pos:
                text = html[pos:at]
                pieces.append((stack[-1], entities.unescape(text) if "&" in text else text))
            if not m:
                break
            pos = m.end()
            if m[0] == "<!--":
                close = html.find("-->", pos)
                pos = close + 3 if close >= 0 else end
                continue
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            if m[1] or m[4]:  # an end tag
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == name:
                        del stack[k:]
                        break
                if name in BLOCK:
                    pieces.append((stack[-1], " "))
                continue
            if name in CLOSES_P:
                self._close(stack, {"p"}, {"table", "td", "th", "button", "object"})
            if name in CLOSES:
                self._close(stack, *CLOSES[name])
            attributes = m[3] if m[3] is not None else m[6]
            named, by_id, hidden, style = self._attributes(attributes) if attributes and len(attributes) > 2 else (frozenset(), frozenset(), False, "")
            if name in BLOCK:
                pieces.append((stack[-1], " "))
            if name in VOID:
                continue
            node = len(tags)
            parent.append(stack[-1])
            tags.append(name)
            paths.append(f"{paths[stack[-1]]}/{name}{style}")
            self.named.append(named)
            self.by_id.append(by_id)
            self.hidden.append(hidden)
            if name in RAW:
                if not attributes.rstrip().endswith("/"):
                    close = re.compile(f"</{name}(?=[\\s/>])", re.I).search(html, pos)
                    body = close.start() if close else end
                    if name == "title":
                        pieces.append((node, entities.unescape(html[pos:body])))
                    over = html.find(">", body)
                    pos = over + 1 if close and over >= 0 else end
                continue
            stack.append(node)

    def _close(self, stack: list[int], names: set[str], upto: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag in names:
                del stack[k:]
                return
            if tag in upto:
                return

    @staticmethod
    def _attributes(source: str) -> tuple[frozenset, frozenset, bool, str]:
        words: dict[str, set[str]] = {"class": set(), "id": set(), "role": set()}
        hidden, style, met = False, "", set()
        for key, a, b, c in ATTRIBUTE.findall(source):
            key, value = key.lower(), a or b or c
            if key in met:
                continue  # the first of a name counts
            met.add(key)
            if key in ("hidden", "aria-hidden"):
                hidden = hidden or key == "hidden" and value.lower() not in ("false", "until-found") or value.lower() == "true"
            elif key in words:
                words[key].update(w.lower() for w in WORD.findall(CAMEL.sub(" ", value)))
                if key != "role":
                    style += ("." if key == "class" else "#") + DIGITS.sub("0", " ".join(sorted(value.split()))).replace("/", "|")
        return frozenset(words["class"] | words["role"]), frozenset(words["id"]), hidden, style

    def gone(self, tree: Mapping[str, tuple[float, float]] = MappingProxyType({}), threshold: float = THRESHOLD) -> list[bool]:
        """For each node: it goes. tree: importance and novelty of the paths that enough pages have.

        Where a kept branch is the same on most pages as a whole, what is in it
        tells nothing apart and stays with it.
        """
        n = len(self.tag)
        named = [(self.named[i] | self.by_id[i]) & BOILERPLATE_WORDS for i in range(n)]
        holds_main = [False] * n
        for i in range(n - 1, 0, -1):
            if self.tag[i] in MAIN and not named[i] - NOT_IN_ARTICLE or holds_main[i]:
                holds_main[self.parent[i]] = True
        inside, gone, held = [False] * n, [False] * n, [False] * n
        for i in range(1, n):
            p, tag = self.parent[i], self.tag[i]
            inside[i], held[i] = inside[p] or tag in MAIN, held[p]
            if gone[p] or tag in NEVER_TEXT or self.hidden[i]:
                gone[i] = True
                continue
            if tag in ("html", "body"):
                continue
            # a flow element is no section: its names are targets of links and looks
            words = named[i] if tag in BRANCHES or tag in LISTS and not inside[p] else named[i] & COMMENT_WORDS
            if inside[p]:
                words = (words - NOT_IN_ARTICLE) if tag != "section" else self.named[i] & BOILERPLATE_WORDS | self.by_id[i] & COMMENT_WORDS
            comments = bool(words & COMMENT_WORDS)
            other = bool(words) or tag in NAMED_TAGS and not (tag == "header" and inside[p])
            if holds_main[i] and not comments:
                continue
            known = tree.get(self.path[i])
            if known is None:
                gone[i] = other
                continue
            importance, novelty = known
            importance *= COMMENT_WEIGHT if comments else NAMED_WEIGHT if other else 1.0
            asked = other or not inside[i] and (tag in BRANCHES or tag in LISTS)
            gone[i] = importance < threshold if asked else novelty < REPEATED and importance < MOST and not held[p]
            held[i] = held[p] or not gone[i] and novelty < REPEATED
        return gone

    def text(self, tree: Mapping[str, tuple[float, float]] = MappingProxyType({}), threshold: float = THRESHOLD) -> str:
        """The main text: all that stays; runs of white space are one space."""
        gone = self.gone(tree, threshold)
        return " ".join("".join(t for node, t in self.pieces if t == " " or not gone[node]).split())

    def forms(self) -> dict[str, tuple[str, int]]:
        """For each path: form (the kinds of children in order, of all elements of the path) and number of kinds of children."""
        children: list[list[str]] = [[] for _ in self.tag]
        for i in range(1, len(self.tag)):
            p = self.parent[i]
            kind = self.path[i][len(self.path[p]) :]
            if not children[p] or children[p][-1] != kind:
                children[p].append(kind)
        found: dict[str, tuple[str, int]] = {}
        for i in range(1, len(self.tag)):
            form, kinds = found.get(self.path[i], ("", 0))
            found[self.path[i]] = (f"{form}|{' '.join(children[i])}", max(kinds, len(set(children[i]))))
        return found

    def words(self) -> dict[str, Counter[str]]:
        """For each path that has some: its own words of running text, those of branches not counted."""
        still = [False] * len(self.tag)
        for i in range(1, len(self.tag)):
            still[i] = still[self.parent[i]] or self.tag[i] == "a" or self.tag[i] in NEVER_TEXT
        found: dict[str, Counter[str]] = {}
        for node, text in self.pieces:
            if text != " " and not still[node]:
                found.setdefault(self.path[node], Counter()).update(text.lower().split())
        return found


def hosted(pages: DataFrame) -> DataFrame:
    """page_id, url, html, host (of a null url or one without: empty) and ref, which equal pages of a host share."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))
    return rows.withColumn("ref", F.xxhash64("host", "html"))


def packed(node: np.ndarray, word: np.ndarray, c: np.ndarray, logs: np.ndarray) -> bytes:
    """Words in order of node and hash: the nodes and how many words each has, differences of hashes, counts, and logs where a word occurs more than once."""
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    steps = np.diff(word, prepend=np.uint32(0))
    steps[first] = word[first]
    wide = int(c.max()) > 255
    head = np.array([len(first), len(word), wide], "<u4")
    held = np.diff(np.append(first, len(word))).astype("<u4")
    return b"".join(x.tobytes() for x in (head, node[first].astype("<i8"), held, steps.astype("<u4"), c.astype("<u4" if wide else "<u1"), logs[c > 1].astype("<f4")))


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    nodes_n, n, wide = np.frombuffer(raw, "<u4", 3).tolist()
    at = 12

    def take(kind: str, many: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, many, at)
        at += out.nbytes
        return out

    nodes, held, steps = take("<i8", nodes_n), take("<u4", nodes_n), take("<u4", n)
    c = take("<u4" if wide else "<u1", n)
    total = np.cumsum(steps, dtype=np.int64)
    starts = np.cumsum(held, dtype=np.int64) - held
    before = np.repeat(np.concatenate([[0], total])[starts], held)
    logs = np.zeros(n, np.float32)
    logs[c > 1] = take("<f4", int((c > 1).sum()))
    return np.repeat(nodes, held), total - before, c, logs


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, pages, presentation, content, novelty, importance of every node of the hosts' style trees.

    Importances and novelty of nodes that fewer than LEAST_PAGES pages have are
    null. Null and empty html has no node. A branch without running text has no
    content, and novelty 1.
    """
    session_of(pages)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        forms: Counter[tuple] = Counter()
        tokens: Counter[tuple] = Counter()
        logs: Counter[tuple] = Counter()  # of c occurrences on a page, c ln c
        numbers: dict[tuple[str, str], int] = {}

        def number(host: str, path: str) -> int:
            if len(numbers) > COUNTED_AT_ONCE:
                numbers.clear()
            return numbers.setdefault((host, path), xxh64_intdigest(f"{host}\0{path}".encode("utf-8", "surrogatepass")) - (1 << 63))

        def out() -> Iterator[pa.RecordBatch]:
            if forms:
                hosts, paths, hashes, kinds = zip(*forms, strict=True)
                nodes = [number(h, p) for h, p in zip(hosts, paths, strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([x % PARTS for x in hashes], pa.int32()), "node": pa.array(nodes, pa.int64()), "hash": pa.array(hashes, pa.int64()), "kinds": pa.array(kinds, pa.int32()),
                    "n": pa.array(list(forms.values()), pa.int64()), "host": pa.array(hosts, pa.string()), "path": pa.array(paths, pa.string()), "packed": pa.nulls(len(nodes), pa.binary()),
                })
            if tokens:
                node, word = (np.array(x, kind) for x, kind in zip(zip(*tokens, strict=True), (np.int64, np.uint32), strict=True))
                c, own = np.array(list(tokens.values()), np.uint32), np.array([logs.get(k, 0.0) for k in tokens], np.float32)
                order = np.lexsort((word, node, word % PARTS))
                node, word, c, own = node[order], word[order], c[order], own[order]
                cuts = np.searchsorted(word % PARTS, np.arange(PARTS + 1))
                for part, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                    if y > x:
                        yield pa.RecordBatch.from_pydict({
                            "part": pa.array([part], pa.int32()), **{k: pa.nulls(1, t) for k, t in (("node", pa.int64()), ("hash", pa.int64()), ("kinds", pa.int32()), ("n", pa.int64()), ("host", pa.string()), ("path", pa.string()))},
                            "packed": pa.array([packed(node[x:y], word[x:y], c[x:y], own[x:y])], pa.binary()),
                        })

        for b in batches:
            for host, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                page = Page(html.as_py())
                for path, (form, kinds) in page.forms().items():
                    forms[host, path, xxh64_intdigest(form.encode("utf-8", "surrogatepass")) - (1 << 63), kinds] += 1
                for path, words in page.words().items():
                    node = number(host, path)
                    for w, c in words.items():
                        key = (node, crc32(w.encode("utf-8", "surrogatepass")))
                        tokens[key] += c
                        if c > 1:
                            logs[key] += c * log(c)
                if len(forms) + len(tokens) > COUNTED_AT_ONCE:
                    yield from out()
                    forms.clear()
                    tokens.clear()
                    logs.clear()
        yield from out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each node, from the forms and words of a part: pages, kinds and sum of c ln c of forms; types, tokens, and sums of a word's entropy (not yet divided by ln m) and of that times its tokens."""
        columns = ["node", "host", "path", "pages", "kinds", "s", "types", "tokens", "entropy", "weighted"]
        kinds_of = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        for b in whole_groups(x.slice(i, 64) for x in batches for i in range(0, x.num_rows, 64)):
            for part in np.unique(b.column(0).to_numpy()).tolist():
                table = pa.Table.from_batches([b.filter(pc.equal(b.column(0), part))])
                forms = table.filter(pc.is_null(table["packed"])).group_by(["node", "hash", "host", "path"]).aggregate([("n", "sum"), ("kinds", "max")])
                found: list[list] = [forms["node"].to_pylist(), forms["host"].to_pylist(), forms["path"].to_pylist(), forms["n_sum"].to_pylist(), forms["kinds_max"].to_pylist(), [n * log(n) for n in forms["n_sum"].to_pylist()]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, kinds_of, strict=False)] + [pa.array([0] * forms.num_rows, t) for t in kinds_of[6:]], columns)
                blobs = table["packed"].drop_null().to_pylist()
                if blobs:
                    node, word, c, own = (np.concatenate(x) for x in zip(*map(unpacked, blobs), strict=True))
                    order = np.lexsort((word, node))
                    node, word, c, own = node[order], word[order], c[order].astype(np.float64), own[order].astype(np.float64)
                    first = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (word[1:] != word[:-1])]))
                    node, c, own = node[first], np.add.reduceat(c, first), np.add.reduceat(own, first)
                    spread = np.log(c) - own / c
                    at = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
                    sums = [np.diff(np.append(at, len(node))), np.add.reduceat(c, at).astype(np.int64), np.add.reduceat(spread, at), np.add.reduceat(spread * c, at)]
                    zero = [pa.nulls(len(at), pa.string())] * 2 + [pa.array(np.zeros(len(at)), pa.float64()).cast(t) for t in kinds_of[3:6]]
                    yield pa.RecordBatch.from_arrays([pa.array(node[at]), *zero, *map(pa.array, sums)], columns)

    rows = hosted(pages).select("host", "html").mapInArrow(count, "part int, node long, hash long, kinds int, n long, host string, path string, packed binary")
    dealt = rows.repartition(min(PARTS, max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "part").sortWithinPartitions("part")
    schema = "node long, host string, path string, pages long, kinds int, s double, types long, tokens long, entropy double, weighted double"
    added = settle(dealt.mapInArrow(add, schema), "features")  # a few rows for each node and part
    m = F.col("pages")
    sums = added.where("host is not null").groupBy("node", "host", "path").agg(F.sum("pages").alias("pages"), F.max("kinds").alias("kinds"), F.sum("s").alias("s"))
    own = added.where("host is null").groupBy("node").agg(*[F.sum(x).alias(x) for x in ("types", "tokens", "entropy", "weighted")]).join(sums.select("node", "host", "path", "pages"), "node")
    # entropies over the pages of the node that words are in; a node of one page has none
    share = lambda c: F.when(m > 1, F.col(c) / F.log(m)).otherwise(0.0)
    own = own.select("host", "path", "types", (F.col("types") - share("entropy")).alias("news"), (F.col("tokens") * (1 + LEAST_INFORMATION) - share("weighted")).alias("information"))
    # each node's own words count for all branches around it
    parts = F.split("path", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    branches = own.select("host", above.alias("path"), "types", "news", "information").groupBy("host", "path").agg(*[F.sum(x).alias(x) for x in ("types", "news", "information")])
    whole = branches.where("path = ''").join(sums.where("path not like '/%/%'").groupBy("host").agg(F.max("pages").alias("host_pages")), "host").select("host", (F.col("information") / F.col("host_pages")).alias("of_page"))
    known = sums.join(branches, ["host", "path"], "left").join(whole, "host", "left")
    content = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("information") / m, F.col("of_page")), F.lit(0.0)))
    novelty = F.coalesce(F.col("news") / F.col("types"), F.lit(1.0))
    presentation = 1 - F.col("s") / (m * F.log(m))
    mixed = F.pow(F.lit(GAMMA), "kinds")
    enough = lambda x: F.when(m >= LEAST_PAGES, x)
    return known.select("host", "path", "pages", enough(presentation).alias("presentation"), enough(content).alias("content"), enough(novelty).alias("novelty"), enough((1 - mixed) * presentation + mixed * content).alias("importance"))


def extract_text(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages.

    Null, empty and tag-only html has an empty text and 0 characters; a null url
    has the empty host; repeated rows get a row each. Very long pages are read
    whole. No rows give no rows.
    """
    spark = session_of(pages)
    rows = hosted(pages)
    tree = settle(style_tree(pages).where("importance is not null").select("host", "path", "importance", "novelty"), "style-tree")
    schema = "page_id long, url string, text string, n_chars long"

    def texts(b: pa.RecordBatch, trees) -> pa.RecordBatch:
        made = [Page(html.as_py()).text(own, threshold) for html, own in zip(b.column(2), trees, strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())], ["page_id", "url", "text", "n_chars"])

    if tree.count() <= BROADCAST_NODES:
        by_host: dict[str, dict[str, tuple[float, float]]] = {}
        for host, path, importance, novelty in zip(*(x.to_pylist() for x in tree.toArrow().columns), strict=True):
            by_host.setdefault(host, {})[path] = (importance, novelty)
        shared = spark.sparkContext.broadcast(by_host)

        def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield texts(b, [shared.value.get(host, {}) for host in b.column(3).to_pylist()])

        return rows.select("page_id", "url", "html", "host").mapInArrow(extract, schema)

    def paths_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            refs, hosts, paths = [], [], []
            for ref, host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                own = set(Page(html.as_py()).path[1:])
                refs += [ref] * len(own)
                hosts += [host] * len(own)
                paths += own
            yield pa.RecordBatch.from_arrays([pa.array(refs, pa.int64()), pa.array(hosts, pa.string()), pa.array(paths, pa.string())], ["ref", "host", "path"])

    asked = rows.select("ref", "host", "html").mapInArrow(paths_of, "ref long, host string, path string").distinct()
    # at most the paths of one page
    found = asked.join(tree, ["host", "path"]).groupBy("ref").agg(F.collect_list(F.struct("path", "importance", "novelty")).alias("nodes"))

    def extract_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield texts(b, [{x["path"]: (x["importance"], x["novelty"]) for x in nodes or ()} for nodes in b.column(3).to_pylist()])

    return rows.join(found, "ref", "left").select("page_id", "url", "html", "nodes").mapInArrow(extract_met, schema)
