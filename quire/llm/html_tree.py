"""HTML extraction by a tree-structured graphical model.

Block elements of a page are nodes of a tree; each is content or not. A node's evidence and a potential between
parent and child make up the model; sum-product messages upward and downward give every node's marginal of
being content.

Evidence is structural: element, length, punctuation and links of the node's own text and of all below it, share and
place in the page's text, siblings that are built alike, paragraphs and headings beside it, and the sectioning
element that it lies in. Names of class, id and role count only where several labelled pages of the table hold them.

Weights are trained by gradient steps on the exact likelihood (the same messages give the expected counts)
from labelled pages: a bounded sample of the table whose own markup tells the article from the rest. Each is also
rendered anew with invented names, other elements and other parts around the article, made of the sample's own
sentences, so that neither words nor names but structure tells them apart.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages of the sample, the longest page used in it, renderings of each, passes and step of the training.
SAMPLE, SAMPLE_CHARS, RENDERINGS, PASSES, STEP = 96, 20_000, 9, 10, 0.2
#: A block is content from this marginal on.
CONTENT = 0.5
#: Rows per batch that leaves a task.
ROWS = 64

# Elements that start a block, those whose text is never shown, those without an end, and
# those that a new one of the same group ends.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
HIDDEN = frozenset("script style title template noscript textarea select button iframe svg object canvas audio video math head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDED_BY_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "tbody": ("tbody", "thead"), "thead": ("tbody",)}
SCOPES = frozenset("ul ol dl table article section div main aside nav header footer body form menu fieldset".split())

#: Sectioning elements that tell of what lies in them.
TELLING = frozenset("article main nav aside header footer form".split())
#: Attribute that marks content in renderings; no page's own attribute counts as it.
INNER = "data-quire-inner"
#: Labelled pages that must hold a name for it to count.
NAMED = 3

_markup = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
_names = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_letters = re.compile(r"[a-z]+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ends = re.compile(r"[.!?;:,](?:\s|$)")
_sentences = re.compile(r"[^.!?]{3,300}[.!?]*")
_gap = re.compile(r"td|th|br|hr|img|input|option|label")


class Page:
    """Nodes of a page in page order: parent (-1 for the root), tag, words of class, id and role; and its blocks of text."""

    def __init__(self, source: str):
        self.parent, self.tag, self.names, self.inner = [-1], ["root"], [()], [False]
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters within links
        self._open, self._pieces, self._linked, self._in_link = [0], [], 0, False
        at, size = 0, len(source)
        while at < size:
            m = _markup.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            at = max(m.end(), at + 1)
            tag = (m.group(2) or "").lower()
            if not tag:
                continue
            if m.group(1):
                self._end(tag)
            elif tag in HIDDEN:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at) if tag != "head" else None
                if tag != "head":
                    at = end.end() if end else (size if tag in ("script", "style", "textarea", "title") else at)
            else:
                self._start(tag, m.group(3))
        self._flush()

    def _text(self, text: str) -> None:
        self._pieces.append(text)
        if self._in_link:
            self._linked += len(text)

    def _flush(self) -> None:
        text = "".join(self._pieces)
        text = " ".join((html.unescape(text) if "&" in text else text).split())
        if text:
            self.blocks.append((self._open[-1], text, min(self._linked, len(text))))
        self._pieces, self._linked = [], 0

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self._in_link = True
        if tag not in BLOCKS:
            if _gap.fullmatch(tag):
                self._pieces.append(" ")
            return
        self._flush()
        self._in_link = False
        tags = self.tag
        if tags[self._open[-1]] == "p" or tags[self._open[-1]][0] == "h" and tags[self._open[-1]] in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._open.pop()
        for ends in ENDED_BY_SAME.get(tag, ()):
            for k in range(len(self._open) - 1, 0, -1):
                if tags[self._open[k]] == ends:
                    del self._open[k:]
                    break
                if tags[self._open[k]] in SCOPES:
                    break
        names = [w for found in _names.findall(attributes) for w in _letters.findall("".join(found).lower())] if "=" in attributes else ()
        self.parent.append(self._open[-1])
        tags.append(tag)
        self.names.append(tuple(names))
        self.inner.append(INNER in attributes)
        self._open.append(len(tags) - 1)

    def _end(self, tag: str) -> None:
        if tag == "a":
            self._in_link = False
        if tag not in BLOCKS:
            if tag in ("td", "th"):
                self._pieces.append(" ")
            return
        self._flush()
        for k in range(len(self._open) - 1, 0, -1):
            if self.tag[self._open[k]] == tag:
                del self._open[k:]
                break

    def evidence(self) -> list[list[str]]:
        """Names of the features that hold at each node."""
        n, tags, parent = len(self.tag), self.tag, self.parent
        own, linked, ends = [0] * n, [0] * n, [0] * n
        start, blocks, total = [-1] * n, [0] * n, 0
        for node, text, inside in self.blocks:
            own[node] += len(text)
            linked[node] += inside
            ends[node] += len(_ends.findall(text))
            blocks[node] += 1
            if start[node] < 0:
                start[node] = total
            total += len(text)
        below, below_linked, below_ends, below_blocks = own[:], linked[:], ends[:], blocks[:]
        shape, children = [""] * n, [[] for _ in range(n)]
        for i in range(n - 1, 0, -1):
            up = parent[i]
            below[up] += below[i]
            below_linked[up] += below_linked[i]
            below_ends[up] += below_ends[i]
            below_blocks[up] += below_blocks[i]
            if start[i] >= 0 and (start[up] < 0 or start[i] < start[up]):
                start[up] = start[i]
            children[up].append(i)
        for i in range(n):
            children[i].reverse()
            shape[i] = tags[i] + "".join(sorted({tags[c] for c in children[i]}))
        out, under, thread = [], [""] * n, [0] * n
        alike, paragraphs, after, kin = [0] * n, [0] * n, [""] * n, ["none"] * n
        for i in range(n):
            counts = Counter(shape[c] for c in children[i] if children[c])
            run, before = sum(tags[c] == "p" and own[c] > 40 for c in children[i]), "first"
            same = Counter(tags[c] for c in children[i] if own[c] > 20)
            most = max(same.values(), default=0)
            for c in children[i]:
                alike[c], paragraphs[c], after[c] = counts.get(shape[c], 0), run, before
                if own[c]:  # among the siblings that have text: how many have its element, and whether most do
                    kin[c] = f"{min(3, same[tags[c]])} {same[tags[c]] == most} {min(3, sum(same.values()))}"
                before = "heading" if tags[c] in HEADINGS else "p" if tags[c] == "p" else "other"
        for i in range(n):
            up = parent[i]
            if i:
                under[i] = tags[up] if tags[up] in TELLING else under[up]
                thread[i] = max(thread[up], min(3, max(0, alike[i] - 1)))
            chars, all_chars = own[i], below[i]
            f = ["bias", "tag " + tags[i], "under " + under[i], f"{tags[up] if i else ''}>{tags[i]}", f"thread {thread[i]}", f"paragraphs {min(paragraphs[i], 4)}", "after " + after[i], f"kin {kin[i]}", f"{tags[i] if tags[i] in ('p', 'div') else 'other'} {kin[i]}"]
            f += ["name " + w for w in self.names[i]]
            if chars:
                size, link = min(chars.bit_length(), 9), 4 * linked[i] // chars
                f += [f"length {size}", f"links {link}", f"ends {min(4, 150 * ends[i] // chars)}", f"{'p' if tags[i] == 'p' else 'h' if tags[i] in HEADINGS else 'o'} {size} {link}"]
            if all_chars:
                mean, share, at = min(9, (all_chars // below_blocks[i]).bit_length()), 5 * all_chars // max(1, total), 5 * max(0, start[i]) // max(1, total)
                link, stops = 4 * below_linked[i] // all_chars, min(4, 150 * below_ends[i] // all_chars)
                f += [f"mean {mean}", f"share {share}", f"at {at}", f"all links {link}", f"all ends {stops}", f"{share} {link} {stops}", f"blocks {min(4, below_blocks[i].bit_length())} {mean}"]
                beyond = total - max(0, start[i]) - all_chars
                f.append(f"beyond {5 * max(0, beyond) // max(1, total)}")
                f.append(f"of {min(4, len(self.blocks))} blocks {share}")
                f.append(f"{'text' if chars else 'none'} {kin[i][0]} {share} of {min(6, len(self.blocks))}")
            else:
                f.append("empty")
            out.append(f)
        return out


class Model:
    """Log-linear weights of the evidence for content, and potentials of (parent, child) labels."""

    def __init__(self):
        self.weight: dict[str, float] = {}
        self.pair = [[0.5, -0.5], [-0.5, 0.5]]

    def messages(self, parent: list[int], evidence: list[list[str]]) -> tuple[list[float], list[list[float]]]:
        """Marginals of content, and per node the joint belief of (parent, own) labels, by sum-product."""
        n, weight, pair = len(parent), self.weight, self.pair
        zero, one = [0.0] * n, [sum([weight.get(f, 0.0) for f in e]) for e in evidence]
        up = [(0.0, 0.0)] * n
        exp, log = math.exp, math.log
        for i in range(n - 1, 0, -1):  # upward: children come after parents in page order
            z, o = zero[i], one[i]
            top = z if z > o else o
            a, b = exp(z - top), exp(o - top)
            up[i] = m = (top + log(a * exp(pair[0][0]) + b * exp(pair[0][1])), top + log(a * exp(pair[1][0]) + b * exp(pair[1][1])))
            zero[parent[i]] += m[0]
            one[parent[i]] += m[1]
        content, joint = [0.0] * n, [[0.0] * 4 for _ in range(n)]
        content[0] = 1 / (1 + exp(max(-700.0, min(700.0, zero[0] - one[0]))))
        for i in range(1, n):  # downward: the parent's belief without this child's message, with the child's own
            p = content[parent[i]]
            z, o = zero[i], one[i]
            c0 = 1 / (1 + exp(max(-700.0, min(700.0, o + pair[0][1] - z - pair[0][0]))))
            c1 = 1 / (1 + exp(max(-700.0, min(700.0, o + pair[1][1] - z - pair[1][0]))))
            joint[i] = j = [(1 - p) * c0, (1 - p) * (1 - c0), p * c1, p * (1 - c1)]
            content[i] = j[1] + j[3]
        return content, joint

    def learn(self, pages: list[tuple[list[int], list[list[str]], list[int]]]) -> None:
        """Gradient steps with adaptive rates on the likelihood of labelled pages."""
        squares: dict[object, float] = defaultdict(float)
        order = list(range(len(pages)))
        for turn in range(PASSES):
            random.Random(turn).shuffle(order)
            for k in order:
                parent, evidence, label = pages[k]
                content, joint = self.messages(parent, evidence)
                slope: dict[object, float] = defaultdict(float)
                for i, e in enumerate(evidence):
                    d = label[i] - content[i]
                    if abs(d) > 1e-3:
                        for f in e:
                            slope[f] += d
                    if i:
                        for ab, belief in enumerate(joint[i]):
                            slope[ab] += (ab == 2 * label[parent[i]] + label[i]) - belief
                for f, g in slope.items():
                    squares[f] += g * g
                    step = STEP * g / math.sqrt(squares[f] + 1e-8)
                    if isinstance(f, int):
                        self.pair[f // 2][f % 2] = max(-4.0, min(4.0, self.pair[f // 2][f % 2] + step))
                    else:
                        self.weight[f] = self.weight.get(f, 0.0) * 0.9999 + step

    def text(self, source: str | None) -> str:
        page = Page(source or "")
        if not page.blocks:
            return ""
        content, _ = self.messages(page.parent, page.evidence())
        return "\n\n".join([text for node, text, _ in page.blocks if content[node] >= CONTENT])


def rendered(title: str, body: list[str], pool: list[str], seed: int) -> str:
    """A page with the given article, in other elements and under invented names, and other parts around it.

    pool holds sentences of other pages; all parts take theirs from it, so no words tell what a part is.
    """
    r = random.Random(seed)
    e = html.escape

    def name() -> str:
        letters = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9)))
        return r.choice(("", f' class="{letters}"', f' id="{letters}"'))

    def part(tag: str, inner: str) -> str:
        return f"<{tag}{name()}>{inner}</{tag}>"

    def words(most: int) -> str:
        found = r.choice(pool).split()
        at = r.randrange(len(found))
        return e(" ".join(found[at : at + r.randint(1, most)]).strip(".,;:"))

    def prose(most: int) -> str:
        return e(" ".join(r.choice(pool) for _ in range(r.randint(1, most))))

    def link() -> str:
        return f'<a href="#">{words(4)}</a>'

    def links() -> str:
        items = [link() for _ in range(r.randint(3, 12))]
        inner = r.choice(("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items), "<p>" + " ".join(items) + "</p>"))
        return part(r.choice(("nav", "div", "div", "aside", "section", "header", "footer")), r.choice(("", f"<h3>{words(3)}</h3>")) + inner)

    def notice() -> str:
        text = prose(2)
        return part(r.choice(("div", "div", "aside", "section")), r.choice((text, f"<p>{text}</p>", f"<p>{text} {link()}</p>", f"<p>{text}</p><button>{words(2)}</button>", f"<div><p>{text}</p></div>")))

    def advert() -> str:
        return part(r.choice(("div", "div", "aside", "section")), r.choice((prose(1), f"{words(2)}: {prose(1)}", f"{prose(1)} {link()}")))

    def form() -> str:
        inner = f"<p>{prose(1)}</p>" * r.randint(0, 1) + "".join(f"<label>{words(2)}</label><input>" for _ in range(r.randint(1, 4)))
        return part(r.choice(("form", "form", "div")), inner)

    def thread() -> str:
        """Items built alike, each with a short line and some sentences: comments, or teasers of other pages."""
        item, line = r.choice(("div",) * 6 + ("li",) * 3 + ("section",) * 2 + ("article",)), r.choice(("<div>%s</div>", "<p>%s</p>", "<h4>%s</h4>", "<header>%s</header>", "<h3><a>%s</a></h3>", "<b>%s</b>", "<b>%s</b>", "%s", "<span>%s</span> "))
        items = []
        for _ in range(r.choice((1, 2, 2, 3, 3, 4, 5, 7, 9))):
            text = "".join(f"<p>{prose(3)}</p>" for _ in range(r.choice((1, 1, 1, 2))))
            items.append(part(item, (line % words(4)) + r.choice((text, text, f"<div>{text}</div>"))))
        return part("ul" if item == "li" else r.choice(("div", "section", "aside")), r.choice(("", f"<h2>{words(3)}</h2>")) + "".join(items))

    def line() -> str:
        return part(r.choice(("footer", "header", "div", "p")), r.choice((f"&copy; {words(6)}", prose(1), f"{words(3)} &middot; {link()}")))

    def around(last: bool) -> str:
        return r.choice((links, links, notice, notice, form, line, thread) if not last else (links, notice, form, line, thread, thread))()

    body = [b[: r.randint(1, 80)] if r.random() < 0.15 else b for b in r.sample(body, r.randint(1, len(body)))]
    if r.random() < 0.12:  # runs of short paragraphs
        body = [html.unescape(words(3)) + r.choice(("", "."))] * r.randint(2, 40) + body[: r.randint(0, 3)]
    bare = r.random() < 0.14  # a page of one or two blocks, with little or nothing around
    if bare:
        body = [b[: r.choice((r.randint(12, 90), r.randint(60, 600)))] for b in body[: r.choice((1, 1, 2, 3))]]
    shown = [f"<h1 {INNER}>{e(title)}</h1>"] * (r.random() < (0.25 if bare else 0.65))
    style = r.choice(("p", "p", "p", "p", "div", "div", None, None))  # one element for all paragraphs, or any
    through = r.random() < 0.1  # paragraphs that are links, or begin with one
    for b in body:
        tag = style or r.choice(("p",) * 12 + ("blockquote", "li", "td", "pre", "li"))
        if style and r.random() < 0.08:
            tag = r.choice(("blockquote", "li", "td", "pre", "li"))
        told = e(b)
        if through or r.random() < 0.04:
            first = e(" ".join(b.split()[: r.randint(2, 8)]))
            told = r.choice((f'<a href="#">{told}</a>', f'<a href="#">{told}</a>', f'<a href="#">{first}</a> {told}'))
        inner = f"<{tag} {INNER}>{told}</{tag}>"
        if r.random() < 0.12:
            shown.append(f"<h2 {INNER}>{words(5)}</h2>")
        shown.append({"li": f"<ul {INNER}>{inner}</ul>", "td": f"<table {INNER}><tr {INNER}>{inner}</tr></table>"}.get(tag, inner))
    if through and r.random() < 0.6:  # a list of links of the article's own
        shown.append(f"<ul {INNER}>" + "".join(f'<li {INNER}><a href="#">{words(8)}</a></li>' for _ in range(r.randint(2, 6))) + "</ul>")
    if not bare and r.random() < 0.45:
        shown.insert(r.randint(1, len(shown)), r.choice((links, notice, form, advert, advert, advert))())
    if r.random() < 0.1:  # text that stands in the article itself
        shown = [e(" ".join(body))]
    article = "".join(shown)
    if r.random() < 0.85 or article[:1] != "<":
        for _ in range(r.choice((1, 1, 2, 3))):
            article = f"<{(t := r.choice(('article', 'article', 'main', 'div', 'div', 'div', 'div', 'section')))} {INNER}{name()}>{article}</{t}>"
    alone = r.random() < 0.2
    some = lambda most: r.choice((0, 0, 0, 1)) if bare else 0 if alone else r.randint(0, most)
    before, after = "".join(around(False) for _ in range(some(4))), "".join(around(True) for _ in range(some(5)))
    inner = f"{before}{article}{after}"
    inner = part("div", inner) if r.random() < 0.4 else inner
    return r.choice((f"<html><body>{inner}</body></html>",) * 4 + (f"<body>{inner}</body>", inner))


def labelled(source: str) -> tuple[list[int], list[list[str]], list[int]] | None:
    """Nodes with labels from the page's own markup: the marks of a rendering, or else its article or main element.

    Sectioning elements other than these within an article are no content, nor is what lies in them.
    """
    page = Page(source)
    label = list(map(int, page.inner))
    if not any(label):
        root = next((i for i, t in enumerate(page.tag) if t in ("article", "main")), None)
        if root is None:
            return None
        for i in range(root, len(label)):
            label[i] = int(i == root or label[page.parent[i]] and page.tag[i] not in ("nav", "aside", "footer", "form"))
    return page.parent, page.evidence(), label


def sample(pages: DataFrame) -> list[str]:
    """The html of at most SAMPLE pages (those of least hash) that name an article or main element outside of comments and hidden elements.

    Pages are ranked by narrow rows; the chosen ones' html alone is collected. Equal pages count once.
    """
    marked = pages.filter(F.col("html").rlike("(?i)<(?:article|main)[ >]") & (F.length("html") <= SAMPLE_CHARS)).select(F.xxhash64("page_id", "html").alias("key"), "html")

    def usable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["key"]][[labelled(h) is not None for h in batch["html"]]]

    def fetch(keys: DataFrame) -> list[str]:
        least = [r["key"] for r in keys.distinct().orderBy("key").limit(SAMPLE).collect()]
        found = marked.filter(F.col("key").isin(least)).groupBy("key").agg(F.first("html").alias("html")).collect() if least else []
        return [r["html"] for r in sorted(found, key=lambda r: r["key"])]

    rows = fetch(marked.select("key"))
    return rows if all(labelled(h) for h in rows) else fetch(marked.mapInPandas(usable, "key bigint"))


def train(pages: DataFrame) -> Model:
    """The model from at most SAMPLE labelled pages of the table and RENDERINGS renderings of each.

    Without labelled pages the model is trained on renderings of invented sentences alone.
    """
    rows, model, known = sample(pages), Model(), []
    texts = []
    for source in rows:
        page, label = Page(source), labelled(source)[2]
        texts.append([t for n, t, _ in page.blocks if label[n]])
    if not any(texts):
        r = random.Random(0)
        texts = [[" ".join("".join(r.choice("aeioustrnl") for _ in range(r.randint(2, 8))) + r.choice(("", "", "", ",", ".")) for _ in range(r.randint(4, 60))) + "." for _ in range(r.randint(2, 8))] for _ in range(SAMPLE)]
    pool = [s for own in texts for t in own for s in _sentences.findall(t[:2000]) if s.split()]
    names = Counter(w for source in rows for w in {w for own in Page(source).names for w in own})
    known += 3 * [labelled(source) for source in rows]
    for k, own in enumerate(texts):
        if own:
            known += [labelled(rendered(own[0][:120], own[1:13] or own, pool, RENDERINGS * k + i)) for i in range(RENDERINGS)]
    rare = {"name " + w for w, n in names.items() if n < NAMED}
    model.learn([(parent, [[f for f in e if not f.startswith("name ") or f not in rare and f[5:] in names] for e in evidence], label) for parent, evidence, label in known])
    return model


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row: the main text of the whole page, blocks joined by an empty line.

    A null or empty html gives an empty text; repeated rows are extracted each; an empty table gives an empty
    result; other columns are ignored. References are decoded and white space within a block becomes one blank.
    """
    model = model or train(pages)
    shared = pages.sparkSession.sparkContext.broadcast((model.weight, model.pair))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model()
        own.weight, own.pair = shared.value
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.iloc[at : at + ROWS]
                text = [own.text(h) for h in batch["html"]]
                yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": text, "n_chars": list(map(len, text))})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(run, "page_id bigint, url string, text string, n_chars bigint")
