"""Main text of web pages: boosted trees over features of DOM nodes, decoded along the tree.

A page becomes a tree of elements. Each element that starts a block gets features: its tag, the kinds
of words in its class, id and role, depth, density of text, links and tags below it, and how it compares
with its siblings. Boosted trees score each node; decoding takes the best labelling in which what is
dropped is dropped whole, so an ancestor and a descendant never contradict each other.

The model is trained on pages that ``training_pages`` writes by rule, where the main text is known; their
number is a documented bound (TRAINING). No page of the input is used for training.

Cases: a null or empty page has no text; a page that ends early is closed at its end, and what follows an
unfinished tag is part of that tag; an unknown tag is an inline one; an element as likely main text as not is
dropped; very long pages take time in proportion to their length, however they are nested; repeated rows give
equal rows; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import html as entities
import inspect
import random
import re
import sys
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.boosting import Boosted
from millrace.llm.common import returns, shared_dir, ship, table

#: Pages that the model is trained on.
TRAINING = 1600

#: What begins markup: a comment, a declaration or the like, a tag with its name.
_OPEN = re.compile(r"<(?:!--|[!?]|/(?![a-zA-Z>])|(/?)([a-zA-Z][^\s/>]*))")
_QUOTED = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
#: Fixed values of HTML: elements without content, elements whose content is no markup, elements that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noframes iframe xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul button template svg".split()
)
#: An open element that a start tag closes: the tags, and where the search for it ends.
_CLOSES = {t: ({"p"}, {"button", "td", "th", "table"}) for t in BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "caption", "button", "legend"}} | {
    "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}
#: Never shown, or never text of a page.
HIDDEN = frozenset("head script style title template svg textarea noframes iframe xmp select button noscript".split())

GROUPS = {
    "content": "article content post entry story main body text article-body articlebody blog page-content prose copy",
    "navigation": "nav navigation menu navbar breadcrumb breadcrumbs topbar toolbar pagination pager tabs toc skip navlist",
    "head": "header masthead banner hero branding logo top",
    "foot": "footer foot bottom colophon copyright legal credits contentinfo",
    "side": "sidebar side aside rail widget widgets complementary related recommended recommendations more trending popular latest",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner dfp adsense adbox outbrain taboola",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup paywall message dialog toast",
    "comment": "comment comments reply replies respond discussion disqus commentlist feedback review",
    "share": "share sharing social follow twitter facebook like tags meta byline author",
    "form": "form search login register input poll survey contact",
}
_GROUP_OF: dict[str, list[int]] = {}
for _i, _words in enumerate(GROUPS.values()):
    for _w in _words.split():
        _GROUP_OF.setdefault(_w, []).append(_i)
TAGS = "article main section div p h1 h2 h3 ul ol li nav header footer aside form table blockquote pre figure figcaption td body html fieldset dl address details".split()
_TAG_OF = {t: i for i, t in enumerate(TAGS)}
NUMBERS = ("depth", "text", "links", "marks", "children", "place", "share", "of_parent", "siblings", "to_siblings", "word_length", "same_tag", "link_count", "in_content")
FEATURES = len(TAGS) + len(GROUPS) + len(NUMBERS)


@cache
def _words_of(attributes: str) -> tuple[int, ...]:
    """Groups of words that a class, id or role names."""
    found = set()
    for _, a, b, c in _ATTRIBUTE.findall(attributes):
        for w in _SPLIT.split((a or b or c).lower()):
            found.update(_GROUP_OF.get(w, ()))
    return tuple(sorted(found))


@cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])", re.I)


class Page:
    """Block elements of a page in order, and its pieces of text with the element they stand in."""

    def __init__(self, source: str):
        self.tag, self.parent, self.groups, self.tags_in = ["#"], [-1], [()], [0]
        #: (element, text, is it in a link), and (element, None, False) where a block is broken off.
        self.pieces: list[tuple[int, str | None, bool]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        """One pass. What is open is kept by name, so that no tag looks through the whole stack for another."""
        # The stack has (tag, block element); inline elements share the block of what is around them.
        stack: list[tuple[str, int]] = [("#", 0)]
        #: Places on the stack: of each name, of block elements, of those that end the search for an open list item.
        opened: dict[str, list[int]] = {}
        blocks, hard = [0], [0]
        at, size = 0, len(source)
        add = self.pieces.append

        def push(name: str, element: int) -> None:
            opened.setdefault(name, []).append(len(stack))
            if name in BLOCK:
                blocks.append(len(stack))
                if name not in ("p", "div", "address"):
                    hard.append(len(stack))
            stack.append((name, element))

        def pop_to(k: int) -> None:
            while len(stack) > k:
                opened[stack.pop()[0]].pop()
            for places in (blocks, hard):
                while places[-1] >= k:
                    places.pop()

        def last(names) -> int:
            return max([opened[t][-1] for t in names if opened.get(t)], default=0)

        def in_link() -> bool:
            return bool(opened.get("a"))

        while at < size:
            m = _OPEN.search(source, at)
            add((stack[-1][1], source[at : m.start() if m else size], in_link()))
            if m is None:
                break
            name = m[2]
            if name is None:
                end = source.find("-->", m.end()) + 3 if m[0] == "<!--" else source.find(">", m.end()) + 1
                at = end if end > 3 or (end and m[0] != "<!--") else size
                continue
            name, at = name.lower(), self._tag_end(source, m.end())
            if not at:
                break  # the page ends inside a tag
            attributes = source[m.end() : at - 1]
            if m[1]:
                k = last((name,))
                # An inline element isn't closed from inside a block within it; a link is.
                if k and (name in BLOCK or name == "a" or k > blocks[-1]):
                    if stack[k][1] != stack[k - 1][1] or name in BLOCK:
                        add((stack[k - 1][1], None, False))
                    pop_to(k)
                continue
            if name in BLOCK:
                if name in _CLOSES:
                    ends, stop = _CLOSES[name]
                    bound = last(stop)
                    if name in ("li", "dt", "dd") and stack[hard[-1]][0] not in ends:
                        bound = max(bound, hard[-1])
                    low = last(ends - {"p"})
                    if low <= bound:
                        low = last(("p",)) if "p" in ends else 0
                    if low > bound:
                        pop_to(low)
                up = stack[-1][1]
                add((up, None, False))
                if name in VOID:
                    continue
                self.tag.append(name)
                self.parent.append(up)
                self.groups.append(_words_of(attributes) if attributes else ())
                self.tags_in.append(0)
                push(name, len(self.tag) - 1)
                continue
            self.tags_in[stack[-1][1]] += 1
            if name in RAW:
                end = _raw_end(name).search(source, at)
                at = (self._tag_end(source, end.end()) if end else 0) or size
                continue
            if name in VOID:
                if name == "br":
                    add((stack[-1][1], " ", False))
                continue
            if not attributes.rstrip().endswith("/"):
                push(name, stack[-1][1])

    @staticmethod
    def _tag_end(source: str, at: int) -> int:
        """The place after the > that ends a tag, outside of quotes; 0 if there is none."""
        while m := _QUOTED.search(source, at):
            if m[0] == ">":
                return m.end()
            at = source.find(m[0], m.end()) + 1
            if not at:
                break
        return 0

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent = np.array(self.parent)
        text, linked, marks, words, link_count = (np.zeros(n) for _ in range(5))
        for e, t, in_link in self.pieces:
            if t:
                k = len(t)
                text[e] += k
                if in_link:
                    linked[e] += k
                    link_count[e] += 1
                marks[e] += t.count(".") + t.count(",")
                words[e] += t.count(" ") + 1
        tags = np.array(self.tags_in, float) + 1
        before = np.cumsum(text) - text
        depth, inside = np.zeros(n), np.zeros(n)
        children = np.bincount(parent[1:], minlength=n) if n > 1 else np.zeros(n)
        for i in range(1, n):
            p = self.parent[i]
            depth[i] = depth[p] + 1
            inside[i] = inside[p] or self.tag[i] in ("article", "main")
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            for a in (text, linked, marks, tags, words, link_count):
                a[p] += a[i]
        total = max(text[0], 1)
        up = np.maximum(parent, 0)
        kin = np.maximum(children[up], 1)
        mean = text[up] / kin
        same: dict[tuple[int, str], int] = {}
        for i in range(1, n):
            same[self.parent[i], self.tag[i]] = same.get((self.parent[i], self.tag[i]), 0) + 1
        x = np.zeros((n, FEATURES))
        for i in range(n):
            k = _TAG_OF.get(self.tag[i])
            if k is not None:
                x[i, k] = 1
            for g in self.groups[i]:
                x[i, len(TAGS) + g] = 1
        x[:, len(TAGS) + len(GROUPS) :] = np.stack(
            [np.minimum(depth, 12), np.log1p(text), linked / np.maximum(text, 1), 100 * marks / np.maximum(text, 1), np.log1p(children), before / total, text / total, text / np.maximum(text[up], 1),
             np.log1p(kin), np.log1p(text) - np.log1p(mean), text / np.maximum(words, 1), [same.get((self.parent[i], self.tag[i]), 0) / kin[i] for i in range(n)], np.log1p(link_count), inside], axis=1)
        return x

    def decode(self, odds: np.ndarray) -> np.ndarray:
        """Elements to keep: the labelling of highest likelihood in which a dropped element has no kept descendant.

        The odds are those of an element whose parent is kept; below a dropped one nothing is left to decide.
        """
        n = len(self.tag)
        yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        for i in range(n):
            if self.tag[i] in HIDDEN:
                yes[i] = -1e9
        keep, drop = yes.copy(), no.copy()
        keep[0] = 0
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            keep[p] += max(keep[i], drop[i])
        kept = np.zeros(n, bool)
        kept[0] = True
        for i in range(1, n):
            kept[i] = kept[self.parent[i]] and keep[i] > drop[i]
        return kept

    def text(self, kept: np.ndarray) -> str:
        blocks, run = [], []
        for e, t, _ in self.pieces:
            if t is None:
                if run:
                    blocks.append("".join(run))
                    run = []
            elif kept[e]:
                run.append(t)
        blocks.append("".join(run))
        # References are decoded before white space is collapsed.
        done = (" ".join(entities.unescape(b).split()) if "&" in b else " ".join(b.split()) for b in blocks)
        return "\n".join(b for b in done if b)


def training_pages(n: int = TRAINING, seed: int = 7) -> Iterator[tuple[str, str]]:
    """(html, main text) of pages written by rule. Main blocks hold the letter m in each word, others none."""
    rng = random.Random(seed)

    def words(k: int, main: bool) -> str:
        out = []
        for _ in range(k):
            w = "".join(rng.choice("abcdefghijklno") for _ in range(rng.randrange(2, 9)))
            out.append(w[: len(w) // 2] + ("m" if main else "z") + w[len(w) // 2 :] + rng.choice(["", "", "", "", ",", "."]))
        return " ".join(out) + "."

    def attr(group: str, tag: str = "div") -> str:
        w = rng.choice(GROUPS[group].split())
        w = rng.choice([w, f"{w}-{rng.choice(['box', 'area', 'wrap', 'list', 'block', 'inner'])}", f"{rng.choice(['page', 'site', 'the', 'js'])}-{w}"])
        return f'<{tag} {rng.choice(["class", "class", "id"])}="{w}">'

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(rng.randrange(1, 4), False)}</a></li>' for i in range(k))

    def boilerplate(group: str) -> str:
        k = rng.randrange(1, 9)
        if group == "navigation":
            body = f"<ul>{links(k)}</ul>"
            return f"<nav>{body}</nav>" if rng.random() < 0.6 else attr(group) + body + "</div>"
        if group == "head":
            body = rng.choice([f"<h1>{words(3, False)}</h1>", f"<p>{words(4, False)}</p>", words(3, False)]) + (f"<ul>{links(k)}</ul>" if rng.random() < 0.4 else "")
            return f"<header>{body}</header>" if rng.random() < 0.6 else attr(group) + body + "</div>"
        if group == "foot":
            body = rng.choice([f"&copy; {words(rng.randrange(2, 24), False)}", f"&copy; site &middot; {words(rng.randrange(2, 24), False)}", f"<p>{words(rng.randrange(3, 20), False)}</p>", f"<ul>{links(k)}</ul>{words(4, False)}"])
            return f"<footer>{body}</footer>" if rng.random() < 0.7 else attr(group) + body + "</div>"
        if group == "side":
            body = rng.choice([f"<h3>{words(2, False)}</h3><ul>{links(k)}</ul>", f"<h2>{words(2, False)}</h2><p>{words(rng.randrange(5, 40), False)}</p>"])
            return f"<aside>{body}</aside>" if rng.random() < 0.6 else attr(group, rng.choice(["div", "section"])) + body + "</div>"
        if group == "comment":
            body = "".join(f'<{t}>{words(rng.randrange(3, 60), False)}</{t}>' for t in [rng.choice(["p", "div", "li", "article"])] * k)
            t = rng.choice(["div", "section", "ol", "ul"])
            return attr(group, t) + (f"<h3>{words(2, False)}</h3>" if rng.random() < 0.5 else "") + body + f"</{t}>"
        if group == "form":
            return f'<form action="/s"><label>{words(2, False)}</label><input name="q"><button>{words(1, False)}</button></form>' if rng.random() < 0.7 else attr(group) + words(5, False) + "</div>"
        body = rng.choice([words(rng.randrange(2, 30), False), f"<p>{words(rng.randrange(2, 40), False)}</p>", f'<a href="/x">{words(4, False)}</a>'])
        t = rng.choice(["div", "div", "section", "aside"] if body.startswith("<p") else ["div", "div", "section", "p", "aside"])
        return attr(group, t) + body + f"</{t}>"

    def block(main: list[str]) -> str:
        def say(k: int) -> str:
            main.append(words(k, True))
            return main[-1]

        k = rng.choice([1, 2, 5, 20, 40, 90])
        kind = rng.random()
        if kind < 0.7:
            return f"<p>{say(k)}</p>" if rng.random() < 0.8 else f"<p><b>{say(k)}<br>"
        if kind < 0.8:
            return f"<h{(h := rng.randrange(2, 4))}>{say(rng.randrange(1, 8))}</h{h}>"
        if kind < 0.88:
            return "<ul>" + "".join(f"<li>{say(rng.randrange(1, 15))}</li>" for _ in range(rng.randrange(1, 6))) + "</ul>"
        if kind < 0.92:
            return f"<blockquote><p>{say(k)}</p></blockquote>"
        if kind < 0.96:
            return "<table><tr>" + "".join(f"<td>{say(rng.randrange(1, 6))}</td>" for _ in range(3)) + "</tr></table>"
        form = rng.choice(["<pre>%s</pre>", "<div>%s</div>", "<figure><figcaption>%s</figcaption></figure>", "<section><h2>%s</h2></section>"])
        return form % say(k)

    for _ in range(n):
        main: list[str] = []
        inner = f"<h1>{(main.append(words(rng.randrange(2, 9), True)), main[-1])[1]}</h1>" if rng.random() < 0.85 else ""
        if inner and rng.random() < 0.15:
            inner = f"<header>{inner}</header>"
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6, 10, 20]) if inner else rng.randrange(1, 9)):
            inner += block(main)
            if rng.random() < 0.08:
                inner += boilerplate(rng.choice(["advert", "share", "side", "notice", "form"]))
        if rng.random() < 0.12:
            inner += boilerplate("comment")
        shape = rng.random()
        if shape < 0.55:
            article = f"<article>{inner}</article>"
        elif shape < 0.8:
            article = attr("content") + inner + "</div>"
        else:
            article = f"<main>{inner}</main>"
        if rng.random() < 0.3:
            article = rng.choice(["<main>%s</main>", '<div class="wrapper">%s</div>', '<div id="page">%s</div>', '<div class="container"><div class="row">%s</div></div>']) % article
        early = [boilerplate(g) for g in ("head", "navigation", "notice", "advert", "form") if rng.random() < 0.4]
        late = [boilerplate(g) for g in ("side", "comment", "advert", "notice", "share", "navigation") if rng.random() < 0.35]
        rng.shuffle(early), rng.shuffle(late)
        if rng.random() < 0.8:
            late.append(boilerplate("foot"))
        yield f"<!DOCTYPE html><html><head><title>{words(3, False)}</title></head><body>{''.join(early)}{article}{''.join(late)}</body></html>", "\n".join(main)


@cache
def model(n: int = TRAINING) -> Boosted:
    """Trained on ``n`` rule-written pages: an element is main if main text stands below it."""
    xs, ys = [], []
    for source, _ in training_pages(n):
        page = Page(source)
        main, own = np.zeros(len(page.tag), bool), np.zeros(len(page.tag), bool)
        for e, t, _ in page.pieces:
            if t and t.strip():
                own[e] = True
                main[e] |= all("m" in w for w in t.split() if w.strip(".,"))
        for i in range(len(page.tag) - 1, 0, -1):
            main[page.parent[i]] |= main[i]
            own[page.parent[i]] |= own[i]
        # Odds are given that the parent is kept, so only such elements teach.
        shown = own & np.array([t not in HIDDEN and t != "#" for t in page.tag]) & (main[np.maximum(page.parent, 0)])
        xs.append(page.features()[shown])
        ys.append(main[shown])
    return Boosted(depth=4, rounds=60).fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def fitted(spark: SparkSession, n: int = TRAINING) -> Boosted:
    """The model, trained once for this version of the code and kept in the shared folder. A file that can't be read is made anew."""
    version = hashlib.sha256("".join([str(n), *(inspect.getsource(m) for m in (sys.modules[__name__], sys.modules[Boosted.__module__]))]).encode()).hexdigest()[:16]
    name = f"{shared_dir(spark)}/millrace-models/html-{version}.json"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(name)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        stream = fs.open(path)
        try:
            return Boosted.from_json(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except (ValueError, KeyError, TypeError):
            pass
        finally:
            stream.close()
    made = model(n)
    part = jvm.org.apache.hadoop.fs.Path(f"{name}.{uuid.uuid4().hex}")
    out = fs.create(part)
    out.write(bytearray(made.to_json().encode()))
    out.close()
    fs.delete(path, False)
    if not fs.rename(part, path):  # another application was faster
        fs.delete(part, False)
    return made


def extract_all(sources: list[str | None], trees: Boosted) -> list[str]:
    """Main texts of pages; nodes of all of them are scored at once."""
    pages = [Page(s or "") for s in sources]
    xs = [p.features() for p in pages]
    odds = trees.log_odds(np.concatenate(xs)) if xs else np.zeros(0)
    out, at = [], 0
    for p in pages:
        out.append(p.text(p.decode(odds[at : at + len(p.tag)])))
        at += len(p.tag)
    return out


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", training: int = TRAINING) -> DataFrame:
    """id, url, text and n_chars of every page."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(fitted(df.sparkSession, training))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                texts = extract_all(part.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return df.select(id_col, url_col, html_col).mapInArrow(run, returns(df, [id_col, url_col], "text string, n_chars bigint"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
