"""Page layouts with known labels, to train the extraction's trees: an article between menus, headers, footers,
sidebars, notices, adverts, forms and comments, under the many names that pages give them, under names that say nothing,
or without any element of its own."""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Callable, Iterator

ARTICLE = ("<article>", '<main>', '<div id="content">', '<div class="post">', '<article class="entry">', '<section class="story">', '<div class="article-body">', '<div role="main">', "<div>", '<div class="c-12 x">')


def words(r: random.Random, low: int, high: int) -> list[str]:
    return ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9))) + r.choice(["", "", "", "", "", "", "###", "!!", "***"] if high > 40 and r.random() < 0.1 else [""]) for _ in range(r.randint(low, high))]


def sentence(r: random.Random, low: int, high: int) -> str:
    return " ".join(words(r, low, high)) + r.choice([".", ".", ".", "", "!", "?"])


def prose(r: random.Random) -> str:
    return " ".join(sentence(r, 2, 25) for _ in range(r.choice([1, 1, 2, 4, 8, 15])))


def links(r: random.Random, low: int = 2, high: int = 9) -> str:
    return "".join(f'<li><a href="/{w}">{w}</a></li>' for w in words(r, low, high))


def wrap(r: random.Random, tags: list[str], inner: str) -> str:
    start = r.choice(tags)
    return f"{start}{inner}</{start[1:].split()[0].rstrip('>')}>"


def junk(r: random.Random, kind: str) -> str:
    """One boilerplate part."""
    short = sentence(r, 2, 12)
    made = {
        "menu": lambda: wrap(r, ["<nav>", '<nav class="menu">', '<div class="nav">', '<div id="menu">', '<ul class="breadcrumb">', "<nav>"], f"<ul>{links(r)}</ul>"),
        "header": lambda: wrap(r, ["<header>", '<div class="header">', '<div id="masthead">', '<header class="site-header">'], f'<div class="logo">{short}</div>' + (f"<ul>{links(r)}</ul>" if r.random() < 0.5 else f"<p>{short}</p>")),
        "footer": lambda: wrap(r, ["<footer>", "<footer>", '<div class="footer">', '<div id="footer">', '<div class="copyright">'], f"&copy; {short}" + r.choice(["", "", f" {sentence(r, 3, 30)}", f" {prose(r)}"]) + (f"<p>{sentence(r, 3, 30)}</p>" if r.random() < 0.4 else "") + (f"<ul>{links(r)}</ul>" if r.random() < 0.4 else "")),
        "side": lambda: wrap(r, ["<aside>", '<div class="sidebar">', '<div id="sidebar">', '<aside class="widget">', '<section class="related">', '<div class="related-posts">'], f"<h3>{short}</h3>" + (f"<ul>{links(r)}</ul>" if r.random() < 0.6 else f"<p>{prose(r)}</p>")),
        "advert": lambda: wrap(r, ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div id="ad-1">', '<aside class="sponsored">', '<section class="promo">'], r.choice([short, prose(r), f"<p>{short}</p>", f'<p>{short}</p><a href="/x">{short}</a>'])),
        "notice": lambda: wrap(r, ['<div class="cookie-notice">', '<div id="cookie-banner">', '<div class="consent">', '<section class="notice">', '<div class="alert">', '<div role="alert">', '<div class="popup">', '<dialog>'], f"<p>{r.choice([short, prose(r)])}</p>" + ("<button>ok</button>" if r.random() < 0.5 else "")),
        "form": lambda: wrap(r, ["<form>", '<form class="search">', '<form id="newsletter">', '<div class="subscribe">', '<div class="newsletter">', '<div class="login">'], r.choice([f"<p>{short}</p>", f"<label>{short}</label>", f"<h3>{short}</h3><p>{sentence(r, 4, 20)}</p>"]) + '<input name="q"><button>go</button>'),
        "comment": lambda: wrap(r, ['<section id="comments">', '<div class="comments">', '<div id="disqus">', '<section class="discussion">', '<ol class="commentlist">'], (f"<h3>{short}</h3>" if r.random() < 0.6 else "") + "".join(r.choice(['<div class="comment">', '<li class="comment">', "<div>", '<article class="comment">', "<p>"]).replace(">", f"><p>{r.choice([short, prose(r)])}</p>", 1) for _ in range(r.randint(1, 6)))),
        "share": lambda: wrap(r, ['<div class="share">', '<ul class="social">', '<div class="tags">', '<div class="share-buttons">'], f"<ul>{links(r, 1, 5)}</ul>"),
    }
    return made[kind]()


def body(r: random.Random) -> str:
    """The parts of an article."""
    parts = [f"<h1>{sentence(r, 1, 12)}</h1>"] if r.random() < 0.9 else [f"<p>{prose(r)}</p>"]
    for _ in range(r.choice([0, 1, 1, 2, 3, 6, 12])):
        kind = r.random()
        if kind < 0.72:
            parts.append(f"<p>{prose(r)}" + r.choice(["</p>", "</p>", "</p>", "", "<br>"]))
        elif kind < 0.78:
            parts.append(f"<p><b>{prose(r)}<br><p>{prose(r)}</p>")
        elif kind < 0.83:
            parts.append(f"<h2>{sentence(r, 1, 8)}</h2>")
        elif kind < 0.88:
            parts.append("<ul>" + "".join(f"<li>{sentence(r, 1, 20)}</li>" for _ in range(r.randint(2, 7))) + "</ul>")
        elif kind < 0.92:
            parts.append(f"<blockquote><p>{prose(r)}</p></blockquote>")
        elif kind < 0.95:
            parts.append(f'<p>{sentence(r, 3, 20)} <a href="/l">{sentence(r, 1, 5)}</a> {sentence(r, 2, 20)}</p>')
        elif kind < 0.97:
            parts.append("<table>" + "".join(f"<tr><td>{sentence(r, 1, 4)}</td><td>{sentence(r, 1, 4)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
        else:
            parts.append(r.choice([f"<pre>{prose(r)}</pre>", f'<figure><img src="x"><figcaption>{sentence(r, 2, 12)}</figcaption></figure>', prose(r)]))
    return "\n".join(parts)


def renamed(r: random.Random, part: str) -> str:
    """The part in a div whose name says nothing, with its inner landmarks unnamed, too."""
    inner = part[part.index(">") + 1 : part.rindex("<")]
    return f'<div class="{neutral(r)}">{re.sub(r" (?:class|id|role)=.[^>]*?(?=>)", "", inner)}</div>'


def neutral(r: random.Random) -> str:
    return r.choice(["c-12", "x", "b7", "css-1q", "row", "col", "wrap", "inner", "u-2", "g", "sc-ab", "block"]) + r.choice(["", "", " x1", " k2", "_9"])


def around(r: random.Random, change: Callable[[random.Random, str], str] = lambda r, part: part, before: tuple[str, ...] = ("menu", "header", "advert", "notice", "form", "side"), after: tuple[str, ...] = ("comment", "side", "form", "share", "advert", "footer", "menu")) -> tuple[str, str]:
    """Boilerplate ahead of the article, and behind it."""
    ahead = [mark(change(r, junk(r, k)), "o") for k in r.sample(before, r.randint(0, min(4, len(before))))]
    behind = [mark(change(r, junk(r, k)), "o") for k in r.sample(after, r.randint(0, min(4, len(after))))]
    return "".join(ahead), "".join(behind) + (mark(change(r, junk(r, "footer")), "o") if r.random() < 0.6 else "")


def named(r: random.Random) -> tuple[str, bool | None]:
    """The article within an element that many pages name so, boilerplate around and within it."""
    start = r.choice(ARTICLE)
    inner = body(r)
    for _ in range(r.choice([0, 0, 0, 1, 2])):  # boilerplate within the article
        at = r.choice([i for i, c in enumerate(inner) if c == "\n"] or [len(inner)])
        inner = inner[:at] + mark(junk(r, r.choice(["advert", "share", "notice", "form", "side", "comment"])), "o") + inner[at:]
    article = mark(f"{start}{inner}</{start[1:].split()[0].rstrip('>')}>", "y")
    before, after = around(r)
    if r.random() < 0.3:
        article = f'<div class="{r.choice(["wrapper", "container", "row", "page", "layout"])}">{article}{mark(junk(r, r.choice(["side", "comment", "advert"])), "o")}</div>'
    return before + article + after, None


def blocks(r: random.Random) -> list[str]:
    """An article's blocks, each with its mark."""
    found = [f"<h{r.choice('112')}>{sentence(r, 1, 12)}</h1>"] if r.random() < 0.6 else []
    for _ in range(r.choice([1, 1, 2, 2, 3, 5, 9])):
        kind = r.random()
        found.append(f"<p>{prose(r)}</p>" if kind < 0.85 else f"<blockquote>{prose(r)}</blockquote>" if kind < 0.9 else "<ul>" + "".join(f"<li>{sentence(r, 2, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>" if kind < 0.95 else f"<pre>{prose(r)}</pre>")
    return [mark(b, "y") for b in found]


def bare(r: random.Random) -> tuple[str, bool | None]:
    """The article's blocks directly in the body."""
    before, after = around(r) if r.random() < 0.7 else ("", "")
    return before + "\n".join(blocks(r)) + after, None


def loose(r: random.Random) -> tuple[str, bool | None]:
    """Text directly in the body, with line breaks; perhaps headings and inline tags."""
    before, after = around(r) if r.random() < 0.6 else ("", "")
    lines = [r.choice([prose(r), prose(r), f"<b>{sentence(r, 2, 8)}</b> {prose(r)}", f"{sentence(r, 2, 12)} <a href='/x'>{sentence(r, 1, 3)}</a> {sentence(r, 2, 12)}"]) for _ in range(r.choice([1, 2, 4, 8]))]
    head = mark(f"<h1>{sentence(r, 1, 10)}</h1>", "y") if r.random() < 0.4 else ""
    return before + head + r.choice(["<br>", "<br><br>", "\n"]).join(lines) + after, True


def unnamed(r: random.Random) -> tuple[str, bool | None]:
    """Only divs whose names say nothing; boilerplate shows by its links and its shortness."""
    before, after = around(r, renamed, ("menu", "header"), ("menu", "share", "footer"))
    inner = mark(f'<div class="{neutral(r)}">{body(r)}</div>', "y")
    for _ in range(r.randint(0, 2)):
        inner = f'<div class="{neutral(r)}">{inner}</div>'
    return before + inner + after, None


def table(r: random.Random) -> tuple[str, bool | None]:
    """A layout table: a column of links beside the article's."""
    column = f'<td width="20%" data-o><ul>{links(r)}</ul></td>'
    article = f"<td data-y>{''.join(f'<p>{prose(r)}</p>' for _ in range(r.randint(1, 6)))}</td>" if r.random() < 0.7 else f"<td data-y>{'<br>'.join(prose(r) for _ in range(r.randint(1, 5)))}</td>"
    top, foot = (f'<tr data-o><td colspan="2">{x}</td></tr>' if r.random() < 0.6 else "" for x in (links(r, 2, 6), f"&copy; {sentence(r, 1, 6)}"))
    return f"<table>{top}<tr>{''.join(r.sample([column, article], 2))}</tr>{foot}</table>", None


def plain(r: random.Random) -> tuple[str, bool | None]:
    """No markup at all."""
    return r.choice(["\n", "\n\n", " "]).join(prose(r) for _ in range(r.choice([1, 2, 5]))), True


#: Layout families with the weight of each in training.
FAMILIES: dict[str, tuple[Callable[[random.Random], tuple[str, bool | None]], float]] = {"named": (named, 10), "bare": (bare, 3), "loose": (loose, 2), "unnamed": (unnamed, 3), "table": (table, 1), "plain": (plain, 1)}


def examples(pages: int, seed: int, families: tuple[str, ...] | None = None) -> Iterator[tuple[str, Callable]]:
    """(html, function from the parsed nodes to their labels: True article, False boilerplate, None both or neither)."""
    r = random.Random(seed)
    names = list(families or FAMILIES)
    for _ in range(pages):
        family = r.choices(names, [FAMILIES[n][1] for n in names])[0]
        source, own = FAMILIES[family][0](r)
        if family != "plain":
            head = f"<head><title>{sentence(r, 2, 8)}</title></head>" if r.random() < 0.8 else ""
            source = r.choice([f"<!DOCTYPE html><html>{head}<body>{source}</body></html>", f"<html>{head}<body>{source}", f"<body>{source}</body>", source])
        yield source, functools.partial(label, own=own)


def mark(source: str, as_: str) -> str:
    """A mark in the first tag, which `label` finds again: an attribute that the features don't see."""
    head, _, tail = source.partition(">")
    return f"{head} data-{as_}>{tail}"


def label(nodes: list, own: bool | None = None) -> list[bool | None]:
    """A node's label is its nearest mark's, the root's is `own`; a node that holds both kinds has it only if it has text of its own."""
    out: list[bool | None] = []
    number = {id(v): i for i, v in enumerate(nodes)}
    for v in nodes:
        mine = True if v.mark == "y" else False if v.mark == "o" else None
        out.append(mine if mine is not None else out[number[id(v.parent)]] if v.parent else own)
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i].parent
        while up is not None and out[i] is False and out[number[id(up)]] is True:
            if not any(isinstance(p, str) and p.strip() for p in up.parts):
                out[number[id(up)]] = None
            up = up.parent
    return out
