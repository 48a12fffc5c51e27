"""Invented pages whose every block is marked with what it is, in three styles of markup: by element names, by class names of
many sites' kinds, and with hardly a hint (numbered divisions)."""

import random

KINDS = {  # kind: (element, class names)
    "menu": ("nav", ("main-menu", "navbar", "site-nav", "breadcrumbs")),
    "header": ("header", ("site-header", "masthead", "topbar")),
    "footer": ("footer", ("site-footer", "footer-links", "copyright")),
    "sidebar": ("aside", ("sidebar", "right-rail", "widget")),
    "notice": ("div", ("cookie-notice", "gdpr-consent", "privacy-banner")),
    "advert": ("div", ("ad", "sponsored", "advert-box")),
    "form": ("form", ("newsletter-signup", "login", "search-box")),
    "comments": ("section", ("comments", "replies", "discussion")),
    "related": ("aside", ("related", "recommended", "share-buttons")),
}
WORDS = "the of and to in a is that it was for on are as with his they at be this have from or one had by word but not what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more write go see number no way could people".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + rng.choice((".", ".", ".", "?", "!"))


def page(seed, style):
    """(html, [(marker, kind)]): a block holds its marker, a word of its own."""
    rng = random.Random(f"{style}{seed}")
    marks = []

    def mark(kind):
        marks.append((f"zq{seed}x{len(marks)}q", kind))
        return marks[-1][0]

    def prose(kind, n):
        return f"{mark(kind)} " + " ".join(sentence(rng, rng.randint(6, 16)) for _ in range(n))

    def wrap(kind, inner):
        tag, names = KINDS[kind]
        if style == "elements":
            return f"<{tag}>{inner}</{tag}>" if tag != "div" and tag != "section" else f'<div class="{rng.choice(names)}">{inner}</div>'
        if style == "classes":
            return f'<div class="{rng.choice(names)}">{inner}</div>'
        return f'<div id="b{rng.randint(1, 99)}">{inner}</div>'

    def links(kind, n):
        return "<ul>" + "".join(f'<li><a href="/{k}">{mark(kind)} {rng.choice(WORDS)}</a></li>' for k in range(n)) + "</ul>"

    def part(kind):
        if kind in ("menu", "related", "footer"):
            return wrap(kind, links(kind, rng.randint(3, 7)) + (f"<p>&copy; {mark(kind)} {rng.choice(WORDS)}</p>" if kind == "footer" else ""))
        if kind == "header":
            return wrap(kind, f'<a href="/">{mark(kind)}</a> {rng.choice(WORDS)}')
        if kind == "form":
            return wrap(kind, f'<p>{mark(kind)} {rng.choice(WORDS)}</p><input name="q"><button>{mark(kind)}</button>')
        if kind == "comments":
            return wrap(kind, "".join(f"<div><b>{rng.choice(WORDS)}</b><p>{prose(kind, rng.randint(1, 3))}</p></div>" for _ in range(rng.randint(1, 5))))
        return wrap(kind, f"<p>{prose(kind, rng.randint(1, 2))}</p>")

    main = [f"<h1>{mark('heading')} {sentence(rng, 5)[:-1]}</h1>"]
    for _ in range(rng.randint(3, 9)):
        kind = rng.choice(("paragraph", "paragraph", "paragraph", "short paragraph", "list", "subheading", "quotation"))
        if kind == "list":
            main.append("<ul>" + "".join(f"<li>{mark(kind)} {sentence(rng, rng.randint(3, 9))}</li>" for _ in range(rng.randint(2, 4))) + "</ul>")
        elif kind == "short paragraph":
            main.append(f"<p>{mark(kind)} {sentence(rng, rng.randint(2, 5))}</p>")
        elif kind == "subheading":
            main.append(f"<h2>{mark(kind)} {sentence(rng, 3)[:-1]}</h2><p>{prose('paragraph', 3)}</p>")
        elif kind == "quotation":
            main.append(f"<blockquote>{prose(kind, 2)}</blockquote>")
        else:
            main.append(f"<p>{prose(kind, rng.randint(2, 6))}</p>")
    if rng.random() < 0.5:
        main.insert(rng.randint(2, len(main)), part("advert"))
    body = {"elements": "<article>{}</article>", "classes": '<div class="post-content">{}</div>', "plain": '<div id="b0">{}</div>'}[style].format("".join(main))
    before = [part(k) for k in ("header", "menu", "notice", "form") if rng.random() < 0.7]
    after = [part(k) for k in ("comments", "related", "sidebar", "form", "footer") if rng.random() < 0.6]
    return f"<!DOCTYPE html><html><head><title>x</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>", marks


def figures(extract, style, pages=200):
    """{kind: (blocks, share that the text holds)}."""
    found = {}
    for seed in range(pages):
        raw, marks = page(seed, style)
        text = set(extract(raw).split())
        for m, kind in marks:
            n, hits = found.get(kind, (0, 0))
            found[kind] = (n + 1, hits + (m in text))
    return {k: (n, hits / n) for k, (n, hits) in found.items()}
