"""Labelled pages for the extraction model.

Each template is a page in which the attribute y="1" opens a content subtree
and y="0" a subtree inside it that is not content. {p} stands for a paragraph,
{s} for a short phrase, {l} for links, {i} for list items with links; the
filler is invented and drawn with a fixed seed. Comments mark what a page shows.
"""

from __future__ import annotations

import random

#: Page layouts and where their content is.
TEMPLATES = [
    # plain article with menu, advert and footer
    '<html><head><title>{s}</title><style>p{{margin:0}}</style></head><body><nav><ul>{i}</ul></nav><div class="ad">{s}</div><article y="1"><h1>{s}</h1><p>{p}</p><p>{p}</p></article><footer>&copy; {s} {p}</footer></body></html>',
    '<html><body><nav><ul>{i}</ul></nav><div class="ad">{s}</div><article y="1"><h1>{s}</h1><p><b>{p}<br><p>{p}</p></article><footer>&copy; {s}</footer>',
    '<html><body><nav><ul>{i}</ul></nav><div class="ad">{p}</div><article y="1"><h1>{s}</h1><p>{p}</p></article><footer>&copy; {s} &middot; {p} {p}</footer></body></html>',
    # short article
    '<html><body><nav><a href="/">{s}</a> {l}</nav><article y="1"><h1>{s}</h1><p>{s}</p></article><footer><p>{s}</p></footer></body></html>',
    # header and main
    '<html><body><header><h1>{s}</h1><p>{s}</p></header><nav>{l}</nav><main y="1"><h1>{s}</h1><p>{p}</p><h2>{s}</h2><p>{p}</p><ul><li>{s}.</li><li>{s}.</li></ul></main><aside y="0"><h3>{s}</h3><ul>{i}</ul></aside><footer>{l} {s}</footer></body></html>',
    # article with its own header, and comments after it
    '<html><body><header><a href="/">{s}</a></header><main><article y="1"><header><h1>{s}</h1></header><p>{p}</p><p>{p}</p><section class="comments" y="0"><h2>{s}</h2><div class="comment"><p>{p}</p></div><div class="comment"><p>{s}</p></div></section></article></main><footer><p>{p}</p></footer></body></html>',
    '<html><body><div id="header"><div class="logo">{s}</div><ul class="menu">{i}</ul></div><div id="content" y="1"><h1>{s}</h1><div class="entry"><p>{p}</p><p>{p}</p><blockquote><p>{p}</p></blockquote></div></div><div id="sidebar"><div class="widget"><h3>{s}</h3><ul>{i}</ul></div><p>{p}</p></div><div id="footer"><p>{s}</p><p>{p}</p></div></body></html>',
    # comments beside the article
    '<html><body><div class="wrapper"><div class="topbar">{l}</div><div class="post" y="1"><h2>{s}</h2><p>{p}</p><pre>{s}</pre><p>{p}</p></div><div id="comments"><h3>{s}</h3><ol class="commentlist"><li class="comment"><div class="comment-body"><p>{p}</p></div></li><li class="comment"><p>{p}</p></li></ol></div><form class="respond"><label>{s}</label><input><button>{s}</button></form></div><div class="copyright">{s}</div></body></html>',
    # cookie notice and newsletter form
    '<html><body><div class="cookie-notice"><p>{p}</p><button>{s}</button></div><div class="container"><div class="article-body" y="1"><h1>{s}</h1><p>{p}</p><h2>{s}</h2><p>{p}</p><table><tr><td>{s}</td><td>{s}</td></tr></table></div><div class="newsletter"><p>{p}</p><form><input><button>{s}</button></form></div></div><footer>{l}</footer></body></html>',
    '<html><body><div id="consent-banner" role="dialog">{p} {l}</div><main y="1"><p>{p}</p><div class="advert" y="0"><p>{s}</p></div><p>{p}</p><figure><figcaption>{s}</figcaption></figure></main></body></html>',
    # related links and shares in the article
    '<html><body><div class="nav">{l}</div><article y="1"><h1>{s}</h1><div class="share" y="0">{l}</div><p>{p}</p><p>{p}</p><div class="related" y="0"><h3>{s}</h3><ul>{i}</ul></div><p>{p}</p></article><div class="sponsored"><p>{p}</p></div><footer><div>{s}</div></footer></body></html>',
    '<html><body><header role="banner"><h2>{s}</h2><form role="search"><input></form></header><section y="1"><h1>{s}</h1><p>{p}</p><p>{s}</p><dl><dt>{s}</dt><dd>{p}</dd></dl></section><aside><p>{p}</p><p>{p}</p></aside><footer><ul>{i}</ul></footer></body></html>',
    # plain divs, no names
    '<html><body><div><a href="/">{s}</a> {l}</div><div y="1"><h1>{s}</h1><p>{p}</p><p>{p}</p><p>{p}</p></div><div>{l}</div></body></html>',
    '<html><body><table><tr><td>{l}</td><td y="1"><h1>{s}</h1><p>{p}</p><p>{p}</p></td></tr></table></body></html>',
    '<html><body><h1 y="1">{s}</h1><p y="1">{p}</p><p y="1">{p}</p><p y="1">{p}</p></body></html>',
    '<html><body><ul class="breadcrumb">{i}</ul><h1 y="1">{s}</h1><p y="1">{p}</p><h2 y="1">{s}</h2><p y="1">{p}</p><div class="promo">{p}</div></body></html>',
    # hardly anything but the text
    '<html><body><article y="1"><p>{p}</p></article></body></html>',
    '<html><body><p y="1">{p}</p></body></html>',
    '<html><body><main y="1"><p>{s}.</p></main></body></html>',
    '<html><body><div y="1"><p>{p}</p><p>{s}.</p></div></body></html>',
    '<html><head><title>{s}<body><article y="1"><h1>{s}</h1><p>{p}</article></body></html>',
    # fragments without a body; text without a mark around it is content of the page itself
    '<p y="1">{p}</p>',
    '<h1 y="1">{s}</h1><p y="1">{p}</p><p y="1">{p}</p>',
    '<p y="1">{p}</p><p y="1">{s}.</p><ul y="0">{i}</ul>',
    '<div y="0">{l}</div><p y="1">{p}</p><div class="footer" y="0">{s}</div>',
    "{p}",
    "{p} {p}<br>{p}",
    # only boilerplate
    '<html><body><nav><ul>{i}</ul></nav><form><label>{s}</label><input></form><footer><p>{s}</p></footer></body></html>',
    '<html><body><nav>{l}</nav><div class="notice">{p}</div><footer>{s}</footer></body></html>',
    # nested wrappers
    '<html><body><div id="page"><div id="masthead"><p>{s}</p></div><div id="main"><div class="story" y="1"><h1>{s}</h1><div><p>{p}</p><div><p>{p}</p></div></div></div><div class="sidebar"><section><h3>{s}</h3><p>{p}</p></section></div></div><div id="colophon"><p>{p}</p></div></div></body></html>',
    '<html><body><div class="menu"><ul>{i}</ul></div><div class="text" y="1"><p>{p}</p><ul><li>{p}</li><li>{p}</li></ul><p>{p}</p></div><div class="reader-comments"><article><p>{p}</p></article><article><p>{p}</p></article></div></body></html>',
    '<html><body><main><article y="1"><h1>{s}</h1><p>{p}</p><aside class="pullquote" y="0"><p>{s}</p></aside><p>{p}</p><footer y="0"><p>{s}</p></footer></article><section id="comments"><article class="comment"><header>{s}</header><p>{p}</p></article></section></main></body></html>',
    '<html><body><div class="banner-ad">{s}</div><div role="navigation">{l}</div><div role="main" y="1"><h1>{s}</h1><p>{p}</p><p>{p}</p></div><div role="complementary"><p>{p}</p></div><div role="contentinfo"><p>{p}</p></div></body></html>',
]
#: Filler words.
WORDS = "amber bridge carry distant ember field gather harbour island journey kindle lantern meadow narrow orchard plain quiet river signal timber under valley winter yellow".split()


def _phrase(rng: random.Random, low: int, high: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(low, high))).capitalize()


def pages(copies: int = 4, seed: int = 20) -> list[str]:
    """Each template ``copies`` times, with other filler; {p} is long in some copies and short in others."""
    rng = random.Random(seed)
    made = []
    for c in range(copies):
        for template in TEMPLATES:
            parts = template.replace("{{", "\0").replace("}}", "\1").split("{")
            text = parts[0]
            for part in parts[1:]:
                kind, rest = part[0], part[2:]
                if kind == "p":
                    fill = " ".join(_phrase(rng, 4, 14) + rng.choice([".", ".", ", and.", "?"]) for _ in range(rng.randint(1, 2 + 3 * c)))
                elif kind == "s":
                    fill = _phrase(rng, 1, 7)
                elif kind == "l":
                    fill = " ".join(f'<a href="/{i}">{_phrase(rng, 1, 2)}</a>' for i in range(rng.randint(2, 6)))
                else:
                    fill = "".join(f'<li><a href="/{i}">{_phrase(rng, 1, 2)}</a></li>' for i in range(rng.randint(2, 6)))
                text += fill + rest
            made.append(text.replace("\0", "{").replace("\1", "}"))
    return made
