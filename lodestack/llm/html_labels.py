"""A small labelled table of web pages for the block classifier of html_text.

Pages are put together from hand-written regions by a fixed rule; a page comes with the texts of its article's
blocks. PAGES is the documented bound of the sample.
"""

from __future__ import annotations

PAGES = 600

_WORDS = (
    "river stone market winter garden paper engine window letter forest silver harbor mountain teacher history village music bridge summer island "
    "system number people water study method result change public energy animal report season travel simple common bright early second former"
).split()


class _Draw:
    """A small linear congruential generator: the table is the same everywhere."""

    def __init__(self, seed: int):
        self.state = seed * 2654435761 % (1 << 32) or 1

    def below(self, n: int) -> int:
        self.state = (self.state * 1664525 + 1013904223) % (1 << 32)
        return (self.state >> 8) % n

    def of(self, options):
        return options[self.below(len(options))]

    def text(self, least: int, most: int) -> str:
        words = [self.of(_WORDS) for _ in range(least + self.below(most - least + 1))]
        return " ".join(words).capitalize() + "."


def _links(d: _Draw, least: int, most: int) -> list[str]:
    return [f'<a href="/{d.of(_WORDS)}">{d.text(1, 3)[:-1]}</a>' for _ in range(least + d.below(most - least + 1))]


def _menu(d: _Draw) -> str:
    items = "".join(f"<li>{x}</li>" for x in _links(d, 2, 9))
    return d.of(["<nav><ul>{}</ul></nav>", '<div class="navbar"><ul>{}</ul></div>', '<ul id="menu">{}</ul>', '<div role="navigation"><ul>{}</ul></div>', '<div class="breadcrumb"><ul>{}</ul></div>', "<div><ul>{}</ul></div>"]).format(items)


def _header(d: _Draw) -> str:
    inner = d.of([d.text(1, 6), f"<h1>{d.text(1, 3)}</h1><p>{d.text(3, 9)}</p>", f"<div>{d.text(2, 5)}</div>" + " ".join(_links(d, 1, 4))])
    return d.of(["<header>{}</header>", '<div id="masthead">{}</div>', '<div class="header">{}</div>', '<header class="site-header">{}</header>', '<div class="topbar">{}</div>']).format(inner)


def _footer(d: _Draw) -> str:
    inner = d.of([f"&copy; {d.text(1, 12)}", f"<p>{d.text(4, 30)}</p>", " | ".join(_links(d, 2, 6)), f"<p>{d.text(2, 12)}</p><p>{d.of(_links(d, 1, 2))} {d.text(2, 8)}</p>"])
    return d.of(["<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="colophon">{}</div>', '<div class="site-footer legal">{}</div>', '<div class="copyright">{}</div>']).format(inner)


def _side(d: _Draw) -> str:
    inner = d.of([f"<article><h3>{_links(d, 1, 1)[0]}</h3><p>{d.text(4, 20)}</p></article>" * 2, f"<h3>{d.text(1, 4)}</h3>" + "".join(f"<p>{x}</p>" for x in _links(d, 2, 5)), f"<h2>{d.text(1, 3)}</h2><p>{d.text(5, 40)}</p>", f"<p>{d.text(3, 25)}</p>"])
    return d.of(["<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div id="right-rail">{}</div>', '<section class="related">{}</section>', '<div class="widget">{}</div>', '<div class="recommended">{}</div>']).format(inner)


def _notice(d: _Draw) -> str:
    inner = d.of([f"<p>{d.text(4, 30)}</p><button>{d.text(1, 2)}</button>", d.text(4, 25), f"<p>{d.text(3, 10)} {d.of(_links(d, 1, 1))}</p>"])
    return d.of(['<div class="cookie-notice">{}</div>', '<div id="consent">{}</div>', '<div class="newsletter">{}</div>', '<div role="alert">{}</div>', '<dialog open>{}</dialog>', '<div class="popup">{}</div>', '<section class="notice">{}</section>']).format(inner)


def _advert(d: _Draw) -> str:
    inner = d.of([d.text(2, 14), f"<p>{d.text(3, 20)}</p>", f'<a href="http://shop.example">{d.text(3, 12)}</a>'])
    return d.of(['<div class="ad">{}</div>', '<div class="advert">{}</div>', '<div id="ad-{}" class="banner-ad">'.format(d.below(9)) + "{}</div>", '<div class="sponsored">{}</div>', '<aside class="promo">{}</aside>', '<ins class="adsense"><div>{}</div></ins>']).format(inner)


def _form(d: _Draw) -> str:
    inner = d.of([f"<label>{d.text(1, 3)}</label><input type=text><button>{d.text(1, 2)}</button>", f"<p>{d.text(3, 14)}</p><select><option>{d.text(1, 2)}<option>{d.text(1, 2)}</select>", f"<fieldset><legend>{d.text(1, 3)}</legend><p>{d.text(2, 9)}</p></fieldset>"])
    return d.of(['<form action="/s">{}</form>', '<form class="search">{}</form>', '<div class="login"><form>{}</form></div>']).format(inner)


def _comments(d: _Draw) -> str:
    each = "".join(d.of([f'<div class="comment"><p>{d.text(3, 60)}</p></div>', f"<li><p>{d.text(2, 40)}</p></li>", f"<div><b>{d.text(1, 2)}</b><p>{d.text(4, 50)}</p></div>"]) for _ in range(1 + d.below(4)))
    if d.below(3) == 0:
        each = "".join(f'<article class="comment"><h4>{d.text(1, 2)}</h4><div class="comment-content"><p>{d.text(3, 60)}</p></div></article>' for _ in range(1 + d.below(4)))
    return d.of(['<section class="comments"><h3>{}</h3>{}</section>', '<div id="comments"><h2>{}</h2>{}</div>', '<ol class="commentlist"><li>{}</li>{}</ol>', '<div id="disqus_thread"><p>{}</p>{}</div>', '<section id="discussion"><h2>{}</h2>{}</section>']).format(d.text(1, 3), each)


def _teasers(d: _Draw) -> str:
    """Linked titles and lines under no telling name, with a short label now and then."""
    each = "".join(d.of(["<p>{}</p>", "<p>{}</p>", "<div>{}</div>"]).format(f'<a href="/{d.of(_WORDS)}">{d.text(3, 24)}</a>') + (f"<p>{d.text(1, 3)}</p>" if d.below(3) == 0 else "") for _ in range(3 + d.below(4)))
    return f"<div>{each}<p><a href='/more'>{d.text(1, 3)}</a></p></div>"


def _hidden(d: _Draw) -> str:
    return d.of(['<div style="display:none">{}</div>', "<div hidden>{}</div>", '<p aria-hidden="true">{}</p>']).format(d.text(3, 40))


def _share(d: _Draw) -> str:
    return f'<div class="share">{" ".join(_links(d, 2, 4))}</div>'


#: What may stand inside an article without belonging to it.
_INSIDE = (_advert, _notice, _side, _form, _menu, _hidden, _share)


def _article(d: _Draw) -> tuple[str, list[str]]:
    """The article's HTML and its blocks' texts. Adverts and share bars may stand inside."""
    parts, main = [], []

    def put(form: str, text: str) -> None:
        parts.append(form.format(text))
        main.append(text)

    wrap = d.of(["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="main-content">{}</div>', '<div class="post">{}</div>', '<div class="entry story">{}</div>', "<main><article>{}</article></main>", "<div>{}</div>", "{}"])
    plain = wrap in ("<div>{}</div>", "{}")
    if d.below(5):
        put(d.of(["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>"] + ([] if plain else ["<header><h1>{}</h1></header>"])), d.text(2, 9))
    for _ in range(1 + d.below(7)):
        kind = d.below(16)
        if kind < 10 or plain:
            put(d.of(["<p>{}</p>", "<p>{}", "<p><b>{}<br></b></p>", "<div>{}</div>"] if not plain else ["<p>{}</p>", "<p>{}</p>", "<p><i>{}</i>"]), d.text(1, 3) if d.below(5) == 0 and not plain else d.text(12 if plain else 4, 90))
        elif kind == 10:
            put("<h2>{}</h2>", d.text(1, 6))
        elif kind == 11:
            items = [d.text(1, 14) for _ in range(2 + d.below(4))]
            parts.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
            main.extend(items)
        elif kind == 12:
            put("<blockquote>{}</blockquote>", d.text(4, 40))
        elif kind == 13 and d.below(2):
            # A paragraph that is one link, with prose before and after it.
            for form, most in (("<p>{}</p>", 60), ('<p><a href="/y">{}</a></p>', 30), ("<p>{}</p>", 60)):
                put(form, d.text(10, most))
        elif kind == 13:
            a, b = d.text(4, 20), d.text(1, 4)
            parts.append(f'<p>{a} <a href="/x">{b}</a></p>')
            main.append(f"{a} {b}")
        elif kind == 14:
            if d.below(2):
                a, b = d.text(3, 20)[:-1], d.text(3, 20)
                parts.append(d.of(['<p>{} <svg/> {}</p>', '<p>{} <svg><title>x</title><path d=""/></svg> {}</p>', "<p>{} <b hidden>x</b> {}</p>"]).format(a, b))
                main.append(f"{a} {b}")
                continue
            cells = [d.text(1, 5) for _ in range(4)]
            parts.append("<table><tr>" + "</tr><tr>".join(f"<td>{cells[i]}</td><td>{cells[i + 1]}</td>" for i in (0, 2)) + "</tr></table>")
            main.extend(cells)
        else:
            parts.append(d.of(_INSIDE)(d))
        if not plain and d.below(6) == 0:
            parts.append(d.of(_INSIDE)(d))
    if not plain and d.below(8) == 0:
        parts.append(_comments(d))
    return wrap.format("".join(parts)), main


_BODIES = ("<body>", "<body>", '<body class="single has-sidebar comments-open">', '<body id="top" class="page no-menu cookie-consent">')
#: What may stand around all of a page's regions.
_LAYOUTS = ("{}", "{}", '<div id="page" class="site with-sidebar">{}</div>', '<div class="sidebar-right"><div class="inner">{}</div></div>', '<form id="aspnetForm">{}</form>', '<div class="wrap">' * 4 + "{}" + "</div>" * 4)


def labelled_pages(n: int = PAGES) -> list[tuple[str, set[str]]]:
    """(page, texts of the article's blocks) for n pages."""
    out = []
    for seed in range(1, n + 1):
        d = _Draw(seed)
        article, main = _article(d)
        top = "".join(d.of(x)(d) for x in ([_menu], [_header, _menu], [_advert, _notice], [_form, _header], [_teasers, _menu]) if d.below(2))
        end = "".join(d.of(x)(d) for x in ([_side, _advert], [_comments], [_form, _notice], [_menu, _side], [_teasers], [_footer]) if d.below(2))
        title = d.text(2, 6)
        body = d.of(_BODIES)
        inner = d.of(_LAYOUTS).format(f"{top}<!-- x -->{article}<script>var a='<p>';</script>{end}")
        out.append((f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head>{body}{inner}{_footer(d) if d.below(4) else ''}</body></html>", set(main)))
    return out
