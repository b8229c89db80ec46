"""Labelled pages: given prose set into page layouts of many kinds, so that it is known which blocks are the article's.

Sites differ in the elements and names they use, and no table says which blocks of a page are its article. So labelled
pages are made: the prose is real, the layout is dealt from the parts that web pages have, with the names that sites give
them, other names, or none. Advertisements, teasers and reader comments are prose as well, so words alone do not tell.
"""

from __future__ import annotations

import html
import random

#: Begins the text of a block that belongs to the article; a character of the private use area.
MARK = "\ue000"

#: What notices, forms and menus say, in the four languages of the corpus.
PHRASES = {
    "cookie": ("We use cookies to improve your experience. Accept all cookies or change your settings.", "Wir verwenden Cookies. Mit der Nutzung dieser Seite stimmen Sie der Datenschutzerklärung zu.", "Nous utilisons des cookies pour améliorer votre expérience. Accepter ou gérer mes choix.", "Usamos cookies para mejorar su experiencia. Aceptar o configurar la privacidad."),
    "signup": ("Subscribe to our newsletter and never miss an update.", "Newsletter abonnieren und nichts verpassen.", "Abonnez-vous à notre newsletter.", "Suscríbase a nuestro boletín de noticias."),
    "login": ("Sign in", "Log in to continue", "Anmelden", "Se connecter", "Iniciar sesión", "Register"),
    "search": ("Search", "Search this site", "Suche", "Rechercher", "Buscar"),
    "menu": ("Home", "About us", "Contact", "News", "Sports", "Startseite", "Über uns", "Kontakt", "Accueil", "À propos", "Inicio", "Archive", "FAQ", "Shop", "Blog"),
    "comments": ("Comments", "3 comments", "Leave a reply", "Discussion", "Kommentare", "12 Kommentare", "Commentaires", "Comentarios", "Reader comments"),
    "reply": ("Reply", "Report", "Like", "Antworten", "Répondre", "Responder", "2 days ago", "Permalink"),
    "related": ("Related articles", "You might also like", "Read more", "Most popular", "Mehr zum Thema", "À lire aussi", "Artículos relacionados", "Recommended"),
    "share": ("Share", "Tweet", "Share on Facebook", "Email", "Print", "Teilen", "Partager", "Compartir"),
    "advert": ("Advertisement", "Sponsored", "Anzeige", "Publicité", "Publicidad", "Ad"),
    "legal": ("All rights reserved.", "Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados.", "Terms of use", "Privacy policy", "Impressum", "Mentions légales", "Aviso legal"),
    "form": ("Your name", "Email address", "Message", "Submit", "Absenden", "Envoyer", "Enviar", "Your email address will not be published."),
    "byline": ("By {}", "Von {}", "Par {}", "Por {}", "Posted by {} on 3 May 2021", "Last updated 12.04.2019, {}", "Written by {}"),
}

#: Names that sites give to the parts of their pages.
NAMES = {
    "article": ("article", "post", "entry-content", "content", "article-body", "story", "post-body", "main-content", "text", "page-content", "storyBody"),
    "section": ("section", "chapter", "block", "wp-block-group", "part", "content-section"),
    "menu": ("nav", "menu", "main-menu", "navbar", "navigation", "topnav"),
    "header": ("header", "site-header", "masthead", "topbar", "branding"),
    "crumbs": ("breadcrumb", "breadcrumbs", "path"),
    "sidebar": ("sidebar", "side", "widget-area", "rail", "right-column", "secondary"),
    "cookie": ("cookie-banner", "consent", "gdpr", "cookie-notice", "privacy-notice"),
    "notice": ("notice", "alert", "banner", "announcement", "message-bar"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot"),
    "related": ("related", "related-posts", "recommended", "more-stories", "teasers", "popular"),
    "share": ("share", "social", "share-buttons", "social-links"),
    "comments": ("comments", "comment-list", "discussion", "responses", "comment-section", "reader-comments"),
    "signup": ("newsletter", "subscribe", "signup", "signup-form"),
    "form": ("form", "contact-form", "comment-form", "search-form", "respond"),
    "footer": ("footer", "site-footer", "colophon", "copyright", "legal", "bottom"),
    "tags": ("tags", "tag-list", "post-meta", "meta", "categories", "author-bio"),
}

#: Words for texts where there are none.
_WORDS = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years much where your way down should because long each just state those people too mr how little good world make very year still see work life".split()


def stand_in(rng: random.Random) -> list[str]:
    """A headline and paragraphs of common words."""
    return [" ".join(rng.choices(_WORDS, k=n)).capitalize() + ("." if i else "") for i, n in enumerate([rng.randint(2, 12), *[rng.randint(6, 90) for _ in range(rng.randint(3, 20))]])]


class _Page:
    """One page in the making."""

    def __init__(self, rng: random.Random, article: list[str], others: list[str]) -> None:
        self.rng, self.article, self.others = rng, article, others or article
        self.style = rng.choices(("named", "coded", "bare"), (6, 2, 2))[0]
        self.semantic = rng.random() < 0.6

    def pick(self, kind: str) -> str:
        return self.rng.choice(PHRASES[kind])

    def prose(self, least: int, most: int) -> str:
        """Some words of another text."""
        words = self.rng.choice(self.others).split() or ["text"]
        n = self.rng.randint(least, most)
        at = self.rng.randrange(max(1, len(words) - n))
        return " ".join(words[at : at + n])

    def open(self, tag: str, kind: str) -> str:
        if self.style == "bare" or self.rng.random() < 0.1:
            return f"<{tag}>"
        name = self.rng.choice(NAMES[kind]) if self.style == "named" else f"c{self.rng.randrange(999)}"
        return f'<{tag} {self.rng.choice(("class", "class", "id"))}="{name}">'

    def part(self, kind: str, tags: tuple[str, ...], inside: str) -> str:
        tag = self.rng.choice(tags) if self.semantic else "div"
        return f"{self.open(tag, kind)}{inside}</{tag}>"

    def text(self, words: str, mine: bool = False) -> str:
        return (MARK if mine else "") + html.escape(words, quote=False)

    def link(self, words: str) -> str:
        return f'<a href="/{self.rng.randrange(9999)}">{self.text(words)}</a>'

    def links(self, n: int, least: int = 1, most: int = 2) -> str:
        words = [self.pick("menu") if self.rng.random() < 0.4 else self.prose(least, most) for _ in range(n)]
        if self.rng.random() < 0.75:
            return "<ul>" + "".join(f"<li>{self.link(w)}</li>" for w in words) + "</ul>"
        return self.rng.choice((" | ", " · ", " ")).join(map(self.link, words))

    def menu(self) -> str:
        return self.part("menu", ("nav", "nav", "div"), self.links(self.rng.randint(3, 12)))

    def header(self) -> str:
        name = self.rng.choice(("h1", "div", "p", "span")) if self.rng.random() < 0.5 else "a"
        inside = f"<{name}>{self.text(self.prose(1, 3))}</{name}>" + (f"<p>{self.text(self.prose(3, 9))}</p>" if self.rng.random() < 0.4 else "")
        return self.part("header", ("header",), inside + (self.menu() if self.rng.random() < 0.5 else "") + (self.search() if self.rng.random() < 0.3 else ""))

    def search(self) -> str:
        return f"{self.open('form', 'form')}<label>{self.text(self.pick('search'))}</label><input name=q><button>{self.pick('search')}</button></form>"

    def cookie(self) -> str:
        return self.part("cookie", ("div", "aside", "section"), f"<p>{self.text(self.pick('cookie'))}</p>" + (self.link(self.pick("legal")) if self.rng.random() < 0.5 else ""))

    def notice(self) -> str:
        return self.part("notice", ("div", "aside", "section"), f"<p>{self.text(self.rng.choice((self.pick('signup'), self.pick('cookie'), self.pick('login'), self.prose(5, 25))))}</p>")

    def advert(self) -> str:
        words = self.prose(3, 25)
        return self.part("advert", ("div", "aside"), (f"<p>{self.text(self.pick('advert'))}</p>" if self.rng.random() < 0.4 else "") + self.rng.choice((self.text(words), f"<p>{self.text(words)}</p>", self.link(words))))

    def signup(self) -> str:
        return self.part("signup", ("div", "aside", "section"), f"<form><p>{self.text(self.pick('signup'))}</p><label>{self.text(self.pick('form'))}</label><input><button>OK</button></form>")

    def share(self) -> str:
        return self.part("share", ("div", "aside"), "<ul>" + "".join(f"<li>{self.link(self.pick('share'))}</li>" for _ in range(self.rng.randint(2, 5))) + "</ul>")

    def related(self) -> str:
        teasers = []
        for _ in range(self.rng.randint(2, 6)):
            tag, title = self.rng.choice(("li", "div", "article")), self.link(self.prose(3, 10))
            teasers.append(f"<{tag}>{self.rng.choice((title, f'<h3>{title}</h3>'))}" + (f"<p>{self.text(self.prose(8, 30))}</p>" if self.rng.random() < 0.4 else "") + f"</{tag}>")
        return self.part("related", ("aside", "section", "div"), f"<h3>{self.text(self.pick('related'))}</h3>" + "".join(teasers))

    def sidebar(self) -> str:
        parts = [self.related, self.advert, self.signup, self.menu, lambda: f"<div><h4>{self.text(self.prose(1, 3))}</h4><p>{self.text(self.prose(8, 40))}</p></div>"]
        return self.part("sidebar", ("aside", "aside", "div"), "".join(self.rng.choice(parts)() for _ in range(self.rng.randint(1, 4))))

    def comments(self) -> str:
        item, out = self.rng.choice(("li", "div", "article")), []
        for _ in range(self.rng.randint(1, 6)):
            who = f"<{(t := self.rng.choice(('p', 'div', 'h4')))}>{self.text(self.prose(1, 2))}</{t}>" if self.rng.random() < 0.7 else ""
            said = "".join(f"<p>{self.text(self.prose(3, 60))}</p>" for _ in range(self.rng.choice((1, 1, 1, 2))))
            out.append(f"{self.open(item, 'comments')}{who}{said}" + (self.link(self.pick("reply")) if self.rng.random() < 0.6 else "") + f"</{item}>")
        head = f"<{(h := self.rng.choice(('h2', 'h3', 'p')))}>{self.text(self.pick('comments'))}</{h}>" if self.rng.random() < 0.85 else ""
        inside = "".join(out)
        return self.part("comments", ("section", "div", "aside"), head + (f"<ol>{inside}</ol>" if item == "li" else inside) + (self.form() if self.rng.random() < 0.4 else ""))

    def form(self) -> str:
        fields = "".join(f"<p><label>{self.text(self.pick('form'))}</label><input></p>" for _ in range(self.rng.randint(1, 4)))
        return f"{self.open('form', 'form')}<p>{self.text(self.rng.choice((self.prose(3, 15), self.pick('form'))))}</p>{fields}<button>{self.pick('form')}</button></form>"

    def footer(self) -> str:
        rng, out = self.rng, []
        out.append(self.text(f"© {rng.randint(1999, 2024)} {self.prose(1, 3)} · {rng.choice((self.pick('legal'), self.prose(5, 20)))}"))
        if rng.random() < 0.5:
            out.append(self.links(rng.randint(2, 8)))
        if rng.random() < 0.4:
            out.append(f"<p>{self.text(self.prose(10, 50))}</p>")
        rng.shuffle(out)
        return self.part("footer", ("footer",), "".join(out))

    def body(self) -> str:
        """The article: headline, paragraphs and what stands among them."""
        rng, paragraphs = self.rng, list(self.article)
        out = []
        title = f"<{(h := rng.choice(('h1', 'h1', 'h1', 'h2')))}>{self.text(paragraphs[0], True)}</{h}>"
        byline = f"<{(b := rng.choice(('p', 'div', 'address')))}>{self.text(self.pick('byline').format(self.prose(2, 2)))}</{b}>" if rng.random() < 0.35 else ""
        out.append(f"<header>{title}{byline}</header>" if rng.random() < 0.25 and self.semantic else title + byline)
        kind = rng.choices(("p", "open", "div", "br"), (6, 2, 1, 1))[0]
        for p in paragraphs[1:]:
            words, roll = p.split(), rng.random()
            if rng.random() < 0.12:  # short ones too
                words = words[: rng.randint(1, 6)]
                p = " ".join(words)
            if roll < 0.06 and len(words) > 3:
                out.append(f"<h{(n := rng.randint(2, 4))}>{self.text(' '.join(words[: rng.randint(1, 7)]), True)}</h{n}>")
            if roll > 0.92 and len(words) > 12:
                third = len(words) // 3
                out.append(f"<{(t := rng.choice(('ul', 'ol')))}>" + "".join(f"<li>{self.text(' '.join(words[i : i + third]), True)}</li>" for i in range(0, len(words), third)) + f"</{t}>")
            elif roll > 0.88:
                out.append(f"<blockquote><p>{self.text(p, True)}</p></blockquote>")
            elif roll > 0.85 and len(words) > 4:
                out.append(f"<figure><img src=x><figcaption>{self.text(' '.join(words[:15]), True)}</figcaption></figure>")
            elif roll > 0.83 and len(words) > 8:
                out.append("<table><tr>" + "".join(f"<td>{self.text(' '.join(words[i : i + 4]), True)}</td>" for i in (0, 4)) + "</tr></table>")
            elif kind == "br":
                out.append(f"<div>{self.text(p, True)}<br></div>")
            elif roll > 0.7 and len(words) > 6:
                some = rng.randint(2, 5)
                out.append(f"<p>{self.text(' '.join(words[:some]), True)} {self.link(' '.join(words[some : some + 2]))} {self.text(' '.join(words[some + 2 :]))}</p>")
            else:
                out.append({"p": f"<p>{self.text(p, True)}</p>", "open": f"<p>{self.text(p, True)}", "div": f"<div>{self.text(p, True)}</div>"}[kind])
            if rng.random() < 0.06:
                out.append(rng.choice((self.advert, self.related, self.signup, self.share, self.notice))())
        if rng.random() < 0.25:  # sections of the article
            tag, cut = rng.choice(("section", "div")), sorted(rng.sample(range(1, len(out) + 1), min(len(out), rng.randint(1, 3))))
            out = [out[0], *(f"{self.open(tag, 'section')}{''.join(out[a:b])}</{tag}>" for a, b in zip([1, *cut], [*cut, len(out)]) if b > a)]
        return "".join(out)

    def page(self) -> str:
        rng, before, after = self.rng, [], []
        chance = lambda f, p: [f()] if rng.random() < p else []
        before += chance(self.cookie, 0.25) + chance(self.header, 0.7) + chance(self.menu, 0.6) + chance(self.advert, 0.4) + chance(self.notice, 0.25)
        if rng.random() < 0.3:
            before.append(self.part("crumbs", ("nav", "div", "p"), self.links(rng.randint(2, 4))))
        inner = self.body()
        ends = chance(self.share, 0.3) + chance(self.related, 0.3) + chance(self.comments, 0.5) + chance(self.signup, 0.2)
        if rng.random() < 0.3:
            ends.insert(0, self.part("tags", ("footer", "div", "ul"), rng.choice((self.links(rng.randint(1, 5)), f"<p>{self.text(self.prose(5, 30))}</p>"))))
        inside, after_it = (ends, []) if rng.random() < 0.4 else ([], ends)
        tag = rng.choice(("article", "article", "main", "section", "div", "td")) if self.semantic or rng.random() < 0.2 else "div"
        inner = f"{self.open(tag, 'article')}{inner}{''.join(inside)}</{tag}>"
        if tag == "td":
            side = f"<td>{self.sidebar()}</td>"
            inner = f"<table><tr>{side if rng.random() < 0.5 else ''}{inner}{side}</tr></table>"
        after += after_it + chance(self.sidebar, 0.4)
        if rng.random() < 0.2:
            before.append(self.sidebar())
        if rng.random() < 0.3:
            inner = f"<main>{inner}{''.join(after)}</main>" if self.semantic else f"<div id=wrapper>{inner}{''.join(after)}</div>"
            after = []
        after += chance(self.cookie, 0.15) + chance(self.footer, 0.85)
        return f"<!DOCTYPE html><html><head><title>{self.text(self.article[0])}</title><style>p{{margin:0}}</style></head><body>{''.join(before)}{inner}{''.join(after)}</body></html>"


def labelled(rng: random.Random, article: list[str], others: list[str]) -> str:
    """A page with the article's paragraphs (the first is its headline), whose blocks begin with MARK, and with parts made of other texts."""
    return _Page(rng, article, others).page()
