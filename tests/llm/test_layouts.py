"""Main texts of pages laid out by hand: what must come out, and what must not."""

import re

import pytest

from docloom.llm import html_extraction as hx

STORY = [f"Paragraph number {i} tells at some length, with commas and all, what happened on the {w} day of the fair." for i, w in enumerate(("first", "second", "third", "fourth"))]
SHORT = ["The bridge is closed until May.", "Buses take the other road, as the council said on Monday."]
MENU = "".join(f"<a href=/{x}>{x}</a> " for x in ("Home", "News", "Sport", "Weather", "Contact"))
ITEMS = "".join(f"<li><a href=/{x}>{x}</a></li>" for x in ("Home", "News", "Sport", "Weather", "Contact"))
SIDE = "<h3>Most read</h3><ul><li><a href=/a>Older piece</a></li><li><a href=/b>Newer piece</a></li></ul>"
TALK = "<div class=comment><b>Jo</b><p>Nonsense, I was there and saw nothing of it.</p></div><div class=comment><b>Al</b><p>Quite right, if you ask me.</p></div>"
COOKIE = "<div class=cookie-notice><p>We use cookies to please you.</p><button>Accept</button></div>"
FOOT = "Copyright Example Press. All rights reserved."
NOISE = "Home News Sport Weather Contact Older Newer Nonsense cookies Accept Copyright rights Search Buy".split()


def p(story):
    return "".join(f"<p>{x}</p>" for x in story)


LAYOUTS = {
    "plain text": lambda s: "\n\n".join(s),
    "breaks in the body": lambda s: f"<body>{'<br>'.join(s)}</body>",
    "breaks, no body": lambda s: "<br><br>".join(s),
    "one pre": lambda s: f"<pre>{chr(10).join(s)}</pre>",
    "pre in the body": lambda s: f"<html><body><pre>{chr(10).join(s)}</pre></body></html>",
    "bare paragraphs": lambda s: p(s),
    "paragraphs in the body": lambda s: f"<body>{p(s)}</body>",
    "one paragraph": lambda s: f"<body><p>{' '.join(s)}</p></body>",
    "unclosed paragraphs": lambda s: "<body>" + "".join(f"<p>{x}" for x in s),
    "divisions for paragraphs": lambda s: "<body>" + "".join(f"<div>{x}</div>" for x in s) + "</body>",
    "spans and breaks": lambda s: "<div>" + "<br/>".join(f"<span>{x}</span>" for x in s) + "</div>",
    "article": lambda s: f"<body><header><nav>{MENU}</nav></header><article><h1>The fair</h1>{p(s)}</article><footer>{FOOT}</footer></body>",
    "main": lambda s: f"<body><nav>{MENU}</nav><main><h1>The fair</h1>{p(s)}</main><aside>{SIDE}</aside><footer>{FOOT}</footer></body>",
    "menu in the body": lambda s: f"<body><nav><ul>{ITEMS}</ul></nav><h1>The fair</h1>{p(s)}<div class=footer>{FOOT}</div></body>",
    "named divisions": lambda s: f"<div id=header>{MENU}</div><div id=content>{p(s)}</div><div id=sidebar>{SIDE}</div><div id=footer>{FOOT}</div>",
    "unnamed divisions": lambda s: f"<body><div><ul>{ITEMS}</ul></div><div><div><h1>The fair</h1>{p(s)}</div></div><div class=footer>{FOOT}</div></body>",
    "table layout": lambda s: f"<table><tr><td colspan=2><div class=menu>{MENU}</div></td></tr><tr><td><div class=sidebar>{SIDE}</div></td><td>{p(s)}</td></tr></table>",
    "stray names": lambda s: f'<body><nav>{MENU}</nav><div class="comment-free post-header main">{p(s)}</div><footer>{FOOT}</footer></body>',
    "more stray names": lambda s: f'<body class="has-menu footer-fixed"><div class="menu"><ul>{ITEMS}</ul></div><div class="page no-sidebar">{p(s)}</div><footer>{FOOT}</footer></body>',
    "comments after": lambda s: f"<body><article>{p(s)}</article><section class=comments><h2>Comments</h2>{TALK}</section></body>",
    "comments within": lambda s: f"<body><article>{p(s)}<div id=comments>{TALK}</div></article><footer>{FOOT}</footer></body>",
    "cookie notice": lambda s: f"<body>{COOKIE}<article>{p(s)}</article></body>",
    "advert within": lambda s: f"<body><article>{p(s[:1])}<div class=ad>Buy our splendid boots.</div>{p(s[1:])}</article></body>",
    "advert in a sentence": lambda s: f'<body><article><p>{s[0]} <span class="ad">Buy our splendid boots.</span> {s[1]}</p>{p(s[2:])}</article></body>',
    "choice in a sentence": lambda s: f"<body><article><p>{s[0]} <select><option>Accept<option>Buy</select> {s[1]}</p>{p(s[2:])}</article></body>",
    "without scripts": lambda s: f"<body><article>{p(s[:1])}<noscript><p>{s[1]}</p></noscript>{p(s[2:])}</article><footer>{FOOT}</footer></body>",
    "inline article": lambda s: f"<body><nav>{MENU}</nav><article>{'<br>'.join(s)}</article></body>",
    "list of sentences": lambda s: f"<body><nav><ul>{ITEMS}</ul></nav><article><ul>{''.join(f'<li>{x}</li>' for x in s)}</ul></article></body>",
    "sections": lambda s: "<body><article>" + "".join(f"<section><h2>Part</h2><p>{x}</p></section>" for x in s) + f"</article><footer>{FOOT}</footer></body>",
    "search form": lambda s: f"<body><form class=search><label>Search</label><input><button>Search</button></form><div class=post>{p(s)}</div></body>",
    "quotes": lambda s: f"<body><article><blockquote>{p(s)}</blockquote></article><footer>{FOOT}</footer></body>",
    "deep": lambda s: f"<body>{'<div>' * 30}{p(s)}{'</div>' * 30}<footer>{FOOT}</footer></body>",
    "page as a form": lambda s: f"<body><form id=aspnet><div class=menu><ul>{ITEMS}</ul></div><div class=content>{p(s)}</div></form></body>",
    "widget column": lambda s: f"<body><div class=wrapper><div class=rail>{SIDE}</div><div class=story><h1>The fair</h1>{p(s)}</div></div></body>",
    "two rails": lambda s: f"<body><aside>{SIDE}</aside><main><article>{p(s)}</article></main><aside><p>Buy our splendid boots.</p></aside></body>",
}


@pytest.fixture(scope="module")
def texts():
    model = hx.learn()
    return {(name, len(story)): (hx.main_texts([make(story)], model)[0], story) for name, make in LAYOUTS.items() for story in (STORY, SHORT)}


def test_no_page_loses_its_article(texts):
    assert all(text for text, _ in texts.values())


def test_recall_and_precision_by_word(texts):
    found = wanted = noise = said = 0
    for text, story in texts.values():
        words = re.findall(r"\w+", text)
        own = re.findall(r"\w+", " ".join(story))
        wanted, said = wanted + len(own), said + len(words)
        left = list(words)
        for w in own:
            if w in left:
                left.remove(w)
                found += 1
        noise += sum(w in NOISE for w in words)
    print(f"{len(texts)} pages: recall {found / wanted:.3f}, foreign words {noise / said:.4f}")
    assert found / wanted >= 0.97 and noise / said <= 0.02


@pytest.mark.parametrize("name", ["plain text", "breaks in the body", "one pre", "one paragraph", "stray names", "advert in a sentence", "choice in a sentence", "without scripts"])
def test_named_pages_whole(texts, name):
    for n in (4, 2):
        text, story = texts[name, n]
        assert text == " ".join(story)


def test_pages_without_an_article():
    model = hx.learn()
    pages = [f"<body><nav><ul>{ITEMS}</ul></nav><footer>{FOOT}</footer></body>", f"<body><div class=menu>{MENU}</div></body>", "<body></body>", "<script>no text.</script>", "plain words only"]
    assert hx.main_texts(pages, model) == ["", "", "", "", "plain words only"]


def test_the_model_is_fitted_once():
    assert hx.learn() is hx.learn()
