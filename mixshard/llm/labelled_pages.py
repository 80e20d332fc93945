"""The small labelled table of the page extractor: elements with ``data-main`` are content.

Written for this purpose; each page shows other ways in which sites wrap an article, from
semantic tags to bare paragraphs, and what stands around it.
"""

_LONG = ["The council approved the new bridge after a long debate about its cost and the effect on the old harbour.",
         "Engineers expect work to begin in spring, and the first cars could cross the river within three years.",
         "Several shop owners spoke against the plan, since the building site would cut off their street for months.",
         "A second hearing is set for next week, when the committee will look at the updated drawings and the budget.",
         "Residents who came to the hall said that they had waited for a decision since the flood of the previous decade."]
_SHORT = ["Not everyone agrees.", "It rained.", "Why now?", "Yes.", "The answer is simple: money."]


def _paragraphs(*texts: str, mark: str = " data-main") -> str:
    return "".join(f"<p{mark}>{t}</p>" for t in texts)


_NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/town">Town</a></li><li>Weather</li></ul></nav>'
_HEADER = '<header><a href="/"><img src="l.png"> The Harbour Post</a><p>News from the coast since 1921, every day of the week.</p></header>'
_FOOTER = '<footer>&copy; harbour.example &middot; All rights reserved by the publishers of the paper. <a href="/imprint">Imprint</a></footer>'
_ASIDE = '<aside><h3>Most read</h3><p>Five walks along the coast that you can do with children on a windy day.</p><ul><li><a href="/1">Tide tables</a></li><li>Ferry times for the summer season</li></ul></aside>'
_COMMENTS = '<section class="comments"><h3>2 comments</h3><div class="comment"><p>I have lived here for forty years and this plan is the worst that I have seen so far.</p></div><div class="comment">Great article, thank you!</div></section>'
_COOKIE = '<div class="cookie-banner"><p>We use cookies to give you the best experience on this site and to count visits. You can change this at any time.</p><button>Accept</button></div>'
_AD = '<div class="ad">Buy two pairs of shoes today and get the third one free in all our shops on the main street.</div>'
_FORM = '<form action="/s"><p>Sign up for our letter and get the best stories by mail every Friday morning.</p><input name="q"><label>Your address</label></form>'



def _some(n: int) -> str:
    return " ".join((" ".join(_LONG)).split()[:n])


def _around(n: int) -> list[str]:
    """What stands around articles, in n words."""
    return [f'<div class="ad">{_some(n)}</div>', f"<aside><p>{_some(n)}</p></aside>", f'<div id="notice-top"><p>{_some(n)}</p></div>', f'<div class="comments"><p>{_some(n)}</p></div>',
            f"<form><p>{_some(n)}</p></form>", f'<div class="sidebar-box">{_some(n)}</div>', f"<header><p>{_some(n)}</p></header>", f'<p class="promo">{_some(n)}</p>']


PAGES = [
    # the same surroundings in many lengths, beside articles and bare paragraphs of many lengths
    *(f"{a}<article>{_paragraphs(_some(m), _some(n))}</article><footer>{_some(n)}</footer>" for m, n in ((1, 40), (4, 25), (12, 18), (40, 8), (25, 3)) for a in _around(n)),
    *(f"{a}{_paragraphs(_some(40), _some(n + 20))}{a}" for n in (3, 9, 20, 40) for a in _around(n)),
    # semantic tags, an advert that reads like a paragraph
    f'<html><body>{_NAV}<!-- ad --><div class="ad">Fresh fish every day at the market hall near the station.</div><article><h1 data-main>Council approves bridge</h1>{_paragraphs(*_LONG, _SHORT[0])}</article>{_FOOTER}</body></html>',
    # short paragraphs and subheadings between long ones
    f'{_HEADER}{_NAV}<main><article><h1 data-main>Bridge</h1>{_paragraphs(_SHORT[1], _LONG[0], _SHORT[2], _SHORT[3])}<h2 data-main>The cost</h2>{_paragraphs(_LONG[1], _SHORT[4], _LONG[2])}{_AD}{_paragraphs(_LONG[3])}</article>{_ASIDE}</main>{_FOOTER}',
    # readers' comments and sharing inside the article element
    f'{_COOKIE}<article><header><h1 data-main>A harbour changes</h1></header>{_paragraphs(*_LONG[:3])}<div class="share"><a href="/f">Share</a> <a href="/t">Tell a friend</a></div>{_COMMENTS}</article>{_FOOTER}',
    # article in a plain container
    f'<div id="header"><h1>The Harbour Post</h1><p>News from the coast, every morning.</p></div><div class="menu"><a href="/">Home</a> | <a href="/a">About</a> | <a href="/c">Contact</a></div><div class="content"><h1 data-main>Bridge</h1>{_paragraphs(*_LONG)}<ul><li data-main>cost: 4 million</li><li data-main>length: 300 metres</li></ul></div><div class="sidebar"><h3>Weather</h3><p>Sunny with some wind from the west, and rain later in the evening.</p></div><div id="footer"><p>Copyright of all texts lies with the Harbour Post and its authors.</p></div>',
    f'<div class="nav"><ul><li><a href="/1">One</a><li><a href="/2">Two</a></ul></div><div class="post"><h2 data-main>On bridges</h2>{_paragraphs(_LONG[4], _SHORT[0], _LONG[0], _SHORT[3])}<div class="related"><h4>Read more</h4><a href="/x">Ten bridges that fell</a></div></div>{_COMMENTS}{_FORM}',
    # bare paragraphs, nothing but neighbours to go by
    f'<body><a href="/">Home</a> <a href="/b">Blog</a><br><a href="/c">Contact</a><h1 data-main>My trip over the bridge</h1>{_paragraphs(*_LONG)}<hr><a href="/p">Previous</a> <a href="/n">Next</a><p>Made by hand</p></body>',
    f'<table><tr><td><a href="/">Start</a></td><td><a href="/k">Links</a></td></tr></table>{_paragraphs(_LONG[1], _LONG[3], _LONG[2])}<p><a href="/impressum">Imprint</a></p>',
    f'<center><a href=/>index</a> <a href=/faq>faq</a></center>{_paragraphs(*_LONG[1:])}<p>Last change: May</p>',
    # notices, overlays and search forms
    f'<div role="alert" class="notice"><p>Our offices are closed on Monday; letters will be answered from Tuesday on by the usual team.</p></div>{_NAV}<main id="content">{_paragraphs(*_LONG[2:], _SHORT[2])}{_FORM}</main><div class="newsletter-signup"><p>Never miss a story again: our letter brings the five best of the week to you.</p></div>{_FOOTER}',
    f'<div class="popup"><p>Subscribe now and read everything for one coin in the first month of your stay.</p></div><article><h1 data-main>Bridges</h1>{_paragraphs(_LONG[0], _LONG[1])}<blockquote data-main>It will last a hundred years.</blockquote>{_paragraphs(_SHORT[4], _LONG[2])}<p data-main>See also <a href="/r">the report</a> of the committee on the matter.</p><aside><p>Our author has written about towns and rivers for more than ten years.</p></aside></article><section id="comments"><p>This is wrong, the old bridge was built before the war and not after it.</p></section>',
    # unclosed inline and paragraph tags, one line per block
    f'{_NAV}<div class="ad">Un, deux, trois: les soldes commencent demain dans toute la ville.</div><article><h1 data-main>Pont</h1><p data-main><b>{_LONG[0]}<br><p data-main>{_LONG[1]}</p><p data-main>{_SHORT[1]}</p><p data-main><b>{_SHORT[3]}<br><p data-main>{_LONG[4]}</p></article>{_FOOTER}',
    f'{_HEADER}<div class="breadcrumb"><a href="/">Home</a> &gt; <a href="/t">Town</a> &gt; Bridge</div><section class="article-body">{_paragraphs(_LONG[0], _SHORT[0], _LONG[3], _LONG[2])}</section><div class="widget"><p>Tomorrow the tide is high at noon, so bring your boots to the beach.</p></div>{_COMMENTS}<div class="footer-links"><a href="/j">Jobs</a> <a href="/h">Help</a></div>',
    # articles without any around, and pages without any article
    f'<article>{_paragraphs(_SHORT[3])}</article>{_FOOTER}', f'<article><p data-main>{_SHORT[1]}</p><p data-main>{_SHORT[2]}</p></article>', f'{_paragraphs(_LONG[0])}',
    f'{_NAV}<article><h1 data-main>Links</h1><p data-main><a href="/1">{_LONG[0]}</a></p>{_paragraphs(_LONG[1])}</article>',
    # short last words, without anything after the article
    f'{_NAV}<article><h1 data-main>Bridge</h1>{_paragraphs(_LONG[0], _SHORT[1], _LONG[3], _SHORT[3])}</article>', f'{_AD}<article>{_paragraphs(_SHORT[0], _SHORT[3])}</article>',
    f'<article><h2 data-main><a href="/b">{_SHORT[4]}</a></h2>{_paragraphs(_LONG[1], _LONG[2], _SHORT[2])}</article>', f'<main>{_paragraphs(_LONG[4], _SHORT[3])}<h2 data-main>{_SHORT[2]}</h2>{_paragraphs(_SHORT[1])}</main>',
    *(f'<article>{_paragraphs(*(" ".join(_LONG[k].split()[:w]) for k in range(n)))}</article>' for w in (1, 3, 6, 10) for n in (1, 2, 3)),
    f'<article><p data-main>{_SHORT[3]}</p></article>', f'<article><h1 data-main>Bridge</h1></article>', f'{_NAV}<article>{_paragraphs(_LONG[0])}<ul><li data-main><a href="/p">The plan of the town</a></li><li data-main><a href="/q">The budget</a></li></ul></article>',
    f'{_paragraphs(*_LONG)}<p>Last change: May</p>', f'<p><a href="/">Home</a></p>{_paragraphs(_LONG[2], _LONG[4])}<p>Made by hand</p>', f'<a href="/">Home</a><p>Menu</p>{_paragraphs(_LONG[3], _LONG[0])}<p>Last seen today</p>',
    f'{_NAV}{_FORM}{_FOOTER}', f'<div class="menu">Home News Sport Culture</div>{_AD}{_COOKIE}',
    f'<article>{_paragraphs(_LONG[2], _SHORT[0])}<div class="promo"><p>Our shop has the best maps of the coast, printed on paper that no rain can hurt.</p></div>{_paragraphs(_SHORT[2], _LONG[4])}<div style="display:none"><p>Hidden words that no reader of the page will ever see in it.</p></div></article>',
]
