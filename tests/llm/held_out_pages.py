"""Pages with known main text, none of which is in the labelled set of the extraction model: (html, lines of the text)."""

A = "The river rose by two metres overnight, and by the morning the lower town could only be reached by boat."
B = "Nobody was hurt."
C = "Council members said on Tuesday that the barrier, which was planned years ago, will now be built before the next winter comes."
D = "“We have waited long enough,” said the mayor, who had to leave the hall through a window."
LONG_COMMENT = "I have lived on that street for thirty years and I can tell you that none of this is new, we told them about the drains over and over again and nobody ever listened to a word of it."
LONG_NOTICE = "We and our partners store and access information on your device, such as cookies, and process personal data in order to show content that suits you and to measure how it does."
TEASER = "Five walks along the coast that you can do in an afternoon, with maps, timetables and a place to eat at the end of each of them."
BODY = f"<h1>Flood</h1><p>{A}</p><p>{B}</p><h2>What next</h2><p>{C}</p><p>{D}</p>"
LINES = ["Flood", A, B, "What next", C, D]
LINKS = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("World", "Politics", "Sport", "Weather"))


def _with(before: str = "", inside: str = "", after: str = "", begin: str = "<article>", end: str = "</article>") -> tuple[str, list[str]]:
    half = f"<h1>Flood</h1><p>{A}</p><p>{B}</p>", f"<h2>What next</h2><p>{C}</p><p>{D}</p>"
    return f"<!DOCTYPE html><html><head><title>Flood - The Post</title></head><body>{before}{begin}{half[0]}{inside}{half[1]}{end}{after}</body></html>", LINES


PAGES = [
    _with(),
    _with(f'<nav class="topnav"><ul>{LINKS}</ul></nav>', "", "<footer><p>The Post, 12 Mill Lane</p></footer>"),
    _with("", "", f"<section id='comments'><h2>3 comments</h2><p>{LONG_COMMENT}</p><p>{LONG_COMMENT}</p></section>"),
    _with("", "", "", "<article>", f"<section id='comments'><p>{LONG_COMMENT}</p><div><p>{LONG_COMMENT}</p></div></section></article>"),
    _with("", "", f"<div class='comment-list'><div class='comment-body'><p>{LONG_COMMENT}</p></div><div class='comment-body'><p>{LONG_COMMENT}</p><p>{B}</p></div></div>"),
    _with("", "", f"<div id='disqus_thread'><div class='post-message'><p>{LONG_COMMENT}</p></div></div>"),
    _with("", "", f"<ol class='commentlist'><li><article><p>{LONG_COMMENT}</p></article></li></ol>"),
    _with(f"<div id='cookie-consent'><p>{LONG_NOTICE}</p><button>OK</button></div>"),
    _with(f"<div class='cookieConsent'><div><p>{LONG_NOTICE}</p><p>{LONG_NOTICE}</p></div></div>"),
    _with(f"<div class='gdpr-overlay' role='dialog'><div>{LONG_NOTICE}</div></div>"),
    _with(f"<div role='alert'><p>Roads in the lower town are closed until further notice, take the upper bridge instead.</p></div>"),
    _with("", "", f"<div class='col-right'><p>{TEASER}</p><p>{TEASER}</p></div>"),
    _with(f"<div class='left-sidebar'><div class='box'><h3>About us</h3><p>{TEASER}</p></div></div>"),
    _with("", "", f"<aside><h4>More from here</h4><p>{TEASER}</p><ul>{LINKS}</ul></aside>"),
    _with("", f"<aside class='pullquote-box'><p>{TEASER}</p></aside>"),
    _with("", f"<div class='ad-slot'><p>{TEASER}</p></div>"),
    _with("", f"<div class='advertisement'><span>Advertisement</span><p>{TEASER}</p></div>", f"<div class='sponsored-content'><p>{TEASER}</p></div>"),
    _with("", f"<form action='/letter'><h3>Our letter</h3><p>{TEASER}</p><input name='m'><button>Send</button></form>"),
    _with("", f"<div class='newsletter-signup'><p>{TEASER}</p></div>"),
    _with(f"<header class='site-header'><div><p>The Post</p><p>{TEASER}</p></div><nav><ul>{LINKS}</ul></nav></header>"),
    _with("", "", f"<div class='site-footer'><div><p>{TEASER}</p></div><p>© 2021 The Post</p></div>"),
    _with("", "", f"<div class='relatedStories'><h3>Related</h3><div><a href='/w'>Walks</a><p>{TEASER}</p></div></div>"),
    _with("<div id='wrapper'><div class='menu-main'><ul>" + LINKS + "</ul></div>", "", "</div>", "<div class='entry-content'>", "</div>"),
    _with("<div id='page'>", "", f"<div id='secondary'><p>{TEASER}</p></div></div>", "<main id='main'><div class='story-body'>", "</div></main>"),
    _with("", "<script>var a='<p>no</p>';</script><style>p{}</style><svg><text>Map</text></svg>", "<script>x()</script>", "<main>", "</main>"),
    _with("", "", "", "<article class='post-77 post type-post tag-share category-social'>", f"<div class='share-buttons'><ul>{LINKS}</ul></div></article>"),
    _with("", "", f"<p>© 2021 The Post. All rights reserved.</p>", "<article><div class='article-header'></div>"),
    ("<p>plain", ["plain"]),
    (f"{A}\n\n{C}", [f"{A} {C}"]),
    (f"<html><body>{A}<br><br>{C}</body></html>", [f"{A} {C}"]),
    (f"<article><h1>Flood &amp; fire</h1><p>{A}<br>{B}</p><ul><li>{C}</li><li>Two&nbsp;\n words</li></ul><blockquote>{D}</blockquote><table><tr><td>Height</td><td>2 m</td></tr></table><pre>a  b</pre></article>", ["Flood & fire", f"{A} {B}", C, "Two words", D, "Height", "2 m", "a b"]),
    (f"<body class='single has-sidebar comments-open'><main class='content with-sidebar'>{BODY}</main><div class='sidebar'><p>{TEASER}</p></div></body>", LINES),
    (f"<article><header><h1>Flood</h1></header><p>{A}<p>{B}<h2>What next</h2><p>{C}<p>{D}<footer><p>Filed under rivers</p></footer></article>", LINES),
    (f"<article>{BODY}<svg><rect data-y=\"1\"/></svg><p data-y=\"0\">{C}</p></article><div class='chart'><rect data-y='1'></rect></div>", [*LINES, C]),
]

_THREE, _LINES = f"<p>{A}</p><p>{C}</p><p>{D}</p>", [A, C, D]
# names with a word of boilerplate in them, forms around a page, deep trees, and nameless parts that a heading gives away
PAGES += [
    (f"<body>{begin}{_THREE}{end}</body>", _LINES)
    for begin, end in (
        ('<div class="content-with-sidebar">', "</div>"), ('<div class="layout-fixed-header"><main>', "</main></div>"), ('<div class="tabs-container"><div class="entry-content">', "</div></div>"),
        ('<div class="reviews">', "</div>"), ('<div id="discussion-paper">', "</div>"), ('<div class="modal-page"><div class="article-body">', "</div></div>"),
        ('<form id="aspnetForm"><article>', "</article></form>"), ('<div id="aspnetForm">', "</div>"), ("<article>" + "<div>" * 200, "</div>" * 200 + "</article>"), ('<div id="content">' + "<div>" * 400, "</div>" * 400 + "</div>"),
    )
] + [
    _with("", "", f"<div><h3>3 Comments</h3><p>{LONG_COMMENT}</p><p>{LONG_COMMENT}</p></div>"),
    _with("", "", f"<div><h4>About the author</h4><p>{TEASER}</p></div>"),
    (f"<body><nav><ul>{LINKS}</ul></nav><div class='cookie-consent'><p>{LONG_NOTICE}</p></div><footer><p>{TEASER}</p></footer></body>", []),
    (f"<body><div class='comments'><p>{LONG_COMMENT}</p><p>{LONG_COMMENT}</p></div></body>", []),
    (f"<body><div class='main'><p>{A}</p></div><section class='comments'><article><p>{LONG_COMMENT}</p></article><article><p>{LONG_COMMENT}</p></article></section></body>", [A]),
    (f"<body><form class='search-form'><p>{LONG_NOTICE}</p></form></body>", []),
]
