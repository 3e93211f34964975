"""Labelled pages: main text lies between <!--main--> and <!--/main-->. Weights are learned from their counts.

Four pages are written out; the others are put together by rule from layouts, parts of articles and parts that are none, each labelled here by hand."""

from __future__ import annotations

_WRITTEN = [
    """<html><head><title>Tides</title></head><body><div id="top"><a href="/">Harbour Post</a> <a href="/a">News</a> <a href="/b">Boats</a></div>
<nav><ul><li><a href="/1">Home</a></li><li><a href="/2">Charts</a></li><li><a href="/3">About us</a></li></ul></nav>
<article><!--main--><h1>Why spring tides run high</h1><p>Twice a month the sun and the moon pull along one line and the sea answers with its widest range.</p>
<p>Sailors who <a href="/x">know the table</a> plan a landing for the hour of slack water, when the stream has <b>no strength</b> left in it.<br>
Those who do not know it wait on the bar.</p><h2>Neaps</h2><p>A week later the two pull across each other and the range is small.</p><!--/main--></article>
<aside><h3>Read next</h3><ul><li><a href="/r1">Knots for beginners</a></li><li><a href="/r2">The old lighthouse</a></li></ul></aside>
<footer>Copyright Harbour Post <a href="/t">Terms</a> <a href="/p">Privacy</a></footer></body></html>""",
    """<html><body><div class="cookie-notice"><p>We use cookies on this site.</p><button>Accept all</button></div>
<div class="menu"><span>Recipes</span><span>Shop</span><span>Log in</span></div>
<div class="wrap"><div class="main"><!--main--><h1>Barley soup</h1><p>Wash the barley and leave it in cold water for a night.</p><ul><li>two cups of barley</li><li>one leek, cut fine</li>
<li>a spoon of salt and a little butter</li></ul><p>Simmer everything for an hour, stir now and then, and serve it with dark bread.</p><!--/main--></div>
<div class="comments"><p>Anna: my family loved this one!</p><p>Ben: too much salt for me.</p><form><input name="c"><label>Your comment</label></form></div></div>
<div class="ad">Buy our new pans today and save ten percent.</div><footer><p>All rights reserved</p></footer></body></html>""",
    """<html><body><header><h1>City Council</h1><a href="/">Start</a></header><main><!--main--><h2>Road works in March</h2><p>The bridge on Mill Street closes on the third of March for four weeks.
Buses take the ring road and stop at the school instead.</p><table><tr><td>Line 4</td><td>every ten minutes</td></tr><tr><td>Line 9</td><td>every half hour</td></tr></table>
<blockquote><p>We know that this is a burden, the mayor said, and we thank everyone for their patience.</p></blockquote><!--/main--></main>
<form><label>Search this site</label><select><option>News</option><option>Offices</option></select></form><footer><a href="/i">Imprint</a> <a href="/d">Data protection</a></footer></body></html>""",
    """<html><body><table><tr><td><a href="a.html">Index</a><br><a href="b.html">Links</a><br><a href="c.html">Guest book</a></td><td><!--main--><p>My grandfather kept bees on the slope behind the house for forty years,
and this page tells how he did it.</p><p>In spring he looked at each hive on the first warm day, counted the frames that were full, and wrote the numbers on the inside of the lid.<br><br>
In autumn he fed sugar to the weak ones.</p><!--/main--></td></tr></table><hr><center><font size="1">You are visitor number 1024</font></center></body></html>""",
]

#: Layouts: what stands before and after the content column, and the tags around the main text.
_LAYOUTS = [
    ("<body>{a}<article>{m}</article>{b}</body>"),
    ("<body>{a}<main><article>{m}</article></main>{b}</body>"),
    ('<body><div id="page" class="page-wrapper">{a}<div class="content with-sidebar"><div class="post entry-content">{m}</div>{b}</div></div></body>'),
    ('<body class="single has-sidebar">{a}<div class="container"><div class="row"><div class="col main-column">{m}</div>{b}</div></div></body>'),
    ("<body>{a}<table><tr><td>{m}</td></tr></table>{b}</body>"),
    ('<body><div class="wrapper site-container"><div class="inner">{a}<section class="article-body text">{m}</section></div>{b}</div></body>'),
    ('<body>{a}<div role="main" class="story layout no-sidebar">{m}</div>{b}</body>'),
    ("<body>{a}{m}{b}</body>"),
]
#: Blocks of articles, by tag and attributes; the second entry is what they hold: prose, a short line, prose with a link, or items.
_INSIDE = [
    ("p", "", "prose"), ("p", "", "linked"), ("p", ' class="lead"', "prose"), ("p", ' class="share-price"', "prose"), ("p", ' class="note"', "prose"), ("p", ' class="summary intro"', "prose"),
    ("h2", "", "line"), ("h2", ' class="section-header"', "line"), ("h3", ' class="subtitle sub-header"', "line"), ("h2", ' class="section-title"', "line"), ("h1", ' class="article-header post-title"', "line"), ("h1", "", "line"),
    ("ul", "", "items"), ("ol", ' class="steps"', "items"), ("blockquote", "", "prose"), ("blockquote", ' class="pull-quote"', "prose"), ("figure", ' class="image"', "caption"), ("pre", ' class="code"', "line"),
    ("div", ' class="paragraph text"', "prose"), ("div", ' class="alert-box"', "prose"), ("div", ' class="info-box"', "prose"), ("div", ' class="warning box"', "prose"), ("div", ' class="tip"', "prose"), ("div", ' class="highlight"', "line"),
    ("div", ' class="section"', "prose"), ("section", "", "prose"), ("section", ' class="chapter"', "linked"), ("table", ' class="data"', "cells"), ("table", ' class="history-table"', "cells"), ("div", ' class="comment-on-the-law"', "prose"),
    ("ul", ' class="list"', "items"), ("div", ' class="link-list"', "items"), ("div", ' class="media image-right"', "caption"), ("p", ' class="top"', "prose"), ("div", ' class="user-guide"', "linked"), ("div", ' class="next-steps"', "prose"),
    ("div", ' class="bar-chart"', "caption"), ("div", ' class="area-map"', "caption"), ("div", ' class="reading-list"', "items"), ("div", ' class="button-row form-example"', "line"), ("p", ' class="market-share"', "prose"), ("td", ' class="social-history"', "line"),
    ("h3", "", "line"), ("h4", "", "line"), ("h5", ' class="topic"', "line"), ("div", ' class="page-break page-2"', "prose"), ("div", ' class="search-theory related-work"', "prose"), ("div", ' class="item entry"', "linked"), ("div", ' class="wrap block"', "prose"), ("div", ' class="clear left"', "prose"),
    ("dl", "", "terms"), ("div", "", "prose"), ("div", "", "linked"), ("span", ' class="text"', "line"), ("div", ' class="footnotes"', "items"), ("p", ' class="first"', "prose"), ("div", ' class="table-container"', "cells"), ("p", ' class="byline author"', "line"),
]
#: Blocks that are no part of an article.
_OUTSIDE = [
    ("nav", "", "menu"), ("nav", ' class="main-navigation"', "menu"), ("div", ' class="menu"', "menu"), ("div", ' id="nav"', "menu"), ("ul", ' class="navbar"', "menu"), ("div", ' role="navigation"', "menu"), ("div", ' class="breadcrumbs"', "menu"), ("ul", ' class="pagination pager"', "menu"), ("menu", "", "menu"), ("div", ' class="toolbar"', "menu"),
    ("header", "", "head"), ("header", ' class="site-header"', "head"), ("div", ' class="header"', "head"), ("div", ' class="masthead banner"', "head"), ("div", ' id="header"', "head"), ("div", ' role="banner"', "head"), ("div", ' class="page-header"', "head"),
    ("footer", "", "legal"), ("footer", ' class="site-footer"', "legal"), ("div", ' class="footer"', "legal"), ("div", ' id="footer"', "legal"), ("div", ' class="copyright"', "legal"), ("div", ' role="contentinfo"', "legal"),
    ("aside", "", "teaser"), ("aside", ' class="widget"', "teaser"), ("div", ' class="sidebar"', "teaser"), ("div", ' id="sidebar"', "teaser"), ("div", ' class="related"', "teaser"), ("div", ' class="related-posts"', "teaser"), ("div", ' class="recommended"', "teaser"), ("div", ' class="recommendations"', "teaser"), ("div", ' role="complementary"', "teaser"), ("div", ' class="widget-area"', "teaser"), ("section", ' class="read-next related"', "teaser"),
    ("div", ' class="ad"', "pitch"), ("div", ' class="ads"', "pitch"), ("div", ' class="advert"', "pitch"), ("div", ' class="advertisement"', "pitch"), ("div", ' id="ad-top"', "pitch"), ("div", ' class="ad-slot"', "pitch"), ("div", ' class="sponsored"', "pitch"), ("div", ' class="sponsor-box"', "pitch"), ("div", ' class="promo"', "pitch"), ("section", ' class="promotion"', "pitch"), ("p", ' class="ad"', "pitch"), ("div", ' class="advertising"', "pitch"), ("div", ' class="ad-banner"', "pitch"),
    ("div", ' class="cookie-banner"', "notice"), ("div", ' class="cookie-notice"', "notice"), ("div", ' id="cookies"', "notice"), ("div", ' class="consent"', "notice"), ("div", ' class="notice"', "notice"), ("div", ' class="popup"', "notice"), ("div", ' class="modal"', "notice"), ("dialog", "", "notice"), ("div", ' role="dialog"', "notice"), ("p", ' class="cookie-notice"', "notice"), ("div", ' role="alert"', "notice"), ("div", ' class="alert"', "notice"), ("div", ' class="gdpr-consent"', "notice"),
    ("form", "", "form"), ("form", ' class="search-form"', "form"), ("div", ' class="search"', "form"), ("div", ' class="newsletter"', "form"), ("div", ' class="newsletter-signup"', "form"), ("div", ' class="subscribe"', "form"), ("div", ' class="signup"', "form"), ("div", ' id="login"', "form"), ("div", ' role="search"', "form"), ("button", "", "word"), ("select", "", "word"),
    ("div", ' class="comments"', "talk"), ("section", ' id="comments" class="comments-area"', "talk"), ("div", ' class="comment"', "talk"), ("ol", ' class="comment-list"', "talk"), ("div", ' class="replies"', "talk"), ("div", ' class="reply"', "talk"), ("div", ' id="respond"', "talk"), ("div", ' id="disqus_thread"', "talk"), ("div", ' class="user-comments"', "talk"),
    ("div", ' class="share"', "word"), ("div", ' class="share-buttons"', "menu"), ("div", ' class="sharing"', "menu"), ("div", ' class="social"', "menu"), ("ul", ' class="social-links"', "menu"), ("div", ' class="share-bar"', "word"), ("div", ' class="social-media sharedaddy"', "menu"),
    ("div", ' class="werbung"', "pitch"), ("div", ' class="anzeige"', "pitch"), ("div", ' class="publicidad"', "pitch"), ("div", ' class="anuncio"', "pitch"), ("div", ' class="publicite"', "pitch"), ("div", ' class="banniere-pub"', "pitch"),
    ("div", ' class="kommentare"', "talk"), ("div", ' id="kommentare"', "talk"), ("div", ' class="comentarios"', "talk"), ("div", ' id="comentarios"', "talk"), ("div", ' class="commentaires"', "talk"), ("div", ' id="commentaires"', "talk"),
    ("div", ' class="seitenleiste"', "teaser"), ("div", ' class="barra-lateral"', "teaser"), ("div", ' class="barre-laterale"', "teaser"), ("div", ' class="poll"', "form"), ("div", ' class="poll-results"', "word"), ("div", ' class="quiz"', "form"), ("div", ' class="teaser"', "teaser"),
]


def _prose(n: int) -> str:
    return " ".join(["word"] * n)


def _block(tag: str, attrs: str, holds: str, k: int) -> str:
    n = 9 + k % 31
    link = lambda words: f'<a href="/{k}">{_prose(words)}</a>'
    inner = {
        "prose": [f"{_prose(2 * n)} <b>{_prose(2)}</b> {_prose(n)}<br>{_prose(n)}", f"{_prose(n)} <em>{_prose(1)}</em> {_prose(3 * n)}", f"{_prose(2 * n)} <strong>{_prose(1)}</strong> <i>{_prose(2)}</i> <span>{_prose(2)}</span>", _prose(3 * n)][k % 4], "line": _prose(3 + n % 4), "linked": f"{_prose(n)} {link(2)} {_prose(n)}", "items": "".join(f"<li>{_prose(4 + (n + i) % 9)}</li>" for i in range(4)),
        "cells": "".join(f"<tr><td>{_prose(3)}</td><td>{_prose(5)}</td></tr>" for _ in range(4)), "terms": "".join(f"<dt>{_prose(2)}</dt><dd>{_prose(n)}</dd>" for _ in range(3)), "caption": f"<img><figcaption>{_prose(7)}</figcaption>",
        "menu": ["<ul>" + "".join(f"<li>{link(1 + i % 2)}</li>" for i in range(6)) + "</ul>", "<table><tr>" + "".join(f"<td>{link(1)}</td>" for _ in range(5)) + "</tr></table>", "".join(f"{link(1)} <br>" for _ in range(5))][k % 3], "head": f"<h1>{_prose(3)}</h1>{link(1)}{link(1)}", "legal": f"<p>{_prose(6)} {link(1)} {link(2)}</p>",
        "teaser": f"<h{2 + k % 4}>{_prose(2)}</h{2 + k % 4}>" + [f"<ul>" + "".join(f"<li>{link(5)}</li>" for _ in range(4)) + f"</ul><p>{_prose(12)}</p>", f"<figure><img><figcaption>{link(6)}</figcaption></figure>", f"<dl><dt>{link(3)}</dt><dd>{_prose(8)}</dd></dl>", f"<table><tr><td>{link(3)}</td><td>{_prose(7)} <b>{_prose(1)}</b></td></tr></table>"][k % 4], "pitch": f"{_prose(n)} {link(3)}", "notice": f"<p>{_prose(n)} {link(2)}</p><button>{_prose(1)}</button>",
        "form": f"<label>{_prose(2)}</label><input><button>{_prose(1)}</button>", "word": _prose(2), "talk": "".join(f"<div><{'b' if k % 2 else 'strong'}>{_prose(1)}</{'b' if k % 2 else 'strong'}><p>{_prose(n)}</p></div>" for _ in range(2)) + f"<div><blockquote>{_prose(5)}</blockquote><span>{_prose(n)} <em>{_prose(1)}</em> <i>{_prose(1)}</i></span></div>",
    }[holds]
    return f"<{tag}{attrs}>{inner}</{tag}>"


def _made(k: int) -> str:
    """The k-th page: every part comes up as often as its neighbours, in changing company; some stand within the article."""
    out = lambda i: _block(*_OUTSIDE[(7 * k + 11 * i) % len(_OUTSIDE)], k + i)
    parts = [_block(*_INSIDE[(5 * k + 7 * i) % len(_INSIDE)], k + i) for i in range(14 + k % 9)]
    parts.insert(len(parts) // 2, f"<!--/main-->{out(6)}<!--main-->")
    return "<html>" + _LAYOUTS[k % len(_LAYOUTS)].format(a=out(0) + out(1) + out(2), m="<!--main-->" + "".join(parts) + "<!--/main-->", b=out(3) + out(4) + out(5)) + "</html>"


PAGES = [*_WRITTEN, *(_made(k) for k in range(240))]
