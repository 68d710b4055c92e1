"""Pages written and labelled by hand, apart from the generator: (html, main text)."""

PAGES = [
    (
        """<!DOCTYPE html><html lang="en"><head><title>River levels fall - The Weekly</title></head><body class="single">
<header class="site-header"><a href="/">The Weekly</a><nav><ul><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li><li><a href="/about">About us</a></li></ul></nav></header>
<div class="cookie-banner" role="dialog"><p>We use cookies to improve your experience.</p><button>Accept all</button></div>
<main><article class="post"><h1>River levels fall after a dry spring</h1>
<p>Water levels in the upper valley have fallen to their lowest point in twelve years, the regional water office said on Monday.</p>
<p>Farmers along the banks were told to <b>halve</b> the water that they draw until the end of June.</p>
<h2>What comes next</h2>
<p>A second measurement is planned for July. &quot;We expect little rain,&quot; said the head of the office.</p></article></main>
<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/a">Bridge closed for repairs</a></li><li><a href="/b">Market moves to the square</a></li></ul></aside>
<section class="comments"><h3>2 comments</h3><div class="comment"><p>About time they said so!</p></div><div class="comment"><p>My well is dry as well, has been since May.</p></div></section>
<footer><p>&copy; 2023 The Weekly. All rights reserved.</p><a href="/privacy">Privacy policy</a></footer></body></html>""",
        'River levels fall after a dry spring\n\nWater levels in the upper valley have fallen to their lowest point in twelve years, the regional water office said on Monday.\n\nFarmers along the banks were told to halve the water that they draw until the end of June.\n\nWhat comes next\n\nA second measurement is planned for July. "We expect little rain," said the head of the office.',
    ),
    (
        """<html><body><div id="page"><div id="top-menu"><a href="/">Home</a> <a href="/blog">Blog</a> <a href="/contact">Contact</a></div>
<div id="content"><h1>How I fixed my bicycle</h1>
<p>The chain kept slipping, so I took the rear wheel off and looked at the cassette.
<p>Three teeth were worn. A new cassette costs less than a visit to the shop, and the work took an hour.
<ul><li>Remove the wheel and the lock ring.<li>Slide the old cassette off.<li>Clean the hub before the new one goes on.</ul>
<p style="display:none">hidden tracking text that nobody should read</p>
<p>It has been quiet ever since.</div>
<div class="related"><h4>Related posts</h4><a href="/1">A rack from old wood</a><a href="/2">Painting a frame</a></div>
<form class="newsletter"><label>Your e-mail</label><input name="e"><button>Subscribe</button></form>
<div class="footer">Powered by a small machine in the cellar</div></div></body></html>""",
        "How I fixed my bicycle\n\nThe chain kept slipping, so I took the rear wheel off and looked at the cassette.\n\nThree teeth were worn. A new cassette costs less than a visit to the shop, and the work took an hour.\n\nRemove the wheel and the lock ring.\n\nSlide the old cassette off.\n\nClean the hub before the new one goes on.\n\nIt has been quiet ever since.",
    ),
    (
        """<!doctype html><html lang="de"><body><nav class="breadcrumb"><a href="/">Start</a> <a href="/r">Rezepte</a></nav>
<article><header><h1>Kartoffelsuppe</h1></header><p>Die Kartoffeln sch&auml;len, in W&uuml;rfel schneiden und mit der Zwiebel in Butter anschwitzen.</p><div class="ad-slot"><p>Anzeige</p><p>Jetzt zum halben Preis!</p></div><p>Mit Br&uuml;he aufgie&szlig;en und zwanzig Minuten kochen lassen, danach mit Salz und Muskat abschmecken.</p></article>
<div class="share-buttons"><a href="#">Teilen</a><a href="#">Drucken</a></div><footer>Impressum | Datenschutz</footer></body></html>""",
        "Kartoffelsuppe\n\nDie Kartoffeln schälen, in Würfel schneiden und mit der Zwiebel in Butter anschwitzen.\n\nMit Brühe aufgießen und zwanzig Minuten kochen lassen, danach mit Salz und Muskat abschmecken.",
    ),
    (
        """<html><body><div class="wrap"><div class="navbar"><ul><li><a href="/x">Docs</a><li><a href="/y">Download</a></ul></div><div class="entry-content"><h2>Release notes 2.4</h2><p>This release mends the import of large tables and makes sorting stable.</p><pre>tool import --sort table.csv</pre><blockquote><p>Thanks to all who reported the fault.</p></blockquote></div><div class="sidebar widget"><p>Popular tags</p><a href="/t1">release</a></div></div><script>document.write("<p>no</p>")</script></body></html>""",
        "Release notes 2.4\n\nThis release mends the import of large tables and makes sorting stable.\n\ntool import --sort table.csv\n\nThanks to all who reported the fault.",
    ),
    ("""<html><body><nav><a href="/">Home</a><a href="/login">Log in</a></nav><form class="login"><label>Name</label><input><label>Password</label><input type="password"><button>Log in</button></form><footer>Terms of use</footer></body></html>""", ""),
]
