"""Pages of other makes than the generator's, with the text of their article."""

BLOG = (
    """<!doctype html><html lang=en><head><meta charset=utf-8><title>Baking rye | Crumbs</title>
<link rel=stylesheet href=a.css><script>window.dataLayer=[]</script></head>
<body class="single single-post"><div id="page" class="site"><a class="skip-link" href="#content">Skip to content</a>
<header id="masthead" class="site-header"><div class="site-branding"><p class="site-title"><a href="/">Crumbs</a></p><p class="site-description">A kitchen diary</p></div>
<nav id="site-navigation" class="main-navigation"><ul id="primary-menu"><li><a href="/about">About</a></li><li><a href="/recipes">Recipes</a></li><li><a href="/contact">Contact</a></li></ul></nav></header>
<main id="primary" class="site-main"><article id="post-71" class="post type-post hentry">
<h1 class="entry-title">Baking rye without a mixer</h1>
<div class="entry-content"><p>The dough looked like wet cement, and I was sure that it would never rise.</p>
<p>It did. After <em>eighteen hours</em> on the counter the bowl was full &amp; smelled of apples.</p>
<h2>What you need</h2><ul><li>500 g of dark rye flour</li><li>400 ml of water</li><li>a spoon of salt</li></ul>
<p>Bake it for an hour at 220 degrees, then wait a day before you cut it.</p></div></article>
<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts on this post</h2><ol class="comment-list"><li class="comment"><p>Mine stuck to the tin!</p></li><li class="comment"><p>Try more flour.</p></li></ol>
<div id="respond" class="comment-respond"><h3>Leave a Reply</h3><form action="/c"><label>Name</label><input name=n><button>Post Comment</button></form></div></div></main>
<aside id="secondary" class="widget-area"><section class="widget widget_recent_entries"><h2>Recent Posts</h2><ul><li><a href="/1">Soup in winter</a></li><li><a href="/2">Knives</a></li></ul></section></aside>
<footer id="colophon" class="site-footer"><div class="site-info">Proudly powered by bread. &copy; 2021 Crumbs</div></footer></div></body></html>""",
    ["Baking rye without a mixer", "The dough looked like wet cement, and I was sure that it would never rise.", "It did. After eighteen hours on the counter the bowl was full & smelled of apples.", "What you need", "500 g of dark rye flour", "400 ml of water", "a spoon of salt", "Bake it for an hour at 220 degrees, then wait a day before you cut it."],
)
NEWS = (
    """<html><head><title>Council votes for the bridge</title></head><body>
<div class="cookie-banner" role="dialog"><p>We use cookies to improve your visit.</p><button>Accept all</button></div>
<div class="top-bar"><a href="/subscribe">Subscribe</a> <a href="/login">Log in</a></div>
<div class="navbar"><ul class="nav"><li><a href="/w">World</a><li><a href="/l">Local</a><li><a href="/s">Sport</a></ul></div>
<div class="ad-slot" id="ad-top">Advertisement</div>
<div class="content"><h1>Council votes for the bridge</h1>
<p>The town council voted on Tuesday night to rebuild the old bridge over the mill race.</p>
<p>Nine members were in favour, four were against and one was not there.</p>
<div class="promo related"><h4>Read more</h4><a href="/x">Flood of 1987: the pictures</a></div>
<blockquote>We have waited for thirty years,</blockquote><p>said the mayor after the vote.</p>
<p>Work is to begin in spring. It will cost about two million.</p></div>
<div class="sidebar"><h3>Most read</h3><ol><li><a href="/a">Dog found after a week</a></li><li><a href="/b">Roadworks until May</a></li></ol></div>
<div class="newsletter-signup"><p>Get the news by mail every morning.</p><form><input type=email><button>Sign up</button></form></div>
<div class="footer"><ul><li><a href="/imprint">Imprint</a></li><li><a href="/privacy">Privacy</a></li></ul><p>&copy; The Mill Gazette. All rights reserved.</p></div></body></html>""",
    ["Council votes for the bridge", "The town council voted on Tuesday night to rebuild the old bridge over the mill race.", "Nine members were in favour, four were against and one was not there.", "We have waited for thirty years,", "said the mayor after the vote.", "Work is to begin in spring. It will cost about two million."],
)
DOCS = (
    """<!DOCTYPE html><html><head><title>Queues - Handbook</title><style>body{margin:0}</style></head><body>
<nav class="sidebar-nav"><div class="toc"><ul><li><a href="/i">Install</a></li><li><a href="/q" class=active>Queues</a></li><li><a href="/w">Workers</a></li></ul></div></nav>
<main class="doc-content"><div class="markdown-body"><h1 id="queues">Queues</h1>
<p>A queue holds tasks until a worker takes them. Tasks leave in the order in which they came.</p>
<pre><code>queue = Queue(size=10)
queue.put(task)</code></pre>
<p>When the queue is full, <code>put</code> waits.</p>
<table><thead><tr><th>Option</th><th>Meaning</th></tr></thead><tbody><tr><td>size</td><td>most tasks held</td></tr></tbody></table>
<p>See the chapter on workers for the other end.</p></div></main>
<footer><p>Built with Handbook 3.1</p></footer></body></html>""",
    ["Queues", "A queue holds tasks until a worker takes them. Tasks leave in the order in which they came.", "queue = Queue(size=10) queue.put(task)", "When the queue is full, put waits.", "Option", "Meaning", "size", "most tasks held", "See the chapter on workers for the other end."],
)
PLAIN = (
    """<HTML><BODY><H1>Walks near the lake</H1>
<P>Start at the boat house and keep the water on your left.
<P>After a mile the path climbs to the chapel, from where you can see both shores.
<P>Dogs are welcome, bicycles are not.
</BODY></HTML>""",
    ["Walks near the lake", "Start at the boat house and keep the water on your left.", "After a mile the path climbs to the chapel, from where you can see both shores.", "Dogs are welcome, bicycles are not."],
)
GERMAN = (
    """<!DOCTYPE html><html lang="de"><head><title>Der Garten im M&auml;rz</title></head><body>
<div id="hinweis" class="cookie-hinweis">Diese Seite verwendet Cookies. <a href="/ds">Mehr erfahren</a> <button>Einverstanden</button></div>
<header class="kopf"><a href="/">Gartenblatt</a><nav><a href="/obst">Obst</a> <a href="/gemuese">Gem&uuml;se</a></nav></header>
<div class="wrapper"><section class="beitrag article"><h1>Der Garten im M&auml;rz</h1><div class="byline">Von der Redaktion</div>
<p>Im M&auml;rz wird der Boden langsam warm, und die ersten Beete k&ouml;nnen vorbereitet werden.</p>
<p>Wer jetzt &ndash; bei trockenem Wetter &ndash; die Rosen schneidet, hat im Juni mehr davon.</p>
<ul><li>Kompost verteilen</li><li>Samen bestellen</li></ul></section>
<aside class="werbung ad">Anzeige: D&uuml;nger jetzt g&uuml;nstig</aside></div>
<footer class="fuss"><a href="/impressum">Impressum</a> | <a href="/datenschutz">Datenschutz</a></footer></body></html>""",
    ["Der Garten im März", "Im März wird der Boden langsam warm, und die ersten Beete können vorbereitet werden.", "Wer jetzt – bei trockenem Wetter – die Rosen schneidet, hat im Juni mehr davon.", "Kompost verteilen", "Samen bestellen"],
)
SHOP = (
    """<html><body><div class="header-wrap"><div class="logo"><a href="/">Cellar Books</a></div><form class="search-form"><input><button>Search</button></form></div>
<ul class="breadcrumbs"><li><a href="/">Home</a></li><li><a href="/j">Journal</a></li></ul>
<div id="main"><div class="post"><h2 class="post-title">How we bind our books</h2>
<div class="post-body"><p>Every book that leaves our cellar is sewn by hand with linen thread.</p>
<p>The boards are cut from grey card, which keeps its shape for a century or more.</p>
<p>Glue goes on last, and only on the spine.</p></div>
<div class="share-buttons"><a href="#">Share</a> <a href="#">Pin it</a></div></div>
<div class="related-posts"><h3>You may also like</h3><ul><li><a href="/p">On paper</a></li><li><a href="/q">On ink</a></li></ul></div></div>
<div class="comments"><p class="comment">Lovely work! I bought three.</p></div>
<div class="bottom"><p>Free delivery on orders over 50.</p><p>&copy; 2019 Cellar Books Ltd</p></div></body></html>""",
    ["How we bind our books", "Every book that leaves our cellar is sewn by hand with linen thread.", "The boards are cut from grey card, which keeps its shape for a century or more.", "Glue goes on last, and only on the spine."],
)
FOREIGN = [BLOG, NEWS, DOCS, PLAIN, GERMAN, SHOP]
