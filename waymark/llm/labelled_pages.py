"""Labelled pages, written for main-text extraction: markup with each stretch of the article between two marks.

``TRAINING`` teaches the weights. ``HELD_OUT`` is never learned from; the tests measure on it.
Fixed values: the two marks.
"""

BEGIN, END = "␂", "␃"

TRAINING = (
    # a plain layout with a header, a menu and a footer
    "<html><head><title>x</title></head><body><header><a href=/>Site name</a> <a href=/n>News</a></header><nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two words</a></li><li><a href=/c>Three</a></li></ul></nav>"
    "<main>␂<h1>A title of several words</h1><p>The first paragraph has a <a href=/x>link to elsewhere</a> and some more words in it, as paragraphs have.</p><p>Second one, short.</p>␃</main><footer>Copyright of the site, all rights reserved. <a href=/c>Contact us</a></footer></body></html>",
    # an advert before the article, comments behind it
    "<body><div class=ad>Buy this now, only today, at half the price</div><article>␂<h1>Report</h1><p>Words that tell what happened, one after the other, until it was over.</p><p>Then what came of it.</p>␃</article>"
    "<div class=comments><h3>Comments</h3><p>I like what you wrote here</p><p>So do I and more</p></div><footer>All rights reserved by the owner</footer></body>",
    # an old page without article elements
    "<body><div id=top><a href=/>Home</a><a href=/s>Shop</a><a href=/t>Travel</a></div><div>␂<h2>Plain page</h2><p>A page of the old kind has no article element but paragraphs with many words.</p><p>They follow each other.</p>"
    "<ul><li>also a list</li><li>of plain items</li></ul>␃</div><div class=footer>© owner of the page</div><div><a href=/p>Privacy</a> <a href=/t>Terms</a></div></body>",
    # notice, sidebar and a form
    "<body><div class=cookie-notice><p>We use cookies on this site to serve you well</p><button>Accept</button></div><nav><a href=/1>First</a><a href=/2>Second</a></nav><div class=post>␂<h1>Walk</h1><p>It was a long walk to the lake and back.</p>"
    "<blockquote>Never again, said one.</blockquote><p>We slept for <em>two days</em>.</p>␃</div><aside><p>Most read pieces of this week</p><a href=/m>More</a></aside><form><label>Your mail</label><input><button>Subscribe</button></form></body>",
    # an advert and a promotion inside the article
    "<body><div class=page><article>␂<h1>Harbour</h1><p>The boats came in at six, before the wind rose over the bay.</p>␃<div class=advert>Cheap boats for sale, call this number at once</div>␂<p>By seven the harbour was full.</p>␃<aside class=promo>Read also about our other fine stories</aside>"
    "␂<p>Nobody left before noon, as the log tells.</p>␃</article></div><footer>Imprint of the house</footer></body>",
    # a banner and a box of links inside the article of a main element
    "<body><main class=site-main><article>␂<h2>Hay</h2><p>The hay was cut on the first dry day and brought in on the third.</p>␃<div class=ads>Tractors for rent, new and used, from a house you know</div>␂<p>It filled the barn up to the roof.</p>␃<div class=ad>Boots that stay dry</div></article></main><footer>Farm and field</footer></body>",
    # a sidebar beside the article, related links
    "<body><div class=wrapper><div class=content>␂<h1>On bread</h1><p>Flour, water and salt are all it takes, and time.</p><p>Knead it for as long as a song lasts.</p>␃</div><div class=sidebar><h3>About</h3><p>This site is about many things that people do at home</p><ul><li><a href=/1>Soup</a></li><li><a href=/2>Cake</a></li></ul></div></div>"
    "<div class=related><h3>Related</h3><a href=/5>Five ways to bake</a></div><div class=footer>Made by hand in a kitchen</div></body>",
    # layout classes on the body and wrappers say nothing about the text inside
    "<body class='home with-sidebar has-nav'><div class='layout with-sidebar'><main><article>␂<h1>Few</h1><p>Few words stand here, but they are the text of this page.</p>␃</article></main><div id=sidebar><p>Links and things to look at</p></div></div><footer><p>Imprint and privacy notes of the owner</p></footer></body>",
    # teasers of other articles beside the real one
    "<body><main><article>␂<h1>The bridge</h1><p>The old bridge was closed in spring and will open next year, the town said.</p><p>Until then a ferry runs.</p>␃</article><section class=related><article class=card><a href=/a>A teaser of something else</a><p>Read it here</p></article>"
    "<article class=card><a href=/b>One more teaser</a><p>And this one too</p></article></section></main><footer>Contact and imprint</footer></body>",
    # comments as articles
    "<body><div class=post>␂<h1>Post</h1><p>The words of the post stand here and go on for a while.</p><p>They end here.</p>␃</div><section id=comments><article class=comment><p>I like what you wrote about it</p></article><article class=comment><p>I do not, and here is why</p></article><form class=respond><label>Reply</label><textarea></textarea></form></section></body>",
    # tables, figures, code and definition lists belong to the text
    "<body><nav class=breadcrumb><a href=/>Home</a> <a href=/d>Docs</a></nav><article>␂<h1>Manual</h1><p>Set the value first.</p><table><tr><th>Name</th><th>Value</th></tr><tr><td>speed</td><td>fast or slow</td></tr></table><figure class=banner-image><img src=x><figcaption>What the screen shows then</figcaption></figure>"
    "<pre>set speed fast</pre><dl><dt>speed</dt><dd>how fast it goes</dd></dl><ul class=tags-list><li>first step of all</li><li>second step after it</li></ul><p>Then <label>this label</label> is shown with <math><mi>x</mi></math> beside it.</p>␃</article><div class=pager><a href=/p>Previous</a><a href=/n>Next</a></div></body>",
    # share buttons, tags and an author box
    "<body><header class=masthead><h1>The Daily</h1><p>News since long ago</p></header><article>␂<h2>Rain</h2><p>It rained for nine days, more than in any June before.</p>␃<div class=share><a href=/f>Share</a><a href=/t>Send</a></div>␂<p>On the tenth day it stopped.</p>␃<div class=tags><a href=/t/rain>rain</a><a href=/t/june>june</a></div></article>"
    "<div class=newsletter><p>Sign up for our letter and never miss a story</p><form><input><button>Sign up</button></form></div><div class=copyright>All text is ours</div></body>",
    # links inside paragraphs are part of them
    "<body><div id=menu><ul><li><a href=/1>Start</a></li><li><a href=/2>Club</a></li><li><a href=/3>Dates</a></li></ul></div><div id=text>␂<p>The council met on <a href=/tue>Tuesday evening</a> and voted for the <a href=/plan>new plan of the square</a>.</p><p>All were <a href=/there>there</a>.</p>␃</div><div id=footer>Club of the town, founded long ago</div></body>",
    # header and footer inside the article
    "<body><nav><a href=/>Home</a></nav><article><header>␂<h1>A real title</h1>␃</header>␂<p>Text that has a head of its own and a foot as well.</p><p>It goes on here.</p>␃<footer><a href=/a>By the author</a></footer></article><footer>House of print, all rights kept</footer></body>",
    # a long notice before a short article, and an overlay behind it
    "<body><div class='notice alert'><p>This site will be down on Sunday for some hours while we move it to a new place, so please save what you do</p></div><main>␂<h1>Short</h1><p>A text of few words.</p>␃</main><div class='modal popup overlay'><p>Wait, do not leave yet, take this offer with you</p></div></body>",
    # bare text with line breaks
    "<body><center><a href=/>Index</a></center>␂A page of bare text<br>with lines that break<br>and no paragraph at all.␃<hr><form><input><select><option>Land</option><option>Sea</option></select></form></body>",
    # a menu of buttons, a search box and a list of recommended pieces
    "<body><div role=navigation><button>Menu</button><button>Log in</button></div><div class=search><input><button>Search</button></div><section class=story>␂<h1>Wood</h1><p>Oak is hard, pine is soft, and both burn when they are dry.</p><h2>More on oak</h2><p>Oak grows slowly.</p>␃</section>"
    "<div class=recommended><h3>Recommended for you</h3><ul><li><a href=/r>Stone</a></li><li><a href=/s>Iron</a></li></ul></div><div role=contentinfo>Published by the wood people</div></body>",
    # paragraphs and lists in parts that are never the text
    "<body><header><p>The house of the hill</p><ul><li>Call us</li></ul></header><nav><p>Where to go from here</p></nav><div class=post>␂<p>The hill is high and the way is long.</p><ul><li>bring water</li><li>bring bread</li></ul>␃<ul><li class=share>Share it with your friends</li></ul></div>"
    "<article class=comment><p>What a fine walk that was</p></article><article class=comment><p>It was not for me</p></article><article class=card><h3>Card</h3><p>Read this too</p></article><aside><article><h3>Also</h3><p>Another piece of ours</p></article></aside><footer><p>The people of the hill</p></footer></body>",
    "<body><table><tr><td class=ad>Buy it now</td><td class=ad>Buy two</td></tr></table><table><tr><td>␂Text in a cell of a table</td></tr><tr><td>and in the next row␃</td></tr></table><div class=comments><p>what a fine text this is, and long</p></div><div class=cookie-banner><p>We use cookies here</p></div><form><p>Write to us if you like</p></form></body>",
    # what can interrupt an article: asides, boxes of links, a form, a notice
    "<body><nav><a href=/>Home</a></nav><article>␂<h1>Salt</h1><p>Salt was carried over the pass on mules until the road was built.</p>␃<aside>Read also what we wrote on mules</aside>␂<p>The road changed all that in one summer.</p>␃<div class=newsletter><p>Sign up for the letter of the week</p><form><label>Mail</label><button>Go</button></form></div>"
    "␂<p>By autumn the mules were sold.</p>␃</article><footer>The salt people</footer></body>",
    "<body><main><article>␂<h2>Clay</h2><p>Clay is dug in winter and lies in the frost until spring.</p>␃<div class=related><a href=/1>More on clay</a><a href=/2>More on kilns</a></div>␂<p>Then it is turned and watered.</p>␃<aside><p>The museum of clay is open on Sundays</p></aside>␂<p>The <em>best clay</em> is grey, as all who dig it know.</p>␃"
    "<div class=notice><p>This page will move soon</p></div>␂<ul><li>grey clay for pots</li><li>red clay for tiles</li></ul>␃</article></main><div class=comments><p>My pots are red</p></div></body>",
    # sponsored block and widgets around a section
    "<body><div class=sponsored><p>Paid for by a maker of fine shoes for all feet</p></div><div class=main><section>␂<p>Three of the five came back with the first train.</p><p>The others took the road.</p>␃</section></div><div class=widget><h4>Weather</h4><p>Sun and some cloud</p></div><div class=banner>A big banner over here</div></body>",
)

HELD_OUT = (
    "<html><body><nav><ul><li><a href=/1>Start</a></li><li><a href=/2>Press</a></li></ul></nav><div class=ad>Order now and get the second one free</div><article>␂<h1>The mill</h1><p>The mill stands at the end of the valley. It has four wings.</p><p>Yes.</p>␃</article><footer>&copy; mill.example.org and its friends</footer></body></html>",
    "<body><div class='layout two-columns with-sidebar'><div class=sidebar><p>Things you may like to see</p></div><article>␂<p>The council met on <a href=/t>Tuesday evening</a> and voted.</p><p>It was late.</p>␃</article></div></body>",
    "<body><!-- <article> --><script>var a='<article>'</script><div>␂<h1>Old</h1><p>A page without any article element, but with a text of some words.</p><p>And one more.</p>␃</div><div class=footer>Owner of the page</div></body>",
    "<body><main><article>␂<h1>Snow</h1><p>It snowed in the hills for the whole week and the pass was closed.</p>␃<div class=ad>Warm coats at half the price, today only</div>␂<p>On Monday the plough came.</p>␃</article><article class=card><a href=/x>A teaser for another piece</a></article></main><aside><p>Most read this week</p></aside></body>",
    "<body><header><h1>The Evening Post</h1></header><div class=cookie-banner>We use cookies for all of this</div><section class=story>␂<h2>Ferry</h2><p>The ferry runs every hour until ten, then no more.</p><ul><li>adults pay two</li><li>children pay one</li></ul>␃</section><div class=comments><p>too dear for me and mine</p></div><footer>Post of the evening</footer></body>",
    "<body><nav><ul>" + "<li><a href=/x>Item</a>" * 80 + "</ul></nav>" + "<div>" * 300 + "␂<p>Deep down there is a text that nobody has closed properly.␃",
    "<table><tr><td class=menu><a href=/1>One</a><br><a href=/2>Two</a></td><td>␂<p>Text in a table cell, as pages had it long ago, with words enough.</p><p>More of it.</p>␃</td></tr></table>",
    "<body><article>␂<h1>Graph</h1><p>The <label>axis</label> shows <math><mi>y</mi></math> by hour.</p><figure class=banner-image><figcaption>The curve of last year</figcaption></figure><ul class=tags-list><li>it rises first</li><li>then it falls</li></ul>␃</article><form><label>Mail</label><button>Subscribe</button></form></body>",
)
