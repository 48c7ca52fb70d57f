"""Pages written by hand, each with the text of its article; none of them comes from the generator of renderings."""

LONG = "The old canal was dug in seven years by four hundred people, and every lock was lined with local stone."
MORE = "Barges carried coal and grain until the railway came; after that only the miller kept his boat."
LAST = "Today the towpath is a footpath, and the locks open twice a year for visitors."
LINKS = "<ul><li><a href=/>Home</a></li><li><a href=/a>News</a></li><li><a href=/b>Sport</a></li><li><a href=/c>Contact</a></li></ul>"

#: What the model must tell right.
PAGES = [
    ("<body><p>Hello world.</p></body>", "Hello world."),
    (f"<p>{LONG}</p>", LONG),
    (f"<div><a href=/>Home</a> | <a href=/a>News</a> | <a href=/b>Sport</a></div><div>{LONG}</div><div>{MORE}</div><div><h3>Related</h3><ul><li><a href=/x>Old mills</a></li><li><a href=/y>Boats</a></li></ul></div>", f"{LONG}\n\n{MORE}"),
    (f"<body><nav>{LINKS}</nav><article><h1>The canal</h1><p>{LONG}</p><p>{MORE}</p></article><footer>&copy; 2020 Town</footer></body>", f"The canal\n\n{LONG}\n\n{MORE}"),
    (f"<body><div class=cookie>We use cookies. <button>Accept</button></div><article><h1>The canal</h1><p>{LONG}</p><p>{MORE}</p><p>{LAST}</p></article><aside><h3>Popular</h3>{LINKS}</aside></body>", f"The canal\n\n{LONG}\n\n{MORE}\n\n{LAST}"),
    (f"<body><article><h1>The canal</h1><p>{LONG}</p><div>Advertisement: buy new boots at half the price.</div><p>{MORE}</p><p>{LAST}</p></article></body>", f"The canal\n\n{LONG}\n\n{MORE}\n\n{LAST}"),
    (f"<body><article><h1>The canal</h1><p>{LONG}</p><p>{MORE}</p></article><section><h2>3 replies</h2><ul><li><b>Ann</b><p>I walked there last week.</p></li><li><b>Bob</b><p>So did I, it was lovely.</p></li><li><b>Cy</b><p>Thanks for this.</p></li></ul></section></body>", f"The canal\n\n{LONG}\n\n{MORE}"),
    (f"<body><main><h1>The canal</h1><p>{LONG}</p><h2>The mill</h2><p>{MORE}</p><ul><li>Open in May</li><li>Open in June</li></ul></main><footer><p>Imprint</p></footer></body>", f"The canal\n\n{LONG}\n\nThe mill\n\n{MORE}\n\nOpen in May\n\nOpen in June"),
    (f"<body><header>{LINKS}</header><div id=q><h1>The canal</h1><div>{LONG}</div><div>{MORE}</div><div>{LAST}</div></div><footer><a href=/i>Imprint</a></footer></body>", f"The canal\n\n{LONG}\n\n{MORE}\n\n{LAST}"),
    (f"<body><article><h1>Prices</h1><p>{LONG}</p><table><tr><th>Year</th><th>Toll</th></tr><tr><td>1820</td><td>two pence</td></tr></table><p>{MORE}</p></article></body>", f"Prices\n\n{LONG}\n\nYear Toll\n\n1820 two pence\n\n{MORE}"),
    (f"<body><div>{LINKS}</div><article><h1>The canal</h1><p>{LONG}</p><form><label>Your mail</label><input><p>Sign up for our letter.</p></form><p>{MORE}</p><p>{LAST}</p></article></body>", f"The canal\n\n{LONG}\n\n{MORE}\n\n{LAST}"),
    (f"<body><article><h1>Der Kanal</h1><p>Der alte Kanal wurde in sieben Jahren gegraben, und jede Schleuse ist aus Stein.</p><p>Heute ist der Treidelpfad ein Wanderweg.</p></article><footer>Impressum</footer></body>", "Der Kanal\n\nDer alte Kanal wurde in sieben Jahren gegraben, und jede Schleuse ist aus Stein.\n\nHeute ist der Treidelpfad ein Wanderweg."),
    (f"<body><article><h1>Quoted</h1><p>{LONG}</p><blockquote>{MORE}</blockquote><p>{LAST}</p></article></body>", f"Quoted\n\n{LONG}\n\n{MORE}\n\n{LAST}"),
    ("<body></body>", ""),
    ("", ""),
    (f"<body><nav>{LINKS}</nav><div><div><div><p>{LONG}</p><p>{MORE}</p><p>{LAST}</p></div></div></div><div><p>&copy; Town council</p></div></body>", f"{LONG}\n\n{MORE}\n\n{LAST}"),
    (f"<body><article><p>{LONG}</p><p>See <a href=/m>the mill</a> for more, and <a href=/l>the locks</a>.</p><p>{LAST}</p></article></body>", f"{LONG}\n\nSee the mill for more, and the locks.\n\n{LAST}"),
    (f"<body><article><h1>Links</h1><p><a href=/1>{LONG}</a></p><ul><li><a href=/2>A history of the locks</a></li><li><a href=/3>The boats of the miller</a></li></ul></article></body>", f"Links\n\n{LONG}\n\nA history of the locks\n\nThe boats of the miller"),
    (f"<body><article><h1>The canal</h1><p>{LONG}</p><p>{MORE}</p></article><div><h3>Comments</h3><div><div>Ann wrote:</div><p>I walked there last week.</p></div><div><div>Bob wrote:</div><p>So did I, it was lovely.</p></div></div></body>", f"The canal\n\n{LONG}\n\n{MORE}"),
    (f"<body><h1>The canal</h1><p>{LONG}</p><p>{MORE}</p><p>{LAST}</p></body>", f"The canal\n\n{LONG}\n\n{MORE}\n\n{LAST}"),
    (f"<body><header><h2>Town news</h2>{LINKS}</header><section><h1>The canal</h1><p>{LONG}</p><pre>lock 1: 3 m</pre><p>{MORE}</p></section><aside><p>Read us on paper.</p></aside></body>", f"The canal\n\n{LONG}\n\nlock 1: 3 m\n\n{MORE}"),
]

#: What it is known to tell wrong: a page of a few plain paragraphs without a heading or anything around comes out empty.
MISSED = [
    (f"<html><head><title>T</title><style>p{{}}</style></head><body><script>var x='<p>no</p>';</script><div><p>{LONG}</p><p>{MORE} &amp; more.</p></div></body></html>", f"{LONG}\n\n{MORE} & more."),
]
