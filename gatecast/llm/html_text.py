"""HTML extraction: flat text blocks, judged by a decision tree on their own and their neighbours' shape.

A page becomes a flat list of text blocks: text between block-level tags, inline tags dropped, character
references decoded, white space turned into single spaces. Scripts, styles, templates, drawings, players, choices,
comments and markup give no text; the words of math and the fallback of object do. Each block has the features ``FEATURES``:
word count and link density of itself, the block before and the block after, and where it stands: inside an article or
main element, inside an element that the standard keeps for what surrounds a text (nav, header, footer, aside, form, …), inside an
element whose class, id or role names a menu, advert, notice, comment list and the like, in a heading, in the page's head.

A name says nothing on an element that holds an article or main element, on html and body, behind "has", "with", "no" or
"without", and, on a page without article and main, on an element that holds most of the page's words (but for names of
comments). On an article or main element itself only names of adverts, related items and comments count.

A decision tree (Spark ML) is trained on the small labelled table of blocks that ``LABELLED_PAGES`` give.
It is plain data of at most 2 ** (depth + 1) nodes and travels inside the task closure; pages are judged
where they are read, one pass and no shuffle. A page is held alone in memory, however long, and read in time that grows
with its length: tags are found from left to right, and open elements by the places of their names.

Nulls and empty pages have an empty text. Broken markup never fails: a tag that does not close is text (behind the last
">" of a page all is), quotes mean nothing any more on a page after one that does not close,
an element that is not closed ends with its parent or the page (script, style, textarea and iframe, whose content is not
markup, with the page). Ties in the tree go to "content". Repeated
rows are extracted each; empty tables give empty results. Extra columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatecast.llm.common import per_text

DEPTH = 10
FEATURES = [
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
    "in_article", "in_surrounding", "in_named", "heading", "in_head",
]

# Fixed values of the HTML standard: elements that are read to their end tag without a look at what is inside, other elements without text, without content, and those that do not break a block.
RAW = set("script style textarea iframe".split())
SILENT = set("template noscript svg canvas audio video select".split())
FOREIGN = {"svg", "math"}  # these may close themselves, and block elements end them
VOID = set("area base br col embed hr img input link meta source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOILERPLATE = set("nav header footer aside form dialog menu button fieldset".split())
CONTENT = {"article", "main"}
# Names that mark boilerplate as a word of a class, id or role.
NAMES = set(
    """ad ads advert adverts advertisement advertising adsbygoogle banner sponsor sponsored sponsors promo promotion promoted
    nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar topbar
    header masthead footer foot colophon copyright legal
    sidebar side aside widget widgets related recommended recommendations trending popular
    cookie cookies consent gdpr notice notices alert notification newsletter subscribe subscription signup login popup modal overlay paywall
    comment comments commentlist respond reply replies disqus discussion reviews
    share sharing social search form skip complementary contentinfo""".split()
)

# Those that count on an article or main element too, and those of readers' comments.
STRICT_NAMES = set("ad ads advert adverts advertisement advertising sponsored promo related recommended recommendations trending popular teaser".split())
COMMENT_NAMES = set("comment comments commentlist respond reply replies disqus discussion".split())
UNSAID = set("has have with no without".split())  # in front of a name they say that it is elsewhere

TAG_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
UNQUOTED = re.compile(r"[^>\"']*")
MARKS = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPLIT_NAMES = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
SPACE = re.compile(r"\s+")


@dataclass
class Block:
    """A text block: its text, how many of its words are in links, and where it stands. ``named`` is set when the page has ended."""

    text: str
    words: int
    linked: int
    in_article: bool
    in_surrounding: bool
    heading: bool
    in_head: bool
    name: int
    in_named: bool = False


@dataclass
class Open:
    """An element that is not closed yet, and what holds inside it. ``name`` is the place in ``Parser.named`` of the nearest named element."""

    tag: str
    article: bool
    surrounding: bool
    heading: bool
    head: bool
    link: bool
    name: int = 0
    silent: bool = False


@dataclass
class Named:
    """An element whose name marks boilerplate: the nearest one around it, whether it holds an article, whether it is a comment's, its words."""

    above: int
    holds_article: bool = False
    comment: bool = False
    words: int = 0


def marked_names(value: str) -> set[str]:
    """The words of a class, id or role that mark boilerplate."""
    found = set()
    for name in value.split():
        parts = SPLIT_NAMES.split(name)
        found |= {part for k, part in enumerate(parts) if part in NAMES and not (k and parts[k - 1] in UNSAID)}
    return found


class Parser:
    """Turns a page into blocks. Every step looks at a fixed number of things, however many elements are open."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.stack = [Open("", False, False, False, False, False)]
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements of a name in the stack
        self.borders: list[int] = []  # places of the open elements that are not inline
        self.named = [Named(0)]
        self.any_article = False
        self.pieces: list[str] = []
        self.linked: list[str] = []

    def end_block(self) -> None:
        if self.pieces:
            text = SPACE.sub(" ", "".join(self.pieces)).strip()
            if text:
                here = self.stack[-1]
                linked = len(" ".join(self.linked).split())
                self.blocks.append(Block(text, text.count(" ") + 1, linked, here.article, here.surrounding, here.heading, here.head, here.name))
            self.pieces, self.linked = [], []

    def say(self, text: str) -> None:
        if self.stack[-1].silent:
            return
        text = html.unescape(text)  # here, as a character reference does not go across tags
        self.pieces.append(text)
        if self.stack[-1].link:
            self.linked.append(text)

    def name_of(self, tag: str, attributes: str) -> tuple[int, bool]:
        """The nearest named element around the content of a new element, and whether the element is hidden."""
        above, names, hidden = self.stack[-1].name, set(), False
        for key, *values in MARKS.findall(attributes):
            value, key = "".join(values).lower(), key.lower()
            if key in ("hidden", "aria-hidden"):
                hidden = hidden or key == "hidden" or value == "true"
            else:
                names |= marked_names(value)
        if tag in CONTENT:
            names &= STRICT_NAMES | COMMENT_NAMES
        if not names or tag in ("html", "body"):
            return above, hidden
        self.named.append(Named(above, comment=not names.isdisjoint(COMMENT_NAMES)))
        return len(self.named) - 1, hidden

    def start(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self.end_block()
        if tag in CLOSES_P:
            self.close_upto(FOREIGN, stop={"foreignobject", "annotation-xml"})
            self.close_upto({"p"}, stop={"article", "section", "div", "body", "td", "li", "blockquote", "main", "aside", "nav", "header", "footer", "form"})
        if tag in SAME_LEVEL:
            self.close_upto(SAME_LEVEL[tag], stop={"ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "menu", "select"})
        if tag == "body":
            self.close_upto({"head"}, stop=set())
        if tag == "br":
            self.pieces.append(" ")
        if tag in VOID or (tag in FOREIGN and attributes.endswith("/")):
            return
        above = self.stack[-1]
        name, hidden = self.name_of(tag, attributes) if attributes else (above.name, False)
        if tag in CONTENT and name == above.name:
            self.any_article = True
            around = above.name
            while around and not self.named[around].holds_article:  # those further out have been told before
                self.named[around].holds_article = True
                around = self.named[around].above
        silent = above.silent or tag in SILENT
        self.places[tag].append(len(self.stack))
        if tag not in INLINE and not silent:
            self.borders.append(len(self.stack))
        self.stack.append(
            Open(
                tag,
                above.article or tag in CONTENT,
                above.surrounding or tag in BOILERPLATE or (hidden and tag not in ("html", "body")),
                tag in ("h1", "h2", "h3", "h4", "h5", "h6") or (above.heading and tag in INLINE),
                above.head or tag in ("head", "title"),
                above.link or tag == "a",
                name,
                silent,
            )
        )

    def close(self, at: int) -> None:
        """Close the element at a place of the stack, with all inside it."""
        while len(self.stack) > at:
            self.places[self.stack.pop().tag].pop()
        while self.borders and self.borders[-1] >= at:
            self.borders.pop()

    def nearest(self, tags: set[str]) -> int:
        """Place of the innermost open element of ``tags``, 0 if none is open."""
        return max((self.places[tag][-1] for tag in tags if self.places.get(tag)), default=0)

    def close_upto(self, tags: set[str], stop: set[str]) -> None:
        """Close the nearest open element of ``tags`` unless one of ``stop`` is nearer."""
        at = self.nearest(tags)
        if at and at > self.nearest(stop):
            self.close(at)

    def end(self, tag: str) -> None:
        if tag not in INLINE:
            self.end_block()
        elif tag == "br":
            self.pieces.append(" ")
        at = self.nearest({tag})
        if at and not (tag in INLINE and self.borders and self.borders[-1] > at):
            self.close(at)

    def finish(self) -> list[Block]:
        """The blocks, each told whether it stands inside a named element that counts."""
        self.end_block()
        for block in self.blocks:
            self.named[block.name].words += block.words
        everything = sum(block.words for block in self.blocks if not block.in_head)
        for at in range(len(self.named) - 1, 0, -1):  # an element comes after those around it
            self.named[self.named[at].above].words += self.named[at].words
        counts = [False]
        for name in self.named[1:]:
            most = not self.any_article and not name.comment and 2 * name.words > everything
            counts.append(counts[name.above] or not (name.holds_article or most))
        for block in self.blocks:
            block.in_named = counts[block.name]
        return self.blocks


def tag_end(page: str, at: int, quotes: bool) -> tuple[int, bool]:
    """Place of the ">" that ends the tag whose name ends at ``at``, and whether quotes still mean something; one stands at or behind ``at``."""
    place = at
    while quotes:
        place = UNQUOTED.match(page, place).end()
        if place < len(page) and page[place] == ">":
            return place, True
        close = page.find(page[place], place + 1) if place < len(page) else -1
        if close < 0:
            quotes = False
        place = close + 1
    return page.find(">", at), False


def blocks_of(page: str) -> list[Block]:
    """The flat text blocks of a page."""
    parser, at, size = Parser(), 0, len(page)
    last, quotes = page.rfind(">"), True
    while at < size:
        less = page.find("<", at)
        if less < 0 or (less > last and not page.startswith(("<!--", "<![CDATA["), less)):
            comment = re.compile(r"<!--|<!\[CDATA\[").search(page, at) if less >= 0 else None
            parser.say(page[at : comment.start() if comment else size])
            break
        if less > at:
            parser.say(page[at:less])
        if page.startswith("<!--", less) or page.startswith("<![CDATA[", less):
            mark = "-->" if page[less + 2] == "-" else "]]>"
            found = page.find(mark, less + 4)
            at = found + 3 if found >= 0 else size
            continue
        if page.startswith(("<!", "<?"), less):
            at = page.index(">", less) + 1
            continue
        found = TAG_NAME.match(page, less)
        if not found:
            parser.say("<")
            at = less + 1
            continue
        name = found[1].lower()
        if found.end() > last:
            parser.say(page[less:])
            break
        close, quotes = tag_end(page, found.end(), quotes)
        at = close + 1
        if found[0][1] == "/":
            parser.end(name)
        elif name in RAW:
            parser.end_block()
            closing = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            close = page.find(">", closing.end()) if closing else -1
            at = close + 1 if close >= 0 else size
        else:
            parser.start(name, page[found.end() : close])
    return parser.finish()


def feature_rows(blocks: list[Block]) -> list[list[float]]:
    """The values of ``FEATURES`` for each block; beyond the page's ends there are no words."""
    shape = [(0.0, 0.0), *((float(b.words), b.linked / b.words) for b in blocks), (0.0, 0.0)]
    return [
        [*shape[k + 1], *shape[k], *shape[k + 2], float(b.in_article), float(b.in_surrounding), float(b.in_named), float(b.heading), float(b.in_head)]
        for k, b in enumerate(blocks)
    ]


# The small labelled table: pages whose content blocks begin with "+" (a mark that is taken off before training); all other
# blocks are boilerplate. They show an article with and without its element, short paragraphs, the usual surroundings, and lists of
# links and teasers that only the shape of their neighbours tells from short paragraphs.
LABELLED_PAGES = [
    """<html><head><title>River levels fall - Herald</title></head><body><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav>
    <div class="ad">Buy two lamps and get one free today</div><article><h1>+River levels fall</h1><p>+Levels fell for the third week, the board said on Monday.</p>
    <p>+Rain is due.</p><p>+More <a href=/d>figures</a> follow in the <b>annual</b> report that the board publishes in May.</p></article>
    <footer>&copy; Herald. All prices include tax.</footer></body></html>""",
    """<body class="page with-sidebar"><header><h1>City Library</h1><p>Open every day from nine to five, closed on holidays.</p></header>
    <div id=menu><a href=/a>Books</a> <a href=/b>Maps</a> <a href=/c>Visit</a></div>
    <main><h2>+How to borrow</h2><p>+Bring a card.</p><p>+A card is free for residents and takes two minutes to make at the desk.</p><ul><li>+Ten books</li><li>+Five films</li></ul></main>
    <aside class="sidebar"><h3>New this week</h3><p>A long list of novels that readers have asked for in the last month.</p></aside>
    <div class="cookie-notice">We use cookies to count visits. Please accept them.</div><footer><p>City Library, Main Street 4</p></footer></body>""",
    """<body><div class="nav"><a href=/1>Start</a></div><div class="content"><h1>+A walk in the hills</h1><p>+We set out before dawn with two dogs and a map from the year before.</p>
    <p>+Cold.</p><blockquote>+Never trust a map in the fog.</blockquote><p>+At noon the fog lifted and we saw the lake that we had been looking for since the day before.</p></div>
    <div id="comments"><h3>3 comments</h3><p>Lovely walk, we did it last year and met the same two dogs on the way down.</p><p>Nice</p></div>
    <form><label>Your name</label><p>Fill in all of the fields below to leave a comment on this page.</p></form></body>""",
    """<html><head><title>Soup</title><meta name=x></head><body><article class="post"><header><nav><a href=/x>Back to all recipes</a></nav></header><h1>+Soup</h1>
    <p>+Peel and cut.</p><div class="advert"><p>The best knives for every kitchen, now with a year of free sharpening.</p></div><p>+Boil for an hour and season with salt, pepper and a little vinegar.</p>
    <table><tr><td>+Water</td><td>+Two litres</td></tr></table><div class="comments"><p>I added leeks and it was much better than without them, thank you.</p></div></article>
    <div role="complementary"><p>Other readers also liked these eleven recipes for the winter.</p></div></body></html>""",
    """<body><p>+Plain pages have no element around their text and still are articles in their own right.</p><p>+Short one.</p><hr><p>+The end of the text comes without any warning.</p>
    <div class=footer>Imprint and terms of use</div></body>""",
    """<body><ul><li><a href=/1>First of many links</a></li><li><a href=/2>Second of many links</a></li><li><a href=/3>Third of the links</a></li></ul>
    <section><h2>+Trains</h2><p>+The line opened in two parts and was closed again before the second was paid for.</p><p>+It is a path now.</p></section>
    <ul><li><a href=/4>Older posts</a></li><li><a href=/5>Newer posts</a></li></ul></body>""",
    """<html><head><title>Storm closes two harbours and leaves four hundred people without a way home, says the harbour master - The Daily News</title></head>
    <body><div><a href=/1>Storm closes two harbours</a></div><div>By our reporter</div><div><a href=/2>Council votes on trams</a></div><div>Two hours ago</div>
    <div><a href=/3>Museum opens its attic</a></div><div>From the archive</div><div><a href=/4>Prices for bread rise</a></div>
    <div>+The harbour master closed both harbours on Sunday after the wind had turned and two ferries had lost their moorings.</div><div>+Nobody was hurt.</div>
    <div>+The ferries were brought in by a tug from the next town, which took four hours because of the swell.</div><div>+They sail again today.</div>
    <div>+Repairs to the pier will take until spring, and the council has asked for help with the costs that it expects.</div>
    <div><a href=/5>All news of the day</a></div><div>Updated every hour</div><div><a href=/6>Letters to the paper</a></div></body>""",
    """<body><div class="no-sidebar"><main id="main-content"><p>+Ask twice.</p><p>+Listen.</p><p><a href=/1>+The long answer of the board</a></p><p>+Read it.</p><ul><li><a href=/2>+Figures of the first year</a></li>
    <li><a href=/3>+Figures of the second year</a></li></ul><p>+That is all.</p></main></div><div><a href=/4>Home</a></div><div>Back to top</div><div><a href=/5>Imprint of the board</a></div></body>""",
    """<html><head><title>Three days along the river and through the woods: a walk with maps, times and places to stay</title></head><body><p><a href=/a>Walks</a></p><p>Maps and times</p><p><a href=/b>Boats</a></p><p>Tickets here</p><p><a href=/c>Bikes</a></p>
    <p>+On the third day the path left the river and went up through a wood of beech and oak to a chapel that nobody had told us of.</p><p>+It was locked.</p>
    <p>+A woman with a basket of eggs told us where to find the key, and asked us to bring it back before the evening bell.</p><p>+We did.</p>
    <p>+Inside were a bench, a lamp and a painting of the same river with the same wood, but with a bridge that is no longer there.</p>
    <p><a href=/d>Next walk</a></p><p>Four hours long</p><p><a href=/e>Former walk</a></p></body>""",
    """<html><head><title>Glass, and the many years that it takes until someone can make it well: a letter from the workshop</title></head>
    <body class="layout has-sidebar"><div class="wrapper with-sidebar no-ads"><article class="post share-enabled"><h1>+Glass</h1><p>+Sand, soda and lime melt at some fifteen hundred degrees.</p>
    <p>+The rest is patience.</p><p>+We asked.</p><p>+They told.</p><p><a href=/s>+All of it in one letter</a></p><p>+Not more.</p></article><div class="related"><p>Sand is a story of its own that we told in the last of these letters to you.</p></div></div></body>""",
]


LENGTHS = (1, 2, 4, 7, 12, 20, 40, 90, 200)


def labelled_blocks(pages: list[str]) -> list[tuple[list[float], float]]:
    """(features, 1 for content) of the blocks of marked pages.

    Where the place of a block tells what it is (in a surrounding or named element or the head, or in an article and none of
    these), its length does not: such a block stands in the table with several lengths of its own and its neighbours.
    """
    rows = []
    for page in pages:
        blocks = blocks_of(page)
        for values, block in zip(feature_rows(blocks), blocks):
            label = float(block.text.startswith("+"))
            rows.append((values, label))
            outside = block.in_surrounding or block.in_named or block.in_head
            if outside or block.in_article:
                for k, length in enumerate(LENGTHS):
                    other = float(LENGTHS[(5 * k + 2) % len(LENGTHS)])
                    rows.append(([float(length), values[1], other, values[3], float(LENGTHS[k - 1]), *values[5:]], label))
    return rows


def train(spark: SparkSession, pages: list[str] = LABELLED_PAGES) -> list[tuple]:
    """The tree as nodes (feature, threshold, left, right) and leaves (-1, share of content, 0, 0); a bounded piece of plain data."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import array_to_vector

    rows = labelled_blocks(pages)
    if len({y for _, y in rows}) < 2:
        return [(-1, rows[0][1] if rows else 1.0, 0, 0)]
    table = spark.createDataFrame([(x, y) for x, y in rows], "x array<double>, y double").coalesce(1)
    tree = DecisionTreeClassifier(featuresCol="features", labelCol="y", maxDepth=DEPTH, maxBins=1024, seed=1)
    model = tree.fit(table.select(array_to_vector("x").alias("features"), "y"))
    nodes: list[tuple] = []

    def walk(node) -> int:
        at = len(nodes)
        nodes.append(())
        if node.numDescendants() == 0:
            counts = list(node.impurityStats().stats())
            nodes[at] = (-1, counts[1] / sum(counts), 0, 0)
        else:
            split = node.split()
            left, right = walk(node.leftChild()), walk(node.rightChild())
            nodes[at] = (split.featureIndex(), split.threshold(), left, right)
        return at

    walk(model._java_obj.rootNode())
    return nodes


def is_content(values: list[float], nodes: list[tuple]) -> bool:
    at = 0
    while nodes[at][0] >= 0:
        feature, threshold, left, right = nodes[at]
        at = left if values[feature] <= threshold else right
    return nodes[at][1] >= 0.5


def main_text(page: str, nodes: list[tuple]) -> str:
    """The content blocks of a page, one per line."""
    blocks = blocks_of(page)
    return "\n".join(b.text for b, values in zip(blocks, feature_rows(blocks)) if is_content(values, nodes))


def extracted(page: Column, nodes: list[tuple]) -> Column:
    """Struct (text, n_chars) of each page."""

    def one(whole: str) -> tuple[str, int]:
        text = main_text(whole, nodes)
        return text, len(text)

    return per_text(one, "text string, n_chars long")(page)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    nodes = train(pages.sparkSession)
    return pages.select("page_id", "url", extracted(F.col("html"), nodes).alias("r")).select("page_id", "url", "r.*")
