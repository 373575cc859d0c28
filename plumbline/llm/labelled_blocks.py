"""A small labelled table: made-up pages in pieces of html, each piece with 1 if the blocks that it adds belong to the article, else 0.

The pages differ in what the tree must not lean on alone: some say by elements or
classes what is what, some are plain divisions or tables, some articles have
paragraphs of a word, some menus have sentences.
"""

WORDS = "river stone market evening letter garden window captain winter harbour silver meadow engine corner summer ladder bottle island candle forest travel number signal orchard".split()


def said(n: int, start: int = 0) -> str:
    """n words of prose from a list of words."""
    return " ".join(WORDS[(start + k * k + 3 * k) % len(WORDS)] for k in range(n)).capitalize() + "."


def links(n: int, words: int = 1, start: int = 0, around: str = "li") -> str:
    """n items that are links of some words."""
    return "".join(f"<{around}><a href='/{k}'>{said(words, start + 5 * k)}</a></{around}>" for k in range(n))


LABELLED: list[list[tuple[str, int]]] = [
    [  # elements that say what they are
        (f"<html><head><title>{said(6)}</title></head><body><nav><ul>{links(6)}</ul></nav><div class='ad'>{said(9)}</div>", 0),
        (f"<article><h1>{said(7)}</h1><p>{said(2)}<p>{said(55)}</p><p>{said(1)}</p><p>{said(1, 3)}</p><p>{said(120, 2)}</p><p>{said(31, 4)}</p></article>", 1),
        (f"<footer>&copy; {said(7)}</footer></body></html>", 0),
    ],
    [  # a short article among much else
        (f"<header><h2>{said(3)}</h2><p>{said(14)}</p></header><nav>{links(9, 2, around='div')}</nav><div class='cookie-banner'><p>{said(30)}</p><button>{said(1)}</button></div>", 0),
        (f"<main><h1>{said(4)}</h1><p>{said(8)}</p><p>{said(2, 9)}</p></main>", 1),
        (f"<aside><h3>{said(2)}</h3><p>{said(40, 5)}</p>{links(4, 6)}</aside><section id='comments'><h3>{said(2)}</h3><p>{said(35, 1)}</p><p>{said(60, 8)}</p></section><footer><p>{said(45, 3)}</p></footer>", 0),
    ],
    [  # a header of the article inside it, and its own foot
        (f"<div id='top-menu'>{links(5, around='span')}</div>", 0),
        (f"<article><header><h1>{said(8)}</h1><p>{said(12)}</p></header><p>{said(80)}</p><h2>{said(4)}</h2><p>{said(90, 6)}</p><ul><li>{said(9)}</li><li>{said(11, 4)}</li><li>{said(3, 2)}</li></ul><blockquote>{said(25)}</blockquote><p>{said(3)}</p>", 1),
        (f"<footer><p>{said(22)}</p></footer></article><div class='related-posts'><h3>{said(3)}</h3><ul>{links(5, 8)}</ul></div>", 0),
        (f"<form action='/n'><label>{said(3)}</label><p>{said(15)}</p><button>{said(1)}</button></form>", 0),
    ],
    [  # classes only
        (f"<div class='site-header'><div>{said(3)}</div><div>{said(7)}</div></div><div class='breadcrumbs'><a href='/'>{said(1)}</a> / <a href='/x'>{said(2)}</a></div>", 0),
        (f"<div class='post-content'><h2>{said(6)}</h2><div>{said(48)}</div><div>{said(5)}</div><div>{said(66, 3)} <a href='/l'>{said(4)}</a> {said(20)}</div><table><tr><td>{said(2)}</td><td>{said(1)}</td></tr><tr><td>{said(2, 2)}</td><td>{said(1, 7)}</td></tr></table></div>", 1),
        (f"<div class='sidebar'><div>{said(28)}</div><ul>{links(3, 3)}</ul></div><div class='newsletter-signup'><p>{said(18)}</p></div><div class='copyright'>{said(9)}</div>", 0),
    ],
    [  # plain divisions: length and links alone tell
        (f"<body><div>{links(4, 1, around='span')}</div><div><a href='/'>{said(2)}</a></div><div><a href='/a'>{said(1)}</a></div>", 0),
        (f"<h1>{said(6)}</h1><div>{said(70)}</div><div>{said(16)}</div><div>{said(45, 5)}</div><div>{said(13, 2)}</div><div>{said(95, 1)}</div><div>{said(19, 1)}</div>", 1),
        (f"<div><a href='/b'>{said(3)}</a></div><div><a href='/c'>{said(4)}</a> <a href='/d'>{said(2)}</a></div><div>{said(4)}</div>", 0),
    ],
    [  # plain divisions again, with a short paragraph between long ones
        (f"<body><table><tr><td><a href='/1'>{said(1)}</a></td><td><a href='/2'>{said(1)}</a></td><td><a href='/3'>{said(2)}</a></td></tr></table><div>{said(3)}</div>", 0),
        (f"<h2>{said(5)}</h2><p>{said(33)}</p><p>{said(4)}</p><p>{said(58, 2)}</p><p>{said(2)}</p><p>{said(41, 9)}</p><p>{said(77, 4)}</p>", 1),
        (f"<div><a href='/4'>{said(5)}</a></div><div><a href='/5'>{said(6)}</a></div><div>{said(6)}</div>", 0),
    ],
    [  # plain divisions, one long paragraph
        (f"<body><div>{said(2)}</div><div><a href='/1'>{said(1)}</a> <a href='/2'>{said(1)}</a></div>", 0),
        (f"<p>{said(150)}</p><p>{said(52, 7)}</p>", 1),
        (f"<div>{said(5)}</div><div><a href='/6'>{said(2)}</a></div>", 0),
    ],
    [  # comments that are articles, teasers that are articles
        (f"<nav><p>{said(25)}</p>{links(3, 2)}</nav>", 0),
        (f"<article class='story'><h1>{said(9)}</h1><p>{said(140)}</p><p>{said(6)}</p></article>", 1),
        (f"<div id='comments'><article class='comment'><header>{said(2)}</header><p>{said(65)}</p></article><article class='comment'><p>{said(4)}</p></article></div><aside><article><h3><a href='/t'>{said(7)}</a></h3><p>{said(24)}</p></article></aside>", 0),
        (f"<div class='notice' role='alert'><p>{said(50)}</p></div><div class='advert'><p>{said(75)}</p></div>", 0),
    ],
    [  # a page inside of a form, and what is hidden
        (f"<form><div role='navigation'>{links(4)}</div><div hidden><p>{said(60)}</p></div><div style='display: none'>{said(12)}</div>", 0),
        (f"<div id='content'><h1>{said(5)}</h1><p>{said(62)}</p><p>{said(1)}</p><ol><li>{said(14)}</li><li>{said(8, 6)}</li></ol></div>", 1),
        (f"<label>{said(2)}</label><select><option>{said(1)}</option><option>{said(1, 5)}</option></select><div class='social'>{said(3)}</div></form>", 0),
    ],
    [  # lists of links in the article's own frame
        (f"<header>{said(5)}</header><header><h1>{said(2)}</h1></header>", 0),
        (f"<main><article><h1>{said(10)}</h1><p>{said(38)} <a href='/z'>{said(5)}</a></p><p>{said(21)}</p>", 1),
        (f"<ul>{links(4, 7)}</ul><p><a href='/more'>{said(3)}</a></p>", 0),
        (f"<p>{said(44, 2)}</p><p>{said(3, 8)}</p></article>", 1),
        (f"</main><div class='share'>{links(3, 1, around='span')}</div><div class='footer'><p>{said(33)}</p><p>{said(70)}</p></div>", 0),
    ],
    [  # nothing but what surrounds an article
        (f"<header><h1>{said(3)}</h1></header><nav>{links(12, 2)}</nav><form><legend>{said(2)}</legend><p>{said(20)}</p></form><footer><ul>{links(6, 3)}</ul><p>{said(30)}</p></footer>", 0),
    ],
    [  # long paragraphs that surround, inside of the article's frame
        (f"<main><h1>{said(6)}</h1><p>{said(49)}</p>", 1),
        (f"<div class='ad'><p>{said(38)}</p></div>", 0),
        (f"<p>{said(24)}</p><p>{said(7, 5)}</p>", 1),
        (f"<div class='related'><p>{said(26)}</p><p>{said(85, 2)}</p></div><div class='cookie-notice'>{said(47)}</div>", 0),
        (f"<p>{said(68, 6)}</p>", 1),
        (f"<div class='newsletter'><h3>{said(4)}</h3><p>{said(19, 7)}</p></div><footer><p>{said(110)}</p></footer></main>", 0),
    ],
    [  # the same, and a letter to the reader
        (f"<div class='menu'>{links(5)}</div>", 0),
        (f"<article><h1>{said(3)}</h1><p>{said(26)}</p><p>{said(5)}</p><p>{said(23, 3)}</p>", 1),
        (f"<aside><p>{said(23, 9)}</p><p>{said(54)}</p></aside><div class='promo'>{said(28)}</div>", 0),
        (f"<p>{said(27, 8)}</p><figure><figcaption>{said(12)}</figcaption></figure><p>{said(22, 4)}</p></article>", 1),
        (f"<div class='comments'><p>{said(25, 1)}</p><p>{said(130)}</p><div>{said(9)}</div></div><dialog><p>{said(27)}</p></dialog>", 0),
    ],
    [  # the surroundings are named, the article is not
        (f"<header><div>{said(2)}</div><p>{said(8)}</p></header><nav>{links(6)}</nav><div class='banner'>{said(16)}</div>", 0),
        (f"<h1>{said(5)}</h1><p>{said(12)}</p><p>{said(63)}</p><p>{said(2)}</p><h2>{said(3)}</h2><p>{said(18, 2)}</p><p>{said(4, 5)}</p>", 1),
        (f"<div class='sidebar'><p>{said(37)}</p></div><footer><p>{said(12)}</p></footer>", 0),
    ],
    [  # the same with little text
        (f"<div class='masthead'><h1>{said(3)}</h1><div>{said(6)}</div></div><div class='navigation'><a href='/'>{said(1)}</a></div>", 0),
        (f"<div><h1>{said(4)}</h1><p>{said(15)}</p><p>{said(6)}</p><p>{said(9, 3)}</p></div>", 1),
        (f"<div class='footer'>{said(8)}</div>", 0),
    ],
    [  # the same, the surroundings longer than the article
        (f"<header><p>{said(19)}</p></header><div id='cookie-consent'><p>{said(58)}</p></div>", 0),
        (f"<h1>{said(7)}</h1><p>{said(29)}</p><p>{said(3)}</p><p>{said(11)}</p>", 1),
        (f"<section class='comments'><h2>{said(2)}</h2><p>{said(88)}</p><p>{said(14)}</p></section><aside><p>{said(61)}</p></aside>", 0),
    ],
    [  # text beside the named article
        (f"<div>{said(13)}</div><p>{said(20)}</p><div><a href='/i'>{said(2)}</a></div>", 0),
        (f"<article><h1>{said(5)}</h1><p>{said(36)}</p><p>{said(10)}</p></article>", 1),
        (f"<h3>{said(3)}</h3><p>{said(34, 6)}</p><div>{said(42)}</div><p>{said(6)}</p>", 0),
    ],
    [  # and again
        (f"<h2>{said(2)}</h2><p>{said(11)}</p>", 0),
        (f"<main><h1>{said(6)}</h1><p>{said(17)}</p><p>{said(43)}</p><p>{said(1)}</p></main>", 1),
        (f"<p>{said(52)}</p><div>{said(7)}</div>", 0),
    ],
    [(f"<html><head><title>{said(4)}</title></head><body><h1>{said(4)}</h1><p>{said(40)}</p><p>{said(3)}</p><p>{said(17)}</p></body></html>", 1)],  # nothing but the article
    [(f"<p>{said(9)}</p>", 1)],
    [(f"<body><p>{said(61)}</p><p>{said(8, 2)}</p>", 1)],
    [(f"<h2>{said(2)}</h2><div>{said(35)}</div><blockquote>{said(6)}</blockquote>", 1)],
    [(f"{said(45)}", 1)],
    [(f"<h1>{said(6)}</h1><p>{said(1)}</p>", 1)],
    [  # forms inside of the article's frame
        (f"<article><h1>{said(5)}</h1><p>{said(47)}</p>", 1),
        (f"<form><label>{said(1)}</label><label>{said(3)}</label><p>{said(26)}</p><div>{said(4)}</div><button>{said(1)}</button></form>", 0),
        (f"<p>{said(39, 3)}</p><p>{said(5)}</p></article>", 1),
    ],
    [
        (f"<div class='entry'><h2>{said(5)}</h2><p>{said(57, 4)}</p><p>{said(13)}</p>", 1),
        (f"<form><p>{said(9)}</p><p>{said(44)}</p><select><option>{said(1)}</option><option>{said(2)}</option></select><button>{said(2)}</button></form><button>{said(2)}</button>", 0),
        ("</div>", 0),
    ],
]
