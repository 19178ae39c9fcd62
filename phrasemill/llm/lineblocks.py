"""Main text of web pages by the distribution of text over lines.

Markup is stripped; every block of the page is a line, and an element that
holds no main text (menus, adverts, forms and the like) leaves a wall of empty
lines. Text lengths are summed over a sliding window of lines. Where the sum
rises from nothing is a surge, where it falls back is a dive, and the lines
between the two are one stretch of text. Kept are the lines of the page's
article, or, where no element says which part that is, the stretches that hold
a sentence or a heading, all between the first and the last of them, and
paragraphs before and after those.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.common import by_batch, unused, whole

#: Lines in a window.
WINDOW = 3

# Element names of HTML and the words that name parts of a page.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre
search section select summary table tbody td tfoot th thead title tr ul""".split())
SPACES = frozenset(["br", "wbr"])
RAW = "script|style|noscript|template|textarea|title|iframe|xmp|noembed|noframes"
MEDIA = frozenset(["object", "svg", "math", "canvas", "audio", "video"])
APART = frozenset("nav header footer aside form menu dialog search select button fieldset head".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
ARTICLE = frozenset(["article", "main"])
PARTS = frozenset("""ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion
sidebar aside menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments disqus replies
cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup
login related recommended share sharing social toolbar widget pagination search contentinfo complementary dialog
form""".split())
AROUND = frozenset("""area article background bar block body bottom box button buttons card center col column container content
desktop element embed feed frame global group head heading holder inline inner item items js large layer left link links list
main message mobile outer page panel placement post posts primary prompt reader right row secondary section site slot small
sticky thread top unit user view wrap wrapper zone""".split())
PARAGRAPHS = frozenset(["p", "blockquote", "pre"])

_RAW = re.compile(rf"(?is)<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)|<[!?][^>]*+>")
# A quoted value may hold ">"; one that holds "<" is taken for a quote that nobody closed.
_TAG = re.compile(r"""<(/?)([a-zA-Z][\w:-]*+)((?:[^>"']++|"[^"<]*+"|'[^'<]*+'|["'])*+)>""")
_ATTRIBUTE = re.compile(r"""(?s)([^\s=>"'/]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?""")
_HINT = re.compile(r"(?i)hidden|none")
_NONE = re.compile(r"(?i)(?:^|;)\s*display\s*:\s*none")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: The end of a sentence.
_PROSE = re.compile(r"""[.!?…]["'”’»)\]]*(?:\s|\Z)|[。！？؟।]""")


def _names_part(label: str) -> bool:
    """Whether a label such as ``comment-list`` names a part without main text, and nothing else beside where it stands."""
    words = [w.lower() for w in _WORD.findall(label)]
    return any(w in PARTS for w in words) and all(w in PARTS or w in AROUND for w in words)


def _apart(name: str, attributes: str) -> bool:
    """Whether an element's name or labels say that it holds no main text. Headings are never told by labels."""
    if name in APART or name in MEDIA:
        return True
    if name in ("html", "body") or not attributes:
        return False
    values = {a.lower(): v.strip("\"'") for a, v in _ATTRIBUTE.findall(attributes)}
    if _HINT.search(attributes) and ("hidden" in values or values.get("aria-hidden", "").lower() == "true" or _NONE.search(values.get("style", ""))):
        return True
    return name not in HEADINGS and any(_names_part(label) for a in ("class", "id", "role") for label in values.get(a, "").split())


def _closers(tags: list[re.Match], size: int) -> dict[int, tuple[int, int, int]]:
    """For each opening tag: the tag where its element ends, and the place and the tag to go on from.

    Elements end at the tag that closes them, by the nesting of their own name;
    a paragraph that nothing closes ends where a block begins or ends, or with the page.
    """
    stacks: dict[str, list[int]] = {}
    found = {}
    paragraph: int | None = None
    for i, tag in enumerate(tags):
        name = tag[2].lower()
        if name in BLOCKS and paragraph is not None and not (tag[1] and name == "p"):
            found[paragraph] = (i, tag.start(), i)
            paragraph = None
        if name == "p":
            if not tag[1]:
                paragraph = i
            elif paragraph is not None:
                found[paragraph] = (i, tag.end(), i + 1)
                paragraph = None
        elif not tag[1]:
            if not (name in MEDIA and tag[3].endswith("/")):
                stacks.setdefault(name, []).append(i)
        elif open_ := stacks.get(name):
            found[open_.pop()] = (i, tag.end(), i + 1)
    if paragraph is not None:
        found[paragraph] = (len(tags), size, len(tags))
    return found


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, weight, in an article) of every line; walls are empty lines.

    The weight is the length of the text, 0 where links make up most of it.
    """
    return [line[:3] for line in _lines(page)]


def _lines(page: str) -> list[tuple[str, int, bool, bool, bool]]:
    """As ``lines_of``, and whether the line is a heading, and whether it is a paragraph or a heading."""
    page = _RAW.sub(lambda m: "" if m[0].startswith("<!--") else "<hr>", page)
    tags = list(_TAG.finditer(page))
    closers = _closers(tags, len(page))
    articles = [i for i, t in enumerate(tags) if not t[1] and t[2].lower() in ARTICLE]
    lines: list[tuple[str, int, bool, bool, bool]] = []
    text: list[str] = []
    block = ""
    linked = depth = links = headings = 0

    def flush() -> None:
        nonlocal linked
        line = " ".join(html.unescape("".join(text)).split())
        if line:
            lines.append((line, 0 if linked > len(line) / 2 else len(line), depth > 0, headings > 0, headings > 0 or block in PARAGRAPHS))
        text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            text.append(piece)
            linked += len(piece) if links else 0

    wall, at, i = [("", 0, False, False, False)] * WINDOW, 0, 0
    while i < len(tags):
        tag = tags[i]
        add(page[at:tag.start()])
        at, name = tag.end(), tag[2].lower()
        if name in BLOCKS or name in APART:
            flush()
            block = "" if tag[1] else name
        elif name in SPACES:
            text.append(" ")
        if tag[1]:
            depth -= name in ARTICLE and depth > 0
            links -= name == "a" and links > 0
            headings -= name in HEADINGS and headings > 0
        else:
            end = closers.get(i)
            if name not in ARTICLE and end is not None and _apart(name, tag[3]) and not any(i < a < end[0] for a in articles):
                if name in MEDIA:  # stands in a line, or between two
                    at, i = end[1:]
                    continue
                flush()
                if name == "header" and depth:  # an article's own heading is part of it
                    for j in range(i + 1, end[0]):
                        if not tags[j][1] and tags[j][2].lower() in HEADINGS and (stop := closers.get(j)):
                            line = " ".join(html.unescape(_TAG.sub("", page[tags[j].end():tags[stop[0]].start()])).split())
                            lines.extend([(line, len(line), True, True, True)] if line else [])
                else:
                    lines.extend(wall)
                at, i = end[1:]
                block = ""
                continue
            depth += name in ARTICLE and end is not None
            links += name == "a" and end is not None
            headings += name in HEADINGS and end is not None
        i += 1
    add(page[at:])
    flush()
    return lines


def main_text(page: str) -> list[str]:
    """The kept blocks of a page, in order."""
    lines = _lines(page)
    # Articles of links only do not tell where the main text is, unless the page has no other text.
    if any(line[2] and line[1] for line in lines) or not any(line[1] for line in lines):
        return [line[0] for line in lines if line[2] and line[0]]
    weights = [line[1] for line in lines]
    sums, total = [], sum(weights[:WINDOW])
    for i in range(len(weights)):
        sums.append(total)  # of the lines from i on
        total += (weights[i + WINDOW] if i + WINDOW < len(weights) else 0) - weights[i]
    stretches, i = [], 0
    while i < len(sums):
        if not sums[i]:
            i += 1
            continue
        surge = i
        while i < len(sums) and sums[i]:
            i += 1  # the dive: no text in this window
        stretches.append(range(surge, i))
    told = [n for n, stretch in enumerate(stretches) if any(
        lines[i][1] and (lines[i][3] or _PROSE.search(lines[i][0])) for i in stretch)]
    kept = set()
    for n, stretch in enumerate(stretches):
        # Before the first and after the last that tell, paragraphs are an opening or closing line; with none, nothing tells.
        outer = told and not told[0] <= n <= told[-1]
        kept.update(i for i in stretch if not outer or (lines[i][4] and lines[i][1]))
    return [line[0] for i, line in enumerate(lines) if line[0] and (line[2] or i in kept)]


def extract_pages(df: DataFrame, html_column: str = "html", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """``df`` with the main text of each page, blocks joined by an empty line, and its length, in place of the page.

    A null or empty page, and one without main text, gives an empty text. Rows
    are independent, so repeated rows and ties need no rule; columns with the
    names of the new ones are replaced; an empty table gives an empty table.
    """
    held = unused(df, "page")
    kept = [c for c in df.columns if c not in (html_column, text, chars)]
    source = df.withColumn(held, whole(html_column)).select(*kept, held)
    schema = source.drop(held).withColumns({text: F.lit(""), chars: F.lit(0).cast("long")}).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = ["\n\n".join(main_text(p)) for p in batch.column(held).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], [*kept, text, chars])

        return by_batch(batches, work, 256)

    return source.mapInArrow(run, schema)
