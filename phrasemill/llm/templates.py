"""Benchmark decontamination by templates.

Texts become sequences of words in lower case in which numbers, units after
numbers and names are typed placeholders. Windows of a few such tokens are
hashed, and the windows of documents are joined with those of the benchmark.
Hits on one line of alignment are then held against each other: a value of the
benchmark item must stand for the same value of the document in every window,
and the other way round, or the window does not count. So a question asked
again with other numbers or names is found, and text that happens to have the
same shape is not.

As a capital does not always make a name, a window with possible names is
looked up with and without them; capitals that open a text or a sentence, the
least certain names, count as words in a form of their own and as names in
another. A window that is mostly numbers and units says too little by its
shape; it is looked up by its values, so that a copy is found.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.common import by_batch, parts_for, whole
from phrasemill.session import written

#: Tokens of a window; items that are shorter are one window, if they have at least ``LEAST`` tokens.
WINDOW = 8
LEAST = 4
#: Literal words that a window needs, half of it at least; else its shape says too little and its values count.
LITERAL = 0.5
#: A document holds an item if this many of the item's tokens are found, or this share of them.
COVERED = 13
SHARE = 0.8
#: Windows of the benchmark that may be broadcast; counted before.
BROADCAST_WINDOWS = 500_000

# Unit words, which count as units after a number only.
UNITS = frozenset("""percent km m cm mm kilometer kilometers kilometre kilometres meter meters metre metres centimeter
centimeters mile miles yard yards foot feet ft inch inches kg g mg kilogram kilograms gram grams ton tons tonne tonnes
pound pounds lb lbs oz ounce ounces l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h
hr hour hours day days week weeks month months year years mph kmh degree degrees dollar dollars cent cents euro euros usd
eur byte bytes kb mb gb watt watts volt volts""".split())

_WORD, _TITLE, _NUMBER, _UNIT, _SIGN, _BREAK = range(6)
_KIND = 7  # mask of the low bits
_HELD = {_NUMBER: 0x5DEECE66D1234567, _UNIT: 0x2545F4914F6CDD1D, _TITLE: 0x369DEA0F31A53F85}
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))

# What a character is. Latin letters end before other letters begin; those run on over all letters.
_OTHER, _LATIN, _LETTER, _DIGIT, _POINT, _BETWEEN, _STOP, _MARK = range(8)
_CHARACTERS = [(_LATIN, "[A-Za-zÀ-ÖØ-öø-ʯ]"), (_LETTER, r"[^\W\d_]"), (_DIGIT, r"\d"), (_POINT, "[.]"), (_BETWEEN, "[,:/]"),
               (_STOP, "[!?\n]"), (_MARK, "[%$€£°]")]


class Characters:
    """Tables over code points: what a character is, its small letter, and whether it is a capital or a small letter."""

    def __init__(self):
        self.kind = np.full(0x110000, 255, dtype=np.uint8)
        self.small = np.arange(0x110000, dtype=np.uint32)
        self.case = np.zeros(0x110000, dtype=np.uint8)  # 1: capital, 2: small, 4: of another case, 8: a digit, raised ones too
        self.learn(range(0x300))

    def learn(self, points: Iterable[int]) -> None:
        for point in points:
            c = chr(point)
            self.kind[point] = next((k for k, pattern in _CHARACTERS if re.match(pattern, c)), _OTHER)
            self.small[point] = ord(small) if len(small := c.lower()) == 1 else point
            self.case[point] = 1 if c.isupper() else 2 if c.islower() else 4 if c.istitle() else 8 if c.isdigit() else 0

    def kinds(self, points: np.ndarray) -> np.ndarray:
        found = self.kind[points]
        if (found == 255).any():
            self.learn(np.unique(points[found == 255]).tolist())
            found = self.kind[points]
        return found


@functools.lru_cache(maxsize=1)
def _characters() -> Characters:
    return Characters()


def _powers(base: np.uint64, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base)]))


#: Running sums begin anew after so many characters.
_BITS = 16
_UP, _DOWN = _powers(_BASE, 1 << _BITS), _powers(_BACK, 1 << _BITS)


def _token_hashes(small: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each token, by its small letters: differences of running sums, so that few tokens are looked at alone."""
    with np.errstate(over="ignore"):
        values = small.astype(np.uint64) + np.uint64(1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(values * np.resize(_UP, len(values)))])
        out = (sums[ends] - sums[starts]) * _DOWN[starts & (1 << _BITS) - 1]
        for k in np.flatnonzero(starts >> _BITS != (ends - 1) >> _BITS).tolist():
            own = values[starts[k]:ends[k]]
            out[k] = (own * _powers(_BASE, len(own))).sum()
        out = (out ^ (out >> np.uint64(31))) * _BASE
        return (out ^ (out >> np.uint64(29))) * _BASE


@functools.lru_cache(maxsize=1)
def _unit_hashes() -> np.ndarray:
    words = sorted(UNITS)
    ends = np.cumsum([len(w) for w in words])
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return np.sort(_token_hashes(points, ends - [len(w) for w in words], ends))


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, kind, and places from and to of the tokens of all texts end to end, and the first token of each text and the end.

    Tokens are runs of letters, numbers (digits, with single marks between
    them), signs beside which a number may stand, and ends of sentences. Places
    count from the start of a text.
    """
    table = _characters()
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = table.kinds(points)
    letter, digit = (kinds == _LATIN) | (kinds == _LETTER), kinds == _DIGIT
    inner = np.zeros(len(kinds), dtype=bool)
    inner[1:-1] = ((kinds[1:-1] == _POINT) | (kinds[1:-1] == _BETWEEN)) & digit[:-2] & digit[2:]
    number, stop, sign = digit | inner, ((kinds == _POINT) & ~inner) | (kinds == _STOP), kinds == _MARK
    before = lambda flags: np.concatenate([[False], flags[:-1]])
    start = (letter & ~before(letter)) | (number & ~before(number)) | stop | sign
    others = np.flatnonzero((kinds == _LETTER) & before(kinds == _LATIN))
    if len(others):  # the first other letter of a run begins a token of its own
        runs = np.flatnonzero(letter & ~before(letter))
        seen = np.cumsum(kinds == _LETTER)
        run = runs[np.searchsorted(runs, others, side="right") - 1]
        start[others[seen[others] - seen[run] + (kinds[run] == _LETTER) == 1]] = True
    inside = letter | number | stop | sign
    borders = np.flatnonzero(start | (~inside & before(inside)))
    opens = start[borders]
    starts = borders[opens]
    ends = np.append(borders[1:], len(points))[opens]
    small = table.small[points]
    hashes = _token_hashes(small, starts, ends)
    case = table.case[points[starts]]
    kind = np.full(len(starts), _WORD, dtype=np.int64)
    lower, upper = (np.concatenate([[0], np.cumsum(c, dtype=np.int32)]) for c in (
        (table.case[points] == 2), (table.case[points] & 5) > 0))
    kind[(case == 1) & (lower[ends] > lower[np.minimum(starts + 1, ends)]) & (upper[ends] == upper[np.minimum(starts + 1, ends)])] = _TITLE
    units = _unit_hashes()
    kind[units[np.minimum(np.searchsorted(units, hashes), len(units) - 1)] == hashes] = _UNIT
    kind[case == 8], kind[stop[starts]], kind[sign[starts]] = _NUMBER, _BREAK, _SIGN
    bounds = np.cumsum(sizes) - sizes
    first = np.searchsorted(starts, np.append(bounds, len(points)))
    base = np.repeat(bounds, np.diff(first))
    return (hashes & np.uint64(2**62 - 8)).astype(np.int64), kind, starts - base, ends - base, first


def _parsed(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Callable[[int], str], np.ndarray, np.ndarray]]:
    """As ``canonical`` for every text; also which words are capitals that open a sentence, so may be names as well, and hashes of all values."""
    all_codes, all_kinds, starts, ends, first = _tokens(texts)
    for text, a, b in zip(texts, first[:-1].tolist(), first[1:].tolist(), strict=True):
        codes, kinds = all_codes[a:b], all_kinds[a:b]
        breaks = kinds == _BREAK
        keep = np.flatnonzero(~breaks)
        opens = np.concatenate([[True], breaks[:-1]])[keep] if a < b else np.zeros(0, bool)
        codes, kinds = codes[keep], kinds[keep]
        # A sign is a unit beside a number, and else nothing.
        numbers = np.concatenate([[False], kinds == _NUMBER, [False]])
        beside = numbers[:-2] | numbers[2:]
        stay = (kinds != _SIGN) | beside
        kinds = np.where((kinds == _SIGN) | ((kinds == _UNIT) & numbers[:-2]), _UNIT, np.where(kinds == _UNIT, _WORD, kinds))
        opening = ((kinds == _TITLE) & opens)[stay]
        kinds = np.where((kinds == _TITLE) & opens, _WORD, kinds)[stay]
        codes, keep = codes[stay], keep[stay] + a
        literal = codes.astype(np.uint64)
        plain = literal.copy()
        for kind in (_NUMBER, _UNIT):
            plain[kinds == kind] = _HELD[kind]
        named = np.where(kinds == _TITLE, np.uint64(_HELD[_TITLE]), plain)
        yield plain, named, kinds, (lambda i, t=text, at=keep: t[starts[at[i]]:ends[at[i]]]), opening, literal


def canonical(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(hashes without names, hashes with names, kinds, tokens) of a text; kinds other than words are placeholders."""
    plain, named, kinds, token, *_ = next(_parsed([text]))
    return plain, named, kinds, [token(i) for i in range(len(kinds))]


def _rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every window of ``width`` tokens."""
    n = len(hashes) - width + 1
    with np.errstate(over="ignore"):
        out = np.full(n, width, dtype=np.uint64)
        for j in range(width):
            out = out * _BASE + hashes[j:j + n]
        return (out ^ (out >> np.uint64(29))) * _BASE


def _within(flags: np.ndarray, width: int) -> np.ndarray:
    """How many flags are set in every window of ``width`` tokens."""
    total = np.zeros(len(flags) + 1, dtype=np.int32)
    np.cumsum(flags, out=total[1:])
    return total[width:] - total[:-width]


def windows_of(text: str, widths: list[int], wanted: np.ndarray | None = None,
               ) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[str | None]]]:
    """(width, places, keys, slots) for every width and form; slots tell the placeholders' values, null without any.

    Only windows with a key in ``wanted``, keys in order, if it is given.
    """
    return _windows(next(_parsed([text])), widths, wanted)


def _windows(parsed: tuple, widths: list[int], wanted: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[str | None]]]:
    plain, named, kinds, token, opening, literal = parsed
    titles = kinds == _TITLE
    values = (kinds == _NUMBER) | (kinds == _UNIT)
    none = np.zeros(len(plain), dtype=bool)
    forms = [(plain, values, None)]
    if titles.any():
        forms.append((named, values | titles, titles))
    if opening.any():
        forms.append((np.where(opening, np.uint64(_HELD[_TITLE]), named), values | titles | opening, opening))
        kinds = np.where(opening, _TITLE, kinds)
    for width in widths:
        if len(plain) < width:
            continue
        most = width * (1 - LITERAL)
        # One less than the most, as a unit at an item's start is a word there and may follow a number in a document.
        crowded = _within(values, width) + 1 > most
        for hashes, held, needed in [*forms, (literal, none, None)] if crowded.any() else forms:
            count = _within(held, width)
            fine = crowded if hashes is literal else count <= most
            places = np.flatnonzero(fine if needed is None else fine & (_within(needed, width) > 0))
            keys = _rolled(hashes, width)[places].view(np.int64)
            if wanted is not None:
                at = np.searchsorted(wanted, keys)
                known = np.append(wanted, 0)[at] == keys
                known &= at < len(wanted)
                places, keys = places[known], keys[known]
            slots: list[str | None] = [None] * len(places)
            for i in np.flatnonzero(count[places]).tolist():
                at = int(places[i])
                slots[i] = "\x1f".join(f"{kinds[j]}{token(j).lower()}" for j in range(at, at + width) if held[j])
            yield width, places, keys, slots


def template_windows(df: DataFrame, key: str, text: str, widths: list[int], wanted: np.ndarray | None = None) -> DataFrame:
    """(key, place, width, window, slots) of all windows, or all ``wanted`` ones, of all rows with a key."""
    shipped = None if wanted is None else df.sparkSession.sparkContext.broadcast(wanted)
    source = df.select(F.col(key).alias(key), whole(text).alias("text")).filter(F.col(key).isNotNull())
    names = [key, "place", "width", "window", "slots"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, columns = [], [[], [], [], []]
        for i, parsed in enumerate(_parsed(batch.column(1).to_pylist())):
            for width, places, keys, slots in _windows(parsed, widths, shipped and shipped.value):
                rows.append(np.full(len(places), i, np.int64))
                for column, x in zip(columns, (places, np.full(len(places), width, np.int32), keys, slots), strict=True):
                    column.append(x)
        flat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return pa.RecordBatch.from_arrays([
            batch.column(0).take(pa.array(flat(rows, np.int64))), pa.array(flat(columns[0], np.int64), pa.int32()), pa.array(flat(columns[1], np.int32)),
            pa.array(flat(columns[2], np.int64)), pa.array(list(itertools.chain.from_iterable(columns[3])), pa.string())], names)

    return source.mapInArrow(lambda batches: by_batch(batches, work, 128),
                             f"`{key}` {source.schema[0].dataType.simpleString()}, place int, width int, window long, slots string")


def _agree(pairs: dict[str, str], back: dict[str, str], mine: str | None, theirs: str | None) -> bool:
    """Whether a window's values fit those seen before on its line; if so they are remembered."""
    if mine is None or theirs is None:
        return mine is None and theirs is None
    a, b = mine.split("\x1f"), theirs.split("\x1f")
    if len(a) != len(b):
        return False
    new: dict[str, str] = {}
    for x, y in zip(a, b, strict=True):
        if x[0] != y[0] or pairs.get(x, new.get(x, y)) != y:
            return False
        new[x] = y
    turned = {y: x for x, y in new.items()}
    if len(turned) < len(new) or any(back.get(y, x) != x for y, x in turned.items()):
        return False
    pairs.update(new)
    back.update(turned)
    return True


def contaminated(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                 item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, item, n_windows, covered_tokens, item_tokens, share, reworded) of documents that hold a benchmark item.

    ``reworded`` tells that a number, unit or name differs. Rows without a key
    are not judged, as no result could name them; rows that repeat a key count
    as one document, items that repeat an id as one item. Null and empty texts
    hold nothing and are held by nothing, and so are items of fewer than
    ``LEAST`` tokens. Empty tables give an empty result; further columns are not read.
    """
    spark = df.sparkSession
    spans = benchmark.select(F.col(item).cast("long").alias("item"), whole(item_text).alias("text")).filter("item is not null")

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(canonical(t)[0]) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(sizes, pa.int32())], ["item", "size"])

    sizes = written(spans.mapInArrow(measure, "item long, size int").filter(F.col("size") >= LEAST)
                    .groupBy("item").agg(F.max("size").alias("size")), "items")
    # Widths: the full one, and those of shorter items; a handful at most.
    widths = sorted(r["w"] for r in sizes.select(F.least("size", F.lit(window)).alias("w")).distinct().collect())
    if not widths:
        return df.select(F.col(key).alias(key), F.lit(0).cast("long").alias(item), *_facts()).limit(0)
    wanted = template_windows(spans, "item", "text", widths).join(sizes, "item").filter(
        F.col("width") == F.least("size", F.lit(window)))
    # One row for each window, so that a shape that many items share multiplies nothing.
    wanted = written(wanted.groupBy("window").agg(F.collect_set(F.struct(
        "item", F.col("place").alias("at"), F.col("slots").alias("theirs"), "size")).alias("items")), "item-windows")
    known = None
    if wanted.count() <= BROADCAST_WINDOWS:  # documents then make no rows of other windows
        known = np.sort(np.array([r["window"] for r in wanted.select("window").collect()], dtype=np.int64))
        wanted = F.broadcast(wanted)
    found = template_windows(df, key, text, widths, known)
    hits = found.join(wanted, "window").withColumn("hit", F.explode("items")).select(
        key, "hit.item", (F.col("place") - F.col("hit.at")).alias("line"), "hit.at", "width", "slots", "hit.theirs", "hit.size")
    hits = hits.distinct().repartition(parts_for(spark), key, "item").sortWithinPartitions(
        key, "item", "line", "at", "slots", "theirs")
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, item long, n_windows int, covered_tokens int, item_tokens int, share double, reworded boolean"
    names = [key, "item", "n_windows", "covered_tokens", "item_tokens", "share", "reworded"]

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def read() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for b in batches:
                kind = b.schema.field(0).type
                yield b

        rows = (r for b in read() for r in zip(*(b.column(c).to_pylist() for c in b.schema.names), strict=True))
        out = []
        for (doc, it), group in itertools.groupby(rows, key=lambda r: r[:2]):
            covered, n, other, size = set(), 0, False, 0
            for _, line in itertools.groupby(group, key=lambda r: r[2]):
                pairs: dict[str, str] = {}
                back: dict[str, str] = {}
                for _, _, _, at, width, mine, theirs, size in line:
                    if _agree(pairs, back, theirs, mine):
                        n += 1
                        covered.update(range(at, at + width))
                other |= any(x != y for x, y in pairs.items())
            if len(covered) >= COVERED or len(covered) >= SHARE * size:
                out.append((doc, it, n, len(covered), size, len(covered) / size, other))
            if len(out) >= 10_000:
                yield _rows(out, names, kind)
                out = []
        if out:
            yield _rows(out, names, kind)

    return hits.mapInArrow(verify, schema).withColumnRenamed("item", item)


def _facts() -> list:
    return [F.lit(0).alias("n_windows"), F.lit(0).alias("covered_tokens"), F.lit(0).alias("item_tokens"),
            F.lit(0.0).alias("share"), F.lit(False).alias("reworded")]


def _rows(rows: list[tuple], names: list[str], key: pa.DataType) -> pa.RecordBatch:
    types = [key, pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
