"""The main body of captured pages, told from navigation, notices, teasers and footers.

Captured text has no markup left, so the tree is read from its layout: the page, its blocks (lines between blank
lines), its runs (lines that aren't sentences, between those that are), the lines. Each line is a node with features of its
own (length, endings, separators), attribute tokens (its words and units, by how much oftener boilerplate has them), depth
(position in page, block and run), the density of sentences and of such tokens in its subtrees, and the same of its
siblings before and after. Gradient-boosted trees give each node the log-odds of boilerplate.

They are trained in the run on a bounded sample of pages. Labels come from what no feature shows: lines, and units of lines,
that recur on many pages are boilerplate, as are lines without a sentence that hang on one; sentences that don't recur are
body, as are the runs among them that hold nothing that recurs. Other lines stay open. The attribute tokens are weighted on
one half of the sample and the trees are grown on the other, so that no line vouches for itself.

Decoding is top-down over page, run, head and line: a line that carries attribute tokens is a head, the neutral lines below
it in its run are its subtree, and a head and its subtree get one choice, that with the greater sum of log-odds.
"""

from __future__ import annotations

import functools
import operator
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleanmark.llm.boosting import BINS, Trees, fit
from gleanmark.llm.residue import real_text
from gleanmark.session import bounded_sample

#: Pages that the trees are trained on.
SAMPLE_PAGES = 3_000
#: Pages of one site, and pages of the sample, that a line must recur on to be boilerplate (the fewer for a line long enough
#: for a sentence or title, which recurs less by chance); and those for a unit of a line.
SITE_REPEATS, LINE_REPEATS, LONG_REPEATS, UNIT_REPEATS = 5, 15, 6, 8
#: Lines of the sample that an attribute token must be in.
LEAST_LINES = 3

#: Short lines whose forms a process keeps.
MOST_SEEN = 100_000

# Begins with one set, which is sought fast: a separator, two white characters, or a dash between white characters.
_SEPARATORS = re.compile(r"[|｜/·•>»›→\t\s](?:(?<=[|｜/·•>»›→\t])|\s+|–\s)")
_ENDS, _CLOSED = frozenset(".!?。！？…"), "\"'”’»)）"
_AFTER, _AFTER_LATIN = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])"), re.compile(r"\s(?<=[.!?]\s)\s*")
_DIGIT = re.compile(r"\d")
_LETTER = re.compile(r"\w")
_LIST = re.compile(r"^(?:\d{1,2}[.)、]|[-*•–])\s*")
# A code, an amount with its unit, or one after its currency. Begins with one set, as above.
_ROW = re.compile(r"[A-Z\d$£€¥](?:(?<=\b[A-Z])[A-Z]-\d{2}|(?<=\d)[\d.,]* ?(?:€|元|reais|kg|%)|(?<=[$£€¥])\s?\d)")
_CLOSING = re.compile(r"^(?:#\w|https?://|www\.|— ?\w|[:;]-?[)(D]|[^\w\s]{1,4}$)")
_HAN = re.compile(r"[一-鿿]")
_NUMBER = re.compile(r"(?<!\w)\d+(?!\w)")
# Latin letters first, which are told fastest.
_WORDS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+[^\W\d_一-鿿]*|[一-鿿]|[^\W\d_一-鿿]+|\d+")
_INVISIBLE = str.maketrans("", "", "​﻿⁠‌‍  ")

#: Categories of a line by its form, as its siblings see it.
SENTENCE, TITLE, NOUN, ROW, CLOSING, NOTHING = range(6)
#: Log-odds of attribute tokens as a feature: bins of a fifth from -6 to 6.
_MIDDLE = 30


def units(line: str) -> list[str]:
    """The parts of a line in lower case: between separators, and what stands before a colon, with it."""
    out = []
    for unit in _SEPARATORS.split(line.lower()):
        if ":" in unit or "：" in unit:
            head, colon, rest = unit.partition("：") if "：" in unit else unit.partition(":")
            unit = head.strip() + ":" if colon and rest.strip() else unit
        if unit := unit.strip():
            out.append(unit)
    return out


def spoken(line: str) -> list[str]:
    """The sentences of a line."""
    after = _AFTER if "。" in line or "！" in line or "？" in line else _AFTER_LATIN
    return [s for s in after.split(line) if s]


def ends_whole(line: str) -> bool:
    """Whether a line ends in a final mark, which quotes and brackets may follow."""
    return line.rstrip(_CLOSED)[-1:] in _ENDS


def unlisted(line: str) -> str:
    """A line without the mark of a list before it."""
    mark = _LIST.match(line)
    return line[mark.end() :] if mark else line


def is_row(line: str) -> bool:
    """Whether a line holds a price or number as rows of a table do; every form of it has a digit."""
    return bool(_DIGIT.search(line)) and bool(_ROW.search(line))


def normal(line: str, site: str | None) -> str:
    """A line in lower case with numbers and the name of its site masked."""
    low = line.lower()
    if site and len(site) > 2:
        low = _named(site.lower()).sub("§", low)
    return _NUMBER.sub("0", low)


@functools.lru_cache(maxsize=10_000)
def _named(site: str) -> re.Pattern:
    """The name of a site, written with or without spaces."""
    return re.compile(r"\s?".join(map(re.escape, site)))


@functools.lru_cache(maxsize=100_000)
def _form(line: str) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """Features of a line by itself, the category first, then small numbers; and its attribute tokens."""
    low = line.lower()
    words = _WORDS.findall(low)
    han = not line.isascii() and bool(_HAN.search(line))
    ends = ends_whole(line)
    parts = units(line)
    bare = unlisted(line)
    listed, closing = len(bare) < len(line), bool(_CLOSING.match(line))
    row = not ends and is_row(line)
    sentences = bare.count("。") + bare.count(". ") + bare.count("! ") + bare.count("！")
    n = len(words)
    least = 7 if han else 4
    if closing:
        category = CLOSING
    elif row:
        category = ROW
    elif (ends and n >= least) or n > 40 or sentences:
        category = SENTENCE
    else:
        category = TITLE if n - listed >= least else NOUN
    cap = BINS - 1
    # Whole units and sentences first.
    tokens = (*{"=" + p for p in (*parts, *spoken(low))}, *(set(map(operator.add, words, words[1:])) if han else set(words)))
    numbers = (category, min(len(line) // 6, cap), min(n, cap), int(ends), min(len(parts), cap), int(listed), min(sentences, cap), int(row), int(closing), int(han), int(":" in line or "：" in line))
    return numbers, tokens


#: Names of the features, in order.
FEATURES = (
    "category chars words ends items listed sentences row closing han colon token_mean token_max token_min unit_max is_title names_site before after before2 after2 token_before token_after token_before2 token_after2 "
    "since_head from_top from_end body_before body_after block_size block_place block_sentences block_tokens run_size run_place run_tokens"
).split()


@dataclass
class Page:
    """Lines of a page with visible characters: their numbers, blocks, forms and bins of attribute tokens (mean, most, least,
    most of a whole unit), and whether each is the title or names the site."""

    numbers: list[int]
    lines: list[str]
    blocks: list[int]
    forms: list[tuple[int, ...]]
    tokens: list[tuple[int, int, int, int]]
    marks: list[tuple[bool, bool]]

    def category(self, k: int) -> int:
        return self.forms[k][0]


def read_lines(text: str) -> tuple[list[int], list[str], list[int]]:
    """Lines with visible characters: their numbers, split at line feeds and counted from 0, and their blocks."""
    numbers, lines, blocks, block, gap = [], [], [], 0, False
    for k, line in enumerate(text.split("\n")):
        line = line.strip()
        if not line or (not _LETTER.search(line) and not any(map(str.isprintable, line.translate(_INVISIBLE)))):
            gap = True
            continue
        block += gap and bool(numbers)
        gap = False
        numbers.append(k)
        lines.append(line)
        blocks.append(block)
    return numbers, lines, blocks


def read_page(text: str, platform: str | None, title: str | None, odds: dict[str, float], seen: dict | None = None) -> Page:
    """The lines of a page with their forms, and the log-odds of their attribute tokens in bins.

    ``seen`` keeps both of short lines for the next pages with the same odds.
    """
    numbers, lines, blocks = read_lines(text)
    site, own_title = (platform or "").lower(), (title or "").strip()
    forms, tokens, marks = [], [], []
    for line in lines:
        read = seen.get(line) if seen is not None else None
        if read is None:
            form, words = _form(line) if seen is None and len(line) < 200 else _form.__wrapped__(line)
            read = form, _token_bins(words, odds)
            if seen is not None and len(line) < 200:
                if len(seen) >= MOST_SEEN:
                    seen.clear()
                seen[line] = read
        forms.append(read[0])
        tokens.append(read[1])
        marks.append((bool(own_title) and line == own_title, bool(site) and site in line.lower().replace(" ", "")))
    return Page(numbers, lines, blocks, forms, tokens, marks)


def _token_bins(words: tuple[str, ...], odds: dict[str, float]) -> tuple[int, int, int, int]:
    """Bins of the log-odds of a line's attribute tokens: mean, most, least, most of a whole unit."""
    get = odds.get
    known = [v for v in map(get, words) if v is not None]
    if not known:
        return (_MIDDLE,) * 4
    whole = None
    for w in words:
        if w[0] != "=":
            break
        v = get(w)
        if v is not None and (whole is None or v > whole):
            whole = v
    return _bin(sum(known) / len(known)), _bin(max(known)), _bin(min(known)), _bin(whole or 0.0)


def _bin(odds: float) -> int:
    return min(59, max(0, _MIDDLE + round(5 * odds)))


def features_of(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the lines of all pages, and the head of each line among them: itself for a head, -1 for a line in no subtree."""
    sizes = np.array([len(p.lines) for p in pages])
    n = int(sizes.sum())
    if not n:
        return np.zeros((0, len(FEATURES)), np.int64), np.zeros(0, np.int64)
    forms = np.array([f for p in pages for f in p.forms], dtype=np.int64)
    tokens = np.array([t for p in pages for t in p.tokens], dtype=np.int64)
    marks = np.array([m for p in pages for m in p.marks], dtype=bool)
    chars = np.array([len(line) for p in pages for line in p.lines], dtype=np.float64)
    at, page = np.arange(n), np.repeat(np.arange(len(pages)), sizes)
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    stop = start + sizes[page]
    category = forms[:, 0]
    sentence = category == SENTENCE

    def beside(values: np.ndarray, by: int, none: int) -> np.ndarray:
        k = at + by
        return np.where((k >= start) & (k < stop), values[np.clip(k, 0, n - 1)], none)

    def group(new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, size and first line of the groups that begin where ``new`` says."""
        number = np.cumsum(new) - 1
        size = np.bincount(number)
        return number, size[number], (np.cumsum(size) - size)[number]

    begins = at == start
    block = np.concatenate([np.array(p.blocks, dtype=np.int64) for p in pages])
    in_block, block_size, block_first = group(begins | np.concatenate([[True], block[1:] != block[:-1]]))
    in_run, run_size, run_first = group(begins | np.concatenate([[True], sentence[1:] != sentence[:-1]]))
    of_chars = np.bincount(in_block, chars)
    density = 10 * np.bincount(in_block, chars * sentence) / np.maximum(of_chars, 1)
    total = np.cumsum(sentence)
    seen = total - sentence - (total - sentence)[start]
    after = (total[stop - 1] - (total - sentence)[start]) - seen - sentence
    # A line with attribute tokens is a head; sentences, rows, closing lines and the title end a subtree.
    ends = sentence | (category == ROW) | (category == CLOSING) | marks[:, 0]
    head = ~ends & ((tokens[:, 1] > _MIDDLE + 5) | (tokens[:, 3] > _MIDDLE + 5))
    last_head = np.maximum.accumulate(np.where(head, at, -1))
    last_end = np.maximum.accumulate(np.where(ends, at, -1))
    heads = np.where(~ends & (last_head > last_end) & (last_head >= start), last_head, -1)
    mean = lambda values, number: (np.bincount(number, values) / np.bincount(number))[number].astype(np.int64)
    rows = np.column_stack([
        forms, tokens, marks,
        *[beside(category, by, NOTHING) for by in (-1, 1, -2, 2)], *[beside(tokens[:, 1], by, _MIDDLE) for by in (-1, 1, -2, 2)],
        np.where(heads < 0, 0, np.minimum(at - heads + 1, 20)),
        np.minimum(at - start, 20), np.minimum(stop - 1 - at, 20), np.minimum(seen, 10), np.minimum(after, 10),
        np.minimum(block_size, 20), np.minimum(at - block_first, 20), density[in_block].astype(np.int64), mean(tokens[:, 0], in_block),
        np.minimum(run_size, 20), np.minimum(at - run_first, 20), mean(tokens[:, 1], in_run),
    ])
    return rows.astype(np.int64), heads


def labels(pages: list[tuple[str | None, str | None, list[str]]]) -> list[np.ndarray]:
    """1 for boilerplate, 0 for body, -1 for open, of the lines of each page (site, title, lines), by what recurs over pages.

    A page counts once for each line and unit. The page's own title is body.
    """
    on_site, on_all, of_unit, of_sentence = Counter(), Counter(), Counter(), Counter()
    keys = [[normal(line, site) for line in lines] for site, _, lines in pages]
    parts = [[units(line) for line in lines] for _, _, lines in pages]
    for (site, _, _), own, unit in zip(pages, keys, parts):
        on_site.update({(site, k) for k in own})
        on_all.update(set(own))
        of_unit.update({u for line in unit for u in line})
        of_sentence.update({s for k in own for s in spoken(k)})
    out = []
    for (site, title, lines), own, unit in zip(pages, keys, parts):
        n = len(lines)
        title, label = (title or "").strip(), np.full(n, -1)
        recurs, sentence = np.zeros(n, bool), np.zeros(n, bool)
        for j, line in enumerate(lines):
            ends, us = ends_whole(line), unit[j]
            often = sum(of_unit[u] >= UNIT_REPEATS for u in us)
            by_units = not ends and ((bool(us) and us[0].endswith(":") and of_unit[us[0]] >= UNIT_REPEATS) or (len(us) > 1 and often >= 0.6 * len(us)))
            category = _form.__wrapped__(line)[0][0]
            least = LONG_REPEATS if category in (SENTENCE, TITLE) else LINE_REPEATS
            said = ends and all(of_sentence[s] >= least for s in spoken(own[j]))
            recurs[j] = line != title and (on_site[site, own[j]] >= SITE_REPEATS or on_all[own[j]] >= least or said or by_units)
            sentence[j] = category == SENTENCE and not recurs[j]
        if recurs.all():
            out.append(label)  # nothing on this page tells body from boilerplate
            continue
        label[recurs], label[sentence] = 1, 0
        first = 0
        while first < n:
            stop = first + 1
            while stop < n and sentence[stop] == sentence[first]:
                stop += 1
            if not sentence[first]:
                if not recurs[first:stop].any():
                    label[first:stop] = 0
                hangs = False
                for j in range(first, stop):
                    category = _form.__wrapped__(lines[j])[0][0]
                    if recurs[j]:
                        hangs = True
                    elif lines[j] == title or category in (ROW, CLOSING):
                        label[j], hangs = 0, False
                    elif hangs and category == TITLE:
                        label[j] = 1
            first = stop
        out.append(label)
    return out


def token_odds(pages: list[list[str]], label: list[np.ndarray]) -> dict[str, float]:
    """Log-odds of boilerplate of the attribute tokens of labelled lines."""
    of: dict[str, list[int]] = {}
    total = [0, 0]
    for lines, own in zip(pages, label):
        for line, y in zip(lines, own):
            if y < 0:
                continue
            total[y] += 1
            for w in _form.__wrapped__(line)[1]:
                of.setdefault(w, [0, 0])[y] += 1
    base = np.log((total[1] + 1) / (total[0] + 1))
    return {w: float(np.log((n[1] + 0.5) / (n[0] + 0.5)) - base) for w, n in of.items() if sum(n) >= LEAST_LINES}


@dataclass
class BodyModel:
    trees: Trees
    odds: dict[str, float] = field(default_factory=dict)
    #: By script (Han or not), whether it is an entry of a list or table, and size: whole lines of main bodies that end
    #: without a final mark, and places where a line of that size or longer could have been cut.
    endings: dict[tuple[bool, bool, int], tuple[int, int]] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "seen"}

    def read(self, text: str, platform: str | None, title: str | None) -> Page:
        return read_page(text, platform, title, self.odds, self.__dict__.setdefault("seen", {}))

    def boilerplate(self, pages: list[Page]) -> list[np.ndarray]:
        """For each page, which of its lines aren't main body. A head and its subtree get one choice, so none is contradicted."""
        rows, heads = features_of(pages)
        if not len(rows):
            return [np.zeros(0, bool) for _ in pages]
        odds = self.trees.log_odds(rows)
        own = np.where(heads >= 0, heads, np.arange(len(rows)))
        chosen = np.where(np.bincount(own, minlength=len(rows))[own] > 1, np.bincount(own, odds.clip(-4, 4), len(rows))[own], odds) > 0
        return np.split(chosen, np.cumsum([len(p.lines) for p in pages])[:-1])

    def bodies(self, texts: list[str | None], platforms: list[str | None], titles: list[str | None]) -> list[list[str]]:
        """The body lines of each text, in order."""
        pages = [self.read(t or "", p, h) for t, p, h in zip(texts, platforms, titles)]
        return [[line for line, drop in zip(p.lines, b) if not drop] for p, b in zip(pages, self.boilerplate(pages))]


#: Largest size of a line that is told apart.
MOST_SIZE = 16
_TOKEN = re.compile(r"[^\W\d_]+|\d+")


#: Characters at the start of a line in which most lines of that size have enough words.
_START = 112


def line_size(line: str, form: tuple[int, ...] | None = None) -> tuple[bool, bool, int]:
    """Whether a line is mostly Han, whether it is an entry of a list or table, and its number of words (Han characters),
    list marks and all cells but the last left out. ``form`` is its form, where that is known."""
    row = is_row(line)
    if form and not row and form[2] > MOST_SIZE + 1 and line.isascii():
        return False, bool(form[5]), MOST_SIZE  # a list mark is one word at most
    bare = unlisted(line)
    entry = len(bare) < len(line)
    if row:
        bare, entry = re.split(r"[|·\t]", line)[-1].strip(), True
    han = 0 if bare.isascii() else len(_HAN.findall(bare))
    if han > len(bare) / 2:
        return True, entry, min(MOST_SIZE, han)
    words = lambda text: len(_TOKEN.findall(_HAN.sub(" x ", text) if han else text))
    size = words(bare[:_START])
    return False, entry, min(MOST_SIZE, size if size >= MOST_SIZE or len(bare) <= _START else words(bare))


def line_endings(pages: list[Page], boilerplate: list[np.ndarray], titles: list[str | None]) -> dict[tuple[bool, bool, int], tuple[int, int]]:
    """Of body lines with another line after them: how many of each size end without a mark, and how many reach that size.

    The last line of a page may be cut, and the page's own title is no measure for others; both are left out, as are
    closing lines.
    """
    sizes, ends = Counter(), Counter()
    for page, drop, title in zip(pages, boilerplate, titles):
        title = (title or "").strip()
        for line, form, gone in zip(page.lines[:-1], page.forms, drop.tolist()):
            if gone or line == title or form[0] == CLOSING:
                continue
            size = line_size(line, form)
            sizes[size] += 1
            if size[2] and not ends_whole(line):
                ends[size] += 1
    places = Counter()
    for (han, entry, size), n in sizes.items():
        for s in range(1, size + 1):
            places[han, entry, s] += n
    return {k: (ends[k], n) for k, n in places.items()}


def sampled(content: DataFrame, sample: int = SAMPLE_PAGES) -> list:
    """The ``sample`` pages with a text that come first by the hash of their id."""
    return [r for r in bounded_sample(content.select("content_id", "platform", "title", "text"), "content_id", sample) if r.text]


def train(content: DataFrame, sample: int = SAMPLE_PAGES) -> BodyModel:
    """Trees trained on a bounded sample of ``content``, which should hold real text."""
    return trained(sampled(content, sample))


def trained(rows: list) -> BodyModel:
    read = [(r.platform, r.title, read_lines(r.text)[1]) for r in rows]
    read, rows = zip(*[(p, r) for p, r in zip(read, rows) if p[2]]) if any(p[2] for p in read) else ((), ())
    if not read:
        return BodyModel(fit(np.zeros((1, len(FEATURES)), np.int64), np.zeros(1), trees=1))
    label, lines = labels(list(read)), [p[2] for p in read]
    # Each half gets its tokens from the other one; in use, both count.
    halves = [token_odds(lines[h::2], label[h::2]) for h in (0, 1)]
    pages = [read_page(r.text, r.platform, r.title, halves[1 - k % 2] if len(read) > 1 else halves[0]) for k, r in enumerate(rows)]
    x, y = features_of(pages)[0], np.concatenate(label)
    if not (y >= 0).any():
        return BodyModel(fit(x[:1], np.zeros(1), trees=1))
    model = BodyModel(fit(x[y >= 0], y[y >= 0].astype(float)), token_odds(lines, label))
    pages = [model.read(r.text, r.platform, r.title) for r in rows]
    model.endings = line_endings(pages, model.boilerplate(pages), [r.title for r in rows])
    return model


def boilerplate_lines(content: DataFrame, sample: int = SAMPLE_PAGES) -> DataFrame:
    """``content_id, line_no``: the lines with visible characters that aren't main body, counted from 0.

    Only records with real text count; null, empty and blank texts give none, repeated records each line once. Titles
    and platforms may be null; extra columns are ignored.
    """
    kind = dict(content.dtypes)["content_id"]
    pages = real_text(content.where("content_id is not null").select("content_id", "platform", "title", "text"))
    model = content.sparkSession.sparkContext.broadcast(train(content, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lines = [], []
            read = [model.value.read(*row) for row in zip(batch.column(3).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            for key, page, drop in zip(batch.column(0).to_pylist(), read, model.value.boilerplate(read)):
                own = np.array(page.numbers)[drop] if len(drop) else []
                lines.extend(own)
                ids.extend([key] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(lines, pa.int64())], names=["content_id", "line_no"])

    return pages.mapInArrow(run, f"content_id {kind}, line_no long").distinct()
