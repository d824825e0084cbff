"""Titles and texts that were cut before their word, sentence or heading was complete.

Near-copies are found by min-hash banding of leading windows (shingles of five words, similarity 0.8): windows of 16 words,
64, 256 and so on, so that a copy cut at any length shares the bands of its longest window with the whole one. Texts that
don't end in a final mark are joined to those that go on after their last shingle, the pair is aligned, and the copy whose
alignment ends early is cut. Titles are aligned with all titles that begin with them and go on inside a word, and with the
headings of their own text.

Values without such a copy are scored by terminality: how often whole lines of main bodies end in that form, how often the
closing word closes sentences and headings in the whole corpus, whether it occurs as a complete word at all, and whether it
is rather the beginning of a much more frequent one. A mark that was put at the cut shows it by itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanmark.llm import mainbody
from gleanmark.llm.mainbody import BodyModel, Page, line_size, train
from gleanmark.llm.residue import real_text, residue
from gleanmark.llm.shingles import WIDTH, Words, bands, count_of, mixers, runs, shingles
from gleanmark.session import staged

#: Permutations and rows of a band: pairs of similarity 0.8 share a band with probability 0.985.
PERMUTATIONS, ROWS = 32, 4
SIMILARITY = 0.8
#: Words that a text has at least to be aligned.
LEAST_ALIGNED = 12
#: Share of a word's occurrences that close a sentence below which it doesn't close one, and the occurrences that takes.
LEAST_TERMINALITY, LEAST_SEEN = 0.012, 25
#: A word is the beginning of another if that one is so many times as frequent.
BEGINNING = 8
#: Words that a task counts before it passes the counts on.
MOST_WORDS = 200_000
#: Pages that are read together.
STEP = 1_000
#: Characters at the end of a value in which its last word mostly lies.
TAIL = 48
#: Words of the shortest leading window, and how many times longer the next one is.
WINDOW, WIDER = 16, 4

_TOKENS = re.compile(r"[一-鿿]|[^\W\d_一-鿿]+|\d+")
_FINAL = re.compile(r"[.!?。！？][\"'”’»)）]*$")
_DOTS = re.compile(r"\s*\.\.\.+$")
_MARK = re.compile(r"(?:…|\[…?|\[\.*\]?|\(…?\.*\)|�|\[…\]|\[\.\.\.\]|>>|→)\W*$")
_OPEN = re.compile(r"[-‐,;:、，；：(（“„«&+]$")
_LETTER = re.compile(r"[^\W_]")
# Words, and between them the marks that end a sentence and line feeds. Latin letters first, which are told fastest.
_PARTS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+[^\W\d_一-鿿]*|[.!?。！？\n]|[一-鿿]|[^\W\d_一-鿿]+|\d+")
_ENDS = frozenset(".!?。！？")
_CLOSED = "\"'”’»)）"
_STOPS = _ENDS | {"\n"}
_ROW = re.compile(r"^(?:[A-Z]{2}-\d{2,}|[$£€¥]?\s?\d[\d.,]*\s?(?:€|元|reais|\$|£|%)?)(?:\s*[|·\t]\s*.+)?$")


def last_token(value: str) -> str:
    last = value.rsplit("\n", 1)[-1]
    tokens = _TOKENS.findall(last[-TAIL:])
    if len(tokens) < 2 and len(last) > TAIL:
        tokens = _TOKENS.findall(last)  # the only one may begin further ahead
    return ("#" if tokens[-1].isdigit() else tokens[-1]) if tokens else ""


def count_words(value: str, is_title: bool, attested: Counter, closing: Counter) -> None:
    """Adds the words of a value: complete ones, and those that close a sentence or heading. Whole inner lines count too.

    Numbers and the marks between words are counted as well; ``folded`` takes them out.
    """
    parts = _PARTS.findall(value)
    attested.update(parts)
    attested["\n"] -= value.count("\n")
    closing.update([word for word, mark in zip(parts, parts[1:]) if mark in _ENDS and word not in _STOPS])
    *inner, last = value.split("\n")
    if is_title:
        closing.update([last_token(line) for line in (*inner, last) if _LETTER.search(line)])
    else:
        attested.update(["\n" + mainbody.unlisted(line) for line in map(str.strip, inner) if len(line) < 60 and _LETTER.search(line)])
    if _LETTER.search(last) and not _FINAL.search(last.strip()):
        attested[next(w for w in reversed(parts) if w not in _STOPS)] -= 1


def folded(counts: Counter) -> dict[str, int]:
    """Counts of words, all numbers as one, without the marks between them."""
    out = {w: n for w, n in counts.items() if w not in _ENDS and not w.isdigit()}
    if numbers := sum(n for w, n in counts.items() if w.isdigit()):
        out["#"] = out.get("#", 0) + numbers
    return out


def marked(text: str) -> tuple[str, str, str] | None:
    """How a text ends where its last mark tells: ``whole``, ``cut`` or ``dots``, with its last token; None without such a mark."""
    last = text.rstrip().rsplit("\n", 1)[-1].strip()
    if _DOTS.search(last):
        bare = _DOTS.sub("", last)
        return ("cut", "", "") if not bare or not (bare[-1].isalnum() or bare[-1] in "€$£%元)]”»\"'") else ("dots", last_token(bare), "")
    if _MARK.search(last):
        return "cut", "", ""
    return ("whole", "", "") if _FINAL.search(last) or not last else None


def form_number(size: tuple[bool, bool, int]) -> int:
    """The form of a line, as ``line_size`` tells it, as one number."""
    han, entry, words = size
    return (2 * han + entry) * (mainbody.MOST_SIZE + 1) + words


def unmarked(text: str, title: str | None, page: Page, last_drops: bool) -> tuple[str, str, str, int | None]:
    """How a text without a mark at its end ends: ``whole`` (its last line is no body, or closes it), ``cut`` by an open mark,
    else ``heading``, which the closing word decides; with its last token, its last line and the form of that line. No form is
    given where the line is the title, which any form may have."""
    last = text.rstrip().rsplit("\n", 1)[-1].strip()
    if not page.lines or page.category(-1) == mainbody.CLOSING or last_drops:
        return "whole", "", "", None
    bare = mainbody.unlisted(last)
    if _OPEN.search(bare):
        return "cut", "", "", None
    if _ROW.match(last):
        bare = re.split(r"[|·\t]", last)[-1].strip()
        if bare == last or not any(c.isalpha() for c in bare) or bare.endswith("reais"):
            return "whole", "", "", None
    return "heading", last_token(bare), "\n" + bare, None if title and last == title.strip() else form_number(line_size(last))


def classified(texts: list[str], platforms: list[str | None], titles: list[str | None], body: BodyModel, ended: Counter | None = None, places: Counter | None = None) -> list[tuple[str, str, str, int | None]]:
    """How each text ends, its last token, its last line and the form of that. The pages are read together; how their lines
    end is added to ``ended`` and ``places``, by form."""
    out = []
    for at in range(0, len(texts), STEP):
        own = slice(at, at + STEP)
        pages = [body.read(*row) for row in zip(texts[own], platforms[own], titles[own])]
        drops = body.boilerplate(pages)
        if ended is not None:
            for form, (n, of) in mainbody.line_endings(pages, drops, titles[own]).items():
                ended[form_number(form)] += n
                places[form_number(form)] += of
        for text, title, page, drop in zip(texts[own], titles[own], pages, drops):
            end = marked(text)
            out.append((*end, None) if end else unmarked(text, title, page, bool(len(drop)) and bool(drop[-1])))
    return out


def heading_goes_on(title: str, text: str, platform: str | None, body: BodyModel) -> bool:
    """Whether a heading in the main body of the record's own text begins with its title and goes on with a word.

    A title of one word may be a name that any line begins with.
    """
    if title not in text or len(_TOKENS.findall(title)) < 2:
        return False

    def longer(line: str) -> bool:
        line = mainbody.unlisted(line.strip())
        return line.startswith(title) and bool(re.match(r"\s*\w", line[len(title) :])) and not _FINAL.search(line)

    # Most headings are the title itself; only pages with a longer one are read.
    if not any(longer(line) for line in text.split("\n")):
        return False
    page = body.read(text, platform, title)
    return bool(page.lines) and any(longer(line) and not drop for line, drop in zip(page.lines, body.boilerplate([page])[0]))


_SCHEMA = "what string, content_id {kind}, field_name string, platform string, ends string, word string, line string, form int, attested long, closing long, size int, keys array<long>, asks array<long>, tail long"


def _scan(pages: DataFrame, model) -> DataFrame:
    """Counts of words and of line endings by partition, the ends of values and the bands of texts, in one pass."""
    kind = dict(pages.dtypes)["content_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attested, closing, ended, places, cache = Counter(), Counter(), Counter(), Counter(), Words()
        names = _SCHEMA.format(kind=kind).split(", ")
        id_type = None

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), id_type, pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=[n.split()[0] for n in names])

        def counted() -> Iterator[pa.RecordBatch]:
            seen, closed = folded(attested), folded(closing)
            items = list(seen.keys() | closed.keys())
            for at in range(0, len(items), 20_000):
                yield made([("word", None, None, None, None, w, None, None, seen.get(w, 0), closed.get(w, 0), None, None, None, None) for w in items[at : at + 20_000]])
            attested.clear()
            closing.clear()

        for batch in batches:
            id_type = batch.schema.field(0).type
            rows: list[tuple] = []
            columns = [batch.column(k).to_pylist() for k in range(4)]
            for key, platform, title, text, (ends, word, line, form) in zip(*columns, classified(columns[3], columns[1], columns[2], model.value, ended, places)):
                if title and title.strip():
                    count_words(title, True, attested, closing)
                    bare = _DOTS.sub("", title.strip())
                    mark = "cut" if bare != title.strip() or _MARK.search(title.strip()) or _OPEN.search(bare) or heading_goes_on(bare, text, platform, model.value) else "title"
                    rows.append(("end", key, "title", platform, mark, last_token(bare), title.strip() if bare == title.strip() else None, None, None, None, len(title), None, None, None))
                count_words(text, False, attested, closing)
                if word:
                    attested[word] += 0  # a closing word that occurs nowhere else is judged as well
                words = cache.hashes(text)
                keys = window_keys(words[lead(text) :])
                tail = last_run(words) if ends != "whole" else None
                rows.append(("end", key, "text", platform, ends, word, line, form, None, None, len(words), [k for own in keys for k in own], keys[-1] if keys and tail is not None else None, tail))
            if rows:
                yield made(rows)
            if len(attested) > MOST_WORDS:
                yield from counted()
        yield from counted()
        if places:
            # Of a form, the places are its occurrences and the endings its closings.
            yield made([("form", None, None, None, None, None, None, f, n, ended[f], None, None, None, None) for f, n in places.items()])

    return pages.mapInArrow(run, _SCHEMA.format(kind=kind))


def endings(scan: DataFrame) -> dict[tuple[bool, bool, int], tuple[int, int]]:
    """Endings of whole body lines by their form, as ``line_endings`` counts them, over all pages."""
    total = scan.where("what = 'form'").groupBy("form").agg(F.sum("closing").alias("ended"), F.sum("attested").alias("places")).collect()
    counts = {r.form: (r.ended, r.places) for r in total}
    forms = [(han, entry, size) for han in (False, True) for entry in (False, True) for size in range(mainbody.MOST_SIZE + 1)]
    return {f: counts[form_number(f)] for f in forms if form_number(f) in counts}


def _verdicts(scan: DataFrame) -> DataFrame:
    """``word, open_word, seen``: whether a closing word shows a cut, from counts over the whole corpus."""
    words = scan.where("what = 'word'").groupBy("word").agg(F.sum("attested").alias("seen"), F.sum("closing").alias("closing"))
    latin = words.where((F.col("seen") >= BEGINNING) & F.col("word").rlike("^\\p{L}") & ~F.col("word").rlike("^[\\u4e00-\\u9fff]"))
    begun = latin.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda n: F.substring("word", F.lit(1), n))).alias("word"), "seen").where("word <> ''").groupBy("word").agg(F.max("seen").alias("longer"))
    one = (F.length("word") == 1) & F.col("word").rlike("^\\p{L}") & ~F.col("word").rlike("^[\\u4e00-\\u9fff]")
    part = F.coalesce(F.col("longer"), F.lit(0)) >= BEGINNING * F.greatest(F.col("seen"), F.lit(1))
    rarely = (F.col("seen") >= LEAST_SEEN) & (F.col("closing") - 1 < LEAST_TERMINALITY * F.col("seen"))
    return words.join(begun, "word", "left").select("word", (one | part | rarely).alias("open_word"), "seen")


def lead(text: str) -> int:
    """Words before the first line that ends a sentence: menus and headings, which differ between copies of a page."""
    at = 0
    for line in text.split("\n"):
        if line.rstrip().rstrip(_CLOSED)[-1:] in _ENDS:
            return count_of(text[:at]) if at else 0
        at += len(line) + 1
    return 0


def window_keys(words: np.ndarray) -> list[list[int]]:
    """Keys of the bands of each leading window, the shortest first; the last one is the longest that the text fills.

    The shingles of a window are the first ones of the next, so each is hashed once and the least hashes are carried on.
    """
    sizes = [WINDOW]
    while sizes[-1] <= len(words):
        sizes.append(sizes[-1] * WIDER)
    sizes.pop()
    if not sizes:
        return []
    parts = runs(words[: sizes[-1]])
    mixed = parts[None, :] * mixers(PERMUTATIONS)[:, None]
    mixed ^= mixed >> np.uint64(31)
    least = np.minimum.accumulate(np.minimum.reduceat(mixed, [0, *[n - WIDTH + 1 for n in sizes[:-1]]], axis=1), axis=1)
    return (bands(least, ROWS).T ^ (np.array(sizes, dtype=np.int64) * 0x9E3779B1)[:, None]).tolist()


def last_run(words: np.ndarray) -> int | None:
    """Signed hash of the last shingle of a text that may be cut, without its last word, which may be part of one."""
    return int(runs(words[-WIDTH - 1 : -1])[0].view(np.int64)) if len(words) >= LEAST_ALIGNED else None


def going_on(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signed hashes of the shingles of a text after whose last place more than one word follows, and how many follow."""
    parts, back = np.unique(runs(words)[::-1], return_index=True)
    return parts[back > 1].view(np.int64), back[back > 1]


def _early(scan: DataFrame, content: DataFrame) -> DataFrame:
    """``content_id`` of texts without a final mark that a near-copy continues: banding, a join on the last shingle, alignment.

    A text asks with the bands of its longest leading window; members of a band are joined to it only where they hold its
    last shingle and go on after it, as an alignment that ends early demands. Of those, first the one that goes on longest
    is tried, for each band and shingle, so copies of a hot band give as many pairs as members; texts that it doesn't
    continue are aligned with all.
    """
    kind = dict(content.dtypes)["content_id"]
    texts = staged(scan.where("what = 'end' and field_name = 'text' and size > 0").select("content_id", "keys", "asks", "tail", "size"), "bands")
    asked = texts.where("tail is not null").select("content_id", "tail", "size", F.explode("asks").alias("key"))
    holding = texts.select("content_id", "size", F.explode("keys").alias("key"))
    # Only bands in which someone asks and a longer text stands.
    shared = holding.groupBy("key").agg(F.max("size").alias("most")).join(asked.groupBy("key").agg(F.min("size").alias("least")), "key").where("most > least").select("key")
    asked = staged(asked.select("content_id", "tail", "key").join(shared, "key", "left_semi").distinct(), "asked")
    members = staged(holding.join(shared, "key", "left_semi").select("content_id", "key").distinct(), "members")
    few = staged(content.select("content_id", "text").join(members.select("content_id").distinct(), "content_id", "left_semi").dropDuplicates(["content_id"]), "copied")

    def posts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [going_on(cache.hashes(t)) for t in part.column(1).to_pylist()]
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(p) for p, _ in found])))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate([p for p, _ in found])), pa.array(np.concatenate([n for _, n in found]).astype(np.int32))], names=["other", "tail", "after"])

    held = few.mapInArrow(posts, f"other {kind}, tail long, after int").join(asked.select("tail").distinct(), "tail", "left_semi")
    bands_of = members.select(F.col("content_id").alias("other"), "key")
    held = staged(held.join(bands_of, "other").join(asked.select("key", "tail").distinct(), ["key", "tail"], "left_semi"), "continuing")
    text, more = few.select("content_id", "text"), few.select(F.col("content_id").alias("other"), F.col("text").alias("more"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Words()
        for batch in batches:
            keep = [ends_early(cache.hashes(a.as_py()), cache.hashes(b.as_py())) for a, b in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_()))], names=["content_id"])

    def continued(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where("content_id <> other").select("content_id", "other").distinct()
        return pairs.join(text, "content_id").join(more, "other").select("content_id", "text", "more").mapInArrow(run, f"content_id {kind}").distinct()

    longest = held.groupBy("key", "tail").agg(F.max(F.struct("after", "other")).alias("top")).select("key", "tail", "top.other")
    first = staged(continued(asked.join(longest, ["key", "tail"])), "continued")
    rest = asked.join(first, "content_id", "left_anti").join(held.select("key", "tail", "other"), ["key", "tail"])
    return first.unionByName(continued(rest))


def _begun_titles(titles: DataFrame) -> DataFrame:
    """``content_id`` of the titles (``content_id, title``) that another title begins with and goes on inside a word.

    Each title gives one hash for every place inside a word, so that no pair of titles is made; hashes of all titles are
    brought down to distinct ones before they meet the titles.
    """
    distinct = titles.select("title").distinct()
    places = F.filter(F.sequence(F.lit(4), F.greatest(F.length("title") - 1, F.lit(4))), lambda n: F.substring("title", n, F.lit(2)).rlike("^[\\p{L}]{2}$") & ~F.substring("title", n, F.lit(2)).rlike("[\\u4e00-\\u9fff]"))
    begun = distinct.where(F.length("title") > 4).select(F.explode(F.transform(places, lambda n: F.xxhash64(F.substring("title", F.lit(1), n)))).alias("h")).distinct()
    return titles.select("content_id", F.xxhash64("title").alias("h")).join(begun, "h", "left_semi").select("content_id").distinct()


def ends_early(short: np.ndarray, long: np.ndarray) -> bool:
    """Whether ``short`` is a near-copy of ``long`` whose alignment ends before ``long`` does. The last word may be part of one."""
    if len(short) < LEAST_ALIGNED or len(long) <= len(short):
        return False
    a, b = shingles(short[:-1]), shingles(long)
    shared = len(np.intersect1d(a, b))
    if shared < SIMILARITY * len(a) or shared < SIMILARITY * (len(b) - (len(long) - len(short))):
        return False
    tail = short[-6:-1]
    spots = np.flatnonzero(long[: len(long) - 4] == tail[0])
    at = [s for s in spots if np.array_equal(long[s : s + 5], tail)]
    # Words left after the aligned end, besides the one that may have been cut.
    return bool(at) and min(abs(s - (len(short) - 6)) for s in at) <= 0.2 * len(short) + 3 and all(len(long) - (s + 5) > 1 for s in at)


def ends(content: DataFrame) -> DataFrame:
    """``content_id, field_name, platform, is_cut, evidence``: every title and every real text, and whether it was cut.

    ``evidence`` is what decided: ``alignment`` with a copy, a ``mark`` at the end, or ``terminality``. Null, empty and blank
    values and all fields of records whose text is residue are left out; titles of records without a text count. A record
    that arrived twice counts once. Extra columns are ignored.
    """
    base = content.where("content_id is not null").select("content_id", "platform", "title", F.coalesce("text", F.lit("")).alias("text"))
    cases = staged(residue(base, ("text",)).select("content_id"), "residue")
    pages = base.join(cases, "content_id", "left_anti")
    model = content.sparkSession.sparkContext.broadcast(train(content))
    scan = staged(_scan(pages, model), "ends")
    # How often lines of a form end so is a count over all pages, not of those that the trees were trained on.
    model.value.endings = endings(scan)
    open_forms = [form_number(f) for f, (ended, places) in model.value.endings.items() if ended < LEAST_TERMINALITY * places]
    word = staged(_verdicts(scan), "verdicts")
    line = word.where("word like '\\n%'").select(F.col("word").alias("line"), F.col("seen").alias("line_seen"))
    values = scan.where("what = 'end' and (field_name = 'title' or size > 0)").select("content_id", "field_name", "platform", "ends", "word", "line", "form")
    # An end in a form that whole lines hardly ever have is open.
    values = values.withColumn("ends", F.when((F.col("ends") == "heading") & F.col("form").isin(open_forms), "open").otherwise(F.col("ends")))
    # Most values end in a mark; only the others are looked up, so no empty key gathers them.
    plain = values.where("ends in ('cut', 'whole')").select("content_id", "field_name", "platform", (F.col("ends") == "cut").alias("is_cut"), F.lit("mark").alias("evidence"))
    doubtful = values.where("ends not in ('cut', 'whole')")
    early = _early(scan, base).select("content_id", F.lit("text").alias("field_name"), F.lit(True).alias("early"))
    begun = _begun_titles(doubtful.where("field_name = 'title' and line is not null").select("content_id", F.col("line").alias("title"))).select("content_id", F.lit("title").alias("field_name"), F.lit(True).alias("early"))
    judged = doubtful.join(word.where("word not like '\n%'"), "word", "left").join(line, "line", "left").join(early.unionByName(begun), ["content_id", "field_name"], "left")
    open_word = F.coalesce("open_word", F.length("word") == 1, F.lit(False))
    # A title may go on in another one and be whole, where its last word is known as one.
    aligned = F.coalesce("early", F.lit(False)) & ((F.col("field_name") == "text") | (F.coalesce("seen", F.lit(0)) < LEAST_SEEN))
    known = F.coalesce(F.col("line_seen") >= 3, F.lit(False))
    by_form = F.when(F.col("ends") == "open", True).when(F.col("ends") == "heading", ~known & open_word).otherwise(open_word)
    is_cut = F.when((F.col("ends") == "heading") & known & (F.col("field_name") == "text"), False).otherwise(aligned | by_form)
    evidence = F.when(aligned & is_cut, "alignment").otherwise("terminality")
    return plain.unionByName(judged.select("content_id", "field_name", "platform", is_cut.alias("is_cut"), evidence.alias("evidence")))


def cut_values(content: DataFrame) -> DataFrame:
    """``content_id, field_name`` of the values that were cut."""
    return ends(content).where("is_cut").select("content_id", "field_name").distinct()


def cut_shares(content: DataFrame) -> DataFrame:
    """``platform, field_name, n_values, n_cut, share``: how often each source truncates. Records count once."""
    rows = ends(content).groupBy("content_id", "field_name").agg(F.max("platform").alias("platform"), F.max("is_cut").alias("is_cut"))
    return rows.groupBy("platform", "field_name").agg(F.count("*").alias("n_values"), F.count_if("is_cut").alias("n_cut"), F.avg(F.col("is_cut").cast("double")).alias("share"))
