"""Text of scanned pages: broken words, running headers, page numbers and misread characters.

Lines are judged with their neighbours by a boosted classifier that tells page furniture from text,
and so are the pairs of lines at which a word may have been broken. Misread words get their
candidates from an inverted join over character q-grams, and a boosted ranking chooses among them.
The classifiers are trained here on bounded samples that label themselves; all counts they use are
those of the whole collection.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import by_shuffle, cut, first_rows, hashed_sample
from .boosting import Boosted
from .papers import one_per_paper

#: Bodies that the line classifier is trained on, and words the other two are trained on, at most.
SAMPLE_BODIES, SAMPLE_WORDS = 1500, 4000
#: Characters of each of these bodies that are trained on; all bodies are judged whole.
SAMPLE_CHARACTERS = 20_000
#: Papers that must have a word for it to be a candidate, and how often a candidate must outnumber the word it replaces.
KNOWN, OUTNUMBERS = 4, 8
#: Kinds of confusion kept, the most frequent ones.
CONFUSIONS = 400
#: Misread words up to which their list is sent to every task; beyond it they are joined.
BROADCAST_WORDS = 500_000

_BREAK = re.compile(r"([^\W\d_]{1,40})[ \t]*([-­¬‐‑])[ \t\x0c]*$")
_ANY_BREAK = re.compile(r"[-­¬‐‑][ \t\x0c]*\n")
_NUMBER = re.compile(r"\d+|\b[ivxlc]+\b", re.I)
_BLOCK = 200_000


# Lines

_PAGE = re.compile(r"^(?:page|p\.?|pg\.?|s\.)?[\s\-–—\[(|.]*(?:\d{1,5}|[ivxlc]{1,7})[\s\-–—\])|]*(?:(?:of|/)\s*\d{1,5})?$", re.I)


def roman(numeral: str) -> int:
    """The number of a Roman numeral, however it is put together."""
    values = ["ivxlc".index(c) for c in numeral.lower() if c in "ivxlc"]  # _NUMBER also takes a dotted or dotless i
    worth = [(1, 5, 10, 50, 100)[v] for v in values]
    return sum(-w if w < after else w for w, after in zip(worth, [*worth[1:], 0]))


class Line:
    __slots__ = ("text", "shape", "number", "words", "page")

    def __init__(self, text: str):
        self.text = text.replace("\x0c", "").strip()
        self.shape = re.sub(r"[^\w]+", " ", _NUMBER.sub("0", self.text.lower())).strip()
        m = _NUMBER.search(self.text)
        self.number = None if m is None or len(m[0]) > 7 else int(m[0]) if m[0].isdigit() else roman(m[0])
        self.words = self.text.count(" ") + 1
        self.page = bool(_PAGE.match(self.text))


def _like(shape: str) -> str:
    """A shape whose misread characters don't matter much: letters only, those often confused as one."""
    worded = "".join(w for w in shape.split() if any(c.isalpha() for c in w))
    return re.sub(r"[^a-z]+", "", worded.translate(str.maketrans("05819!†ɑ", "osblgita"))).translate(str.maketrans("cbi", "ehl"))


def line_features(raw: list[str], every: bool = False) -> tuple[list[Line], np.ndarray, np.ndarray]:
    """The lines, features of each with the lines around it, and which may be furniture.

    Only those with the form of a page number and those that come back may be; unless ``every`` line
    is asked for, the others' features stay 0.
    """
    lines = [Line(x) for x in raw]
    usual = median([len(x.text) for x in lines if x.words > 3] or [1])
    likes = [_like(x.shape) for x in lines]
    repeats = Counter(k for k in likes if len(k) > 3)
    shapes = Counter(x.shape for x in lines if x.text)
    numbered = [(i, x.number) for i, x in enumerate(lines) if x.number is not None and x.page]
    steps = defaultdict(int)
    for (i, a), (j, b) in zip(numbered, numbered[1:]):
        if b - a in (1, 2):
            steps[i] += 1
            steps[j] += 1
    out = np.zeros((len(lines), 15))
    may = np.array([bool(x.text) and len(x.text) < 90 and (x.page or repeats[k] > 1) for x, k in zip(lines, likes)], bool)
    solid = [i for i, x in enumerate(lines) if x.text]
    for k, i in enumerate(solid):
        if not (every or may[i]):
            continue
        x = lines[i]
        before = lines[solid[k - 1]] if k else None
        after = lines[solid[k + 1]] if k + 1 < len(solid) else None
        last = before.text[-1:] if before else "."
        near_page = bool(before and before.page or after and after.page)
        bare = sum(c.isalpha() for c in x.text) < 3
        out[i] = [
            x.page, steps[i], repeats[likes[i]] if len(likes[i]) > 3 else 0, shapes[x.shape] if bare else 0,
            last not in ".:!?", bool(after and after.text[:1].islower()), before is None, after is None,
            i > 0 and not lines[i - 1].text, i + 1 < len(lines) and not lines[i + 1].text,
            len(x.text) / usual, near_page, "\x0c" in raw[i] or (i > 0 and "\x0c" in raw[i - 1]), x.text[-1:] in ".,;", sum(c.isupper() or c.isdigit() for c in x.text) / len(x.text),
        ]
    return lines, out, may


def _furniture_labels(lines: list[Line], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Certain labels of some lines: 1 furniture, 0 text, and which lines have one.

    Furniture: a number that continues another page's, or a line that comes back at least twice, of
    which one interrupts a sentence or stands beside a page number or form feed. Text: lines that
    occur once with no mark of furniture, and repeated lines that always stand in a gap between
    finished sentences.
    """
    y, sure = np.zeros(len(lines)), np.zeros(len(lines), bool)
    groups: dict[str, list[int]] = defaultdict(list)
    for i, line in enumerate(lines):
        if line.text:
            groups[_like(line.shape)].append(i)
    for k, own in groups.items():
        page = x[own, 0] > 0
        if page.all():
            y[own], sure[own] = 1, (x[own, 1] > 0) | (x[own, 11] > 0)
        elif len(own) > 1 and len(k) > 3 and (x[own, 10] < 0.95).all():
            at_break = (x[own, 4] > 0) & (x[own, 5] > 0) | (x[own, 11] > 0) | (x[own, 12] > 0)
            y[own] = float(at_break.any())
            sure[own] = at_break.any() or bool(((x[own, 8] > 0) & (x[own, 9] > 0) & (x[own, 4] == 0)).all())
        elif len(own) == 1:
            sure[own] = True
    return y, sure


def line_classifier(bodies: list[str]) -> Boosted:
    xs, ys = [], []
    for body in bodies:
        lines, x, _ = line_features(body.split("\n"), True)
        y, sure = _furniture_labels(lines, x)
        plain = np.flatnonzero(sure & (y == 0))
        keep = np.concatenate([np.flatnonzero(sure & (y == 1)), plain[:: max(1, len(plain) // 12)]])
        xs.append(x[keep]), ys.append(y[keep])
    x, y = (np.concatenate(xs), np.concatenate(ys)) if xs else (np.empty((0, 15)), np.empty(0))
    if not len(y) or y.min() == y.max():
        x, y = np.concatenate([x, np.eye(15)[:1] * 2, np.zeros((1, 15))]), np.concatenate([y, [1, 0]])
    return Boosted().fit(x, y)


#: White space but for the line end, as strip() and \s know it.
_GAPS = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c != "\n")
_ANY_PAGE = re.compile(_PAGE.pattern.replace("^", f"^[{_GAPS}]*", 1).replace(r"[\s", f"[{_GAPS}").replace(r"\s", f"[{_GAPS}]").replace("$", f"[{_GAPS}]*$"), re.I | re.M)
#: What is left of a line for :func:`_rough`: the letters that neither a digit nor a Roman numeral can stand for.
_ROUGH, _LEFT_OUT = bytes.maketrans(b"b", b"h"), bytes(c for c in range(128) if chr(c) not in "abdfghjkmnpqrstuwyz\n")


def _rough(body: str) -> list[bytes]:
    """A key of each line at least as coarse as :func:`_like`: lines alike by that one have the same key here."""
    return body.lower().replace("ɑ", "a").encode("ascii", "ignore").translate(_ROUGH, _LEFT_OUT).split(b"\n")


def may_have_furniture(body: str) -> bool:
    """False only where :func:`line_features` finds no line that may be furniture: none has the form of a page number and no two are alike.

    Lines are compared by a rough key first and only those that share it by :func:`_like`.
    """
    if "\x0c" in body or _ANY_PAGE.search(body):
        return True
    groups: dict[bytes, list[str]] = defaultdict(list)
    for key, line in zip(_rough(body), body.split("\n")):
        if line.strip():
            groups[key].append(line)
    short: dict[str, bool] = {}
    for own in groups.values():
        if len(own) > 1:
            for x in map(Line, own):
                k = _like(x.shape)
                if len(k) > 3:
                    if k in short and (short[k] or len(x.text) < 90):
                        return True
                    short[k] = short.get(k, False) or len(x.text) < 90
    return False


def furniture(raws: list[list[str]], model: Boosted) -> list[tuple[list[Line], np.ndarray, set[str]]]:
    """For each text its lines, which of them are furniture, and the kinds found: 'page' and 'header'."""
    made = [line_features(raw) for raw in raws]
    scores = model.score(np.concatenate([x[may] for _, x, may in made])) if made else np.empty(0)
    out, at = [], 0
    for lines, _, may in made:
        some = np.flatnonzero(may)
        hit = np.zeros(len(lines), bool)
        hit[some] = scores[at : at + len(some)] > 0.5
        at += len(some)
        kinds = {"page"} if any(hit[i] and lines[i].page for i in some) else set()
        groups = Counter(_like(lines[i].shape) for i in some if hit[i] and not lines[i].page)
        if any(n > 1 for n in groups.values()):
            kinds.add("header")
        out.append((lines, hit, kinds))
    return out


# Words

_EDGE = ".,;:()[]{}<>“”\"'’‘«»?„|…"
_SPLIT = re.compile(r"[-‐‑/–—]+")


@lru_cache(maxsize=300_000)
def chunk_words(chunk: str) -> tuple[str, ...]:
    """The words of a run without white space, lower-cased, with odd characters inside kept."""
    core = chunk.strip(_EDGE).rstrip("!").lower()
    if not core:
        return ()
    if core.endswith(("’s", "'s")):
        core = core[:-2]
    return tuple([w for p in _SPLIT.split(core) if (w := p.strip(_EDGE)) and 2 < len(w) <= 40 and sum(c.isalpha() for c in w) * 2 > len(w)])


def _text_and_breaks(lines: list[str]) -> tuple[list[str], list[tuple[str, str, str, int]]]:
    """Runs without white space of the lines, and the possible broken words (left, mark, right, place).

    Both halves of a possible break are left out of the runs.
    """
    chunks: list[str] = []
    breaks = []
    rest = [x for x in lines if x.strip()]
    skip_first = False
    for i, line in enumerate(rest):
        own = line.replace("\x0c", " ").split()
        if skip_first:
            own = own[1:]
        skip_first = False
        m = _BREAK.search(line)
        if m and i + 1 < len(rest) and (right := re.match(r"\s*([^\W\d_]{1,40})", rest[i + 1])):
            breaks.append((m[1], m[2], right[1], i))
            if own and own[-1].strip() in "-­¬‐‑":
                own = own[:-1]
            own, skip_first = own[:-1], True
        chunks += own
    return chunks, breaks


def _chunks(body: str) -> list[str]:
    """The runs of :func:`_text_and_breaks`, at once where no line ends in a hyphen."""
    return _text_and_breaks(body.split("\n"))[0] if _ANY_BREAK.search(body) else body.split()


def _count(bodies: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Papers per word, of compounds with a hyphen too, by block."""
    n: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    for batch in bodies:
        for body in batch.column(0).to_pylist():
            if body:
                chunks = set(_chunks(body))
                own = set().union(*map(chunk_words, chunks))
                own.update("-".join(w) for c in chunks if "-" in c and len(w := chunk_words(c)) > 1)
                n.update(own)
                if len(n) > _BLOCK:
                    yield out()
                    n.clear()
    if n:
        yield out()


def _gram_size(length: int) -> int:
    return max(3, length // 2)


def grams(word: str, sizes: set[int]) -> set[str]:
    return {word[i : i + q] for q in sizes for i in range(len(word) - q + 1)}


def _keys(asked: bool):
    """Rows (key, word, n): the q-grams of half a word's length; short words with one place left open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words, ns = [], [], []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                m = len(word)
                own = {f"{word[:i]}\x00{word[i + 1:]}" for i in range(m)} if m <= 6 else set()
                if m > 4:
                    own |= grams(word, {_gram_size(m)} if asked else {_gram_size(k) for k in (m - 1, m, m + 1)})
                keys += own
                words += [word] * len(own)
                ns += [n] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(words, pa.string()), pa.array(ns, pa.int64())], ["key", "word", "n"])

    return run


def edits(read: str, true: str) -> list[tuple[str, str]] | None:
    """The replacements (true, read) that lead from one word to the other: one, or two single characters; None if more."""
    if read == true:
        return None
    a = 0
    while a < min(len(read), len(true)) and read[a] == true[a]:
        a += 1
    b = 0
    while b < min(len(read), len(true)) - a and read[-1 - b] == true[-1 - b]:
        b += 1
    x, y = read[a : len(read) - b], true[a : len(true) - b]
    if len(x) <= 2 and len(y) <= 2:
        return [(y, x)]
    if len(read) == len(true):
        own = [(t, r) for r, t in zip(read, true) if r != t]
        return own if len(own) <= 2 else None
    return None


def _kind(op: tuple[str, str]) -> int:
    true, read = op
    if not true or not read:
        return 0  # a letter too many or too few
    if sorted(true) == sorted(read):
        return 1  # transposed
    if len(read) == 2 and len(set(read)) == 1 and read[0] == true:
        return 2  # doubled
    return 3 if len(true) == len(read) else 4


def pair_features(read: str, n: int, true: str, m: int, ops: list[tuple[str, str]], share: dict[tuple[str, str], float]) -> list[float]:
    odd = sum(not c.isalpha() or ord(c) > 0x24F for c in read)
    return [
        min(math.log(share.get(op, 1e-6)) for op in ops), min(_kind(op) for op in ops), len(ops), math.log1p(m) - math.log1p(n), math.log1p(m), len(read), odd,
        sum(len(t) for t, _ in ops) / len(true),
    ]


def _noisy(word: str, rng: np.random.Generator, ops: list[tuple[str, str]], weights: np.ndarray) -> str | None:
    """The word with one or two frequent confusions."""
    for _ in range(1 + int(rng.random() < 0.15)):
        fit = [k for k, (t, _) in enumerate(ops) if t and t in word]
        if not fit:
            return None
        p = weights[fit] / weights[fit].sum()
        t, r = ops[fit[int(rng.choice(len(fit), p=p))]]
        places = [i for i in range(len(word)) if word.startswith(t, i)]
        i = int(rng.choice(places))
        word = word[:i] + r + word[i + len(t) :]
    return word


def _slip(word: str, rng: np.random.Generator) -> str:
    """The word as a typist may get it wrong."""
    i = int(rng.integers(0, len(word) - 1))
    way = int(rng.integers(0, 4))
    letter = chr(97 + int(rng.integers(0, 26)))
    return [word[:i] + word[i + 1] + word[i] + word[i + 2 :], word[:i] + word[i + 1 :], word[:i] + word[i] + word[i:], word[:i] + letter + word[i + 1 :]][way]


def ranking(words: list[tuple[str, int]], share: dict[tuple[str, str], float], seed: int = 3) -> Boosted:
    """A ranking of (read, candidate) pairs, from known words with confusions and slips put into them."""
    rng = np.random.default_rng(seed)
    # systematic confusions change a character for others; slips add, drop, double or transpose
    usual = sorted(((s, op) for op, s in share.items() if _kind(op) in (3, 4) and s >= 0.004), reverse=True)[:40]
    ops, weights = [op for _, op in usual], np.array([s for s, _ in usual])
    by_half: dict[str, list[tuple[str, int]]] = defaultdict(list)
    for w, n in words:
        for k in (w[: len(w) // 2], w[-(len(w) // 2) :]):
            by_half[k].append((w, n))
    x, y = [], []
    for w, n in words:
        for made, good in ((_noisy(w, rng, ops, weights) if ops else None, 1), (_slip(w, rng), 0)):
            if not made or made == w:
                continue
            few = int(rng.integers(1, 1 + max(1, n // OUTNUMBERS)))
            found = edits(made, w)
            if found:
                x.append(pair_features(made, few, w, n, found, share)), y.append(good)
            for other, m in [*by_half.get(made[: len(made) // 2], [])[:4], *by_half.get(made[-(len(made) // 2) :], [])[:4]]:
                if other != w and (found := edits(made, other)):
                    x.append(pair_features(made, few, other, m, found, share)), y.append(0)
    if not x or min(y) == max(y):
        x, y = [*x, [0.0] * 8, [-12.0] * 8], [*y, 1, 0]
    return Boosted().fit(np.array(x), np.array(y))


def known_words(bodies: DataFrame) -> DataFrame:
    """(word, n): every word of the bodies and the number of rows that have it; words never meet a line end here."""
    return bodies.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _word_sample(words: DataFrame) -> list:
    """``SAMPLE_WORDS`` rows of a table of words, those of the lowest hash."""
    return hashed_sample(words, words.count(), SAMPLE_WORDS, "word")


def misread_words(words: DataFrame, total: int) -> DataFrame:
    """(word, better): words with misrecognised characters and what they were.

    Candidates are known words that share a q-gram of half the word's length and are at least
    ``OUTNUMBERS`` times as frequent. A word with a sign that no known word has needs no known
    candidate: the most usual confusions of the sign are undone.
    """
    plain = F.col("word").rlike(r"^\p{L}+$") & ~F.col("word").rlike("[ɐ-ʯ]")
    known = words.where(plain & (F.col("n") >= KNOWN))
    asking = words.where(~F.col("word").contains("-") & (F.col("n") * OUTNUMBERS <= total))
    asked = asking.mapInArrow(_keys(True), "key string, word string, n long")
    index = known.mapInArrow(_keys(False), "key string, word string, n long").select("key", F.col("word").alias("better"), F.col("n").alias("m"))
    near = (F.abs(F.length("word") - F.length("better")) <= 1) & (F.col("m") >= F.col("n") * OUTNUMBERS)
    pairs = asked.join(by_shuffle(index), "key").where(near & (F.col("word") != F.col("better"))).select("word", "n", "better", "m").distinct()

    def with_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ops = [], []
            for i, (read, true) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                if own := edits(read, true):
                    rows.append(i), ops.append(["\x00".join(op) for op in own])
            taken = batch.take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(ops, pa.list_(pa.string()))], ["word", "n", "better", "m", "ops"])

    pairs = cut(pairs.mapInArrow(with_edits, "word string, n long, better string, m long, ops array<string>"))
    single = pairs.where(F.size("ops") == 1).select("word", F.get("ops", F.lit(0)).alias("op")).distinct()
    counts = first_rows(single.groupBy("op").count().orderBy(F.desc("count"), "op"), CONFUSIONS)
    all_ops = sum(r["count"] for r in counts) or 1
    share = {tuple(r["op"].split("\x00")): r["count"] / all_ops for r in counts}
    sample = _word_sample(known.where(F.length("word") >= 5))
    model = ranking([(r["word"], r["n"]) for r in sample], share)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(5))))
            x = [pair_features(w, n, b, m, [tuple(o.split("\x00")) for o in ops], share) for w, n, b, m, ops in rows]
            score = model.score(np.array(x).reshape(-1, 8))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score, pa.float64())], ["word", "better", "score"])

    scored = pairs.mapInArrow(ranked, "word string, better string, score double")
    best = scored.groupBy("word").agg(F.max_by("better", F.struct("score", "better")).alias("better"), F.max("score").alias("score")).where("score > 0.5").select("word", "better")

    signs: dict[str, str] = {}
    for (true, read), s in sorted(share.items(), key=lambda x: x[1]):
        if s >= 0.004 and len(read) == 1 and len(true) == 1 and (not read.isalpha() or 0x250 <= ord(read) <= 0x2AF) and true.isalpha():
            signs[read] = true  # the most frequent last
    if not signs:
        return best

    def undone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = str.maketrans(signs)
        for batch in batches:
            out = []
            for w in batch.column(0).to_pylist():
                odd = sum(c in signs for c in w[1:-1])
                now = w.translate(table)
                if len(w) >= 6 and 1 <= odd <= 2 and now.isalpha() and w[0].isalpha():
                    out.append((w, now))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.string())], ["word", "better"])

    odd = asking.select("word").where(~F.col("word").rlike(r"^[\p{L}]+$") | F.col("word").rlike("[ɐ-ʯ]"))
    rest = odd.join(by_shuffle(best.select("word")), "word", "left_anti").mapInArrow(undone, "word string, better string")
    return best.unionByName(rest)


# Broken words


def break_features(left: str, right: str, mark: str, whole: int, compound: int, a: int, b: int) -> list[float]:
    return [math.log1p(whole), math.log1p(compound), math.log1p(min(a, b)), math.log1p(max(a, b)), min(len(left), len(right)), mark in "-‐‑", right[:1].isupper(), math.log1p(whole) - math.log1p(compound)]


def join_classifier(whole: list[tuple[str, int]], compounds: list[tuple[str, int]], counts: dict[str, int], seed: int = 4) -> Boosted:
    """Tells a broken word from a compound at a line end: known words cut anywhere against known compounds.

    ``counts`` has the papers of the words that the halves may be.
    """
    rng = np.random.default_rng(seed)
    x, y = [], []
    for w, n in whole:
        i = int(rng.integers(2, len(w) - 1))
        left, right = w[:i], w[i:]
        seen = n if rng.random() < 0.5 else 0  # half of them as if they stood nowhere else
        x.append(break_features(left, right, "-­¬‐"[int(rng.integers(0, 4))], seen, 0, counts.get(left, 0), counts.get(right, 0))), y.append(1)
    for c, n in compounds:
        left, right = c.split("-")[:2]
        x.append(break_features(left, right, "-‐"[int(rng.integers(0, 2))], counts.get(left + right, 0), n, counts.get(left, 0), counts.get(right, 0))), y.append(0)
    if not x or min(y) == max(y):
        x, y = [*x, [5.0, 0, 0, 0, 3, 0, 0, 5.0], [0.0, 5.0, 5.0, 5.0, 3, 1, 0, -5.0]], [*y, 1, 0]
    return Boosted().fit(np.array(x), np.array(y))


def _judged_lines(model: Boosted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            papers, bodies = (batch.column(i).to_pylist() for i in range(2))
            some = [i for i, body in enumerate(bodies) if body and may_have_furniture(body)]
            judged = dict(zip(some, furniture([bodies[i].split("\n") for i in some], model)))
            for i, (paper, body) in enumerate(zip(papers, bodies)):
                if i in judged:
                    out += [(paper, k, None, None, None) for k in judged[i][2]]
                if body and _ANY_BREAK.search(body):
                    rest = body.split("\n")
                    if i in judged:
                        rest = [x for x, h in zip(rest, judged[i][1]) if not h]
                    out += [(paper, "break", l.lower(), m, r.lower() if not r[:1].isupper() or l.isupper() else r) for l, m, r, _ in _text_and_breaks(rest)[1]]
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], ["paper_id", "kind", "left", "mark", "right"])

    return run


def _misread_in(words: set[str] | None):
    """(paper_id, word, times) of the words of a body, all of them or those of a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            papers, found, times = [], [], []
            for paper, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if body:
                    own: Counter[str] = Counter()
                    for chunk in _chunks(body):
                        hits = memo.get(chunk)
                        if hits is None:
                            if len(memo) > _BLOCK:
                                memo.clear()
                            hits = memo[chunk] = tuple(w for w in chunk_words(chunk) if words is None or w in words)
                        if hits:
                            own.update(hits)
                    papers += [paper] * len(own)
                    found += own.keys()
                    times += own.values()
            yield pa.RecordBatch.from_arrays([pa.array(papers, pa.string()), pa.array(found, pa.string()), pa.array(times, pa.int64())], ["paper_id", "word", "times"])

    return run


def _trained(papers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, Boosted]:
    """(paper_id, body), the words with their papers, the misread ones, and the line classifier."""
    bodies = papers.select("paper_id", F.col("body").cast("string").alias("body")).where(F.col("paper_id").isNotNull() & (F.length("body") > 0))
    words = cut(known_words(bodies.select("body")))
    total = bodies.count()
    # rows are chosen by their id, and their texts shortened, in the scan
    sample = hashed_sample(bodies.select("paper_id", F.substring("body", 1, SAMPLE_CHARACTERS).alias("body")), total, SAMPLE_BODIES, "paper_id")
    return bodies, words, cut(misread_words(words, total)), line_classifier([r["body"] for r in sample])


def _breaks(found: DataFrame, words: DataFrame) -> DataFrame:
    """The distinct possible breaks (left, mark, right) that broke a word which isn't a compound."""
    events = found.where("kind = 'break'").select("left", "mark", "right").distinct()
    asked = events.withColumn("x", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), w.alias("word")) for i, w in enumerate((F.lower(F.concat("left", "right")), F.lower(F.concat_ws("-", "left", "right")), F.col("left"), F.lower("right")))])))
    counted = asked.select("left", "mark", "right", F.col("x.i").alias("i"), F.col("x.word").alias("word")).join(by_shuffle(words), "word", "left").na.fill(0, ["n"])
    wide = counted.groupBy("left", "mark", "right").agg(*[F.max(F.when(F.col("i") == i, F.col("n"))).alias(f"n{i}") for i in range(4)])
    sample = _word_sample(words.where((F.col("n") >= KNOWN) & (F.length("word") >= 5) & F.col("word").rlike(r"^\p{L}+$")))
    hyphened = _word_sample(words.where((F.col("n") >= 2) & F.col("word").rlike(r"^\p{L}+-\p{L}")))
    halves = sorted({h for r in hyphened for h in r["word"].split("-")})
    asked = words.sparkSession.createDataFrame([(h,) for h in halves or [""]], "word string")
    counts = {r["word"]: r["n"] for r in [*words.join(F.broadcast(asked), "word").collect(), *sample]}  # the halves of the sample
    model = join_classifier([(r["word"], r["n"]) for r in sample], [(r["word"], r["n"]) for r in hyphened], counts)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(7))))
            x = np.array([break_features(l, r, m, *ns) for l, m, r, *ns in rows]).reshape(-1, 8)
            keep = pa.array(np.flatnonzero(model.score(x) > 0.5))
            yield pa.RecordBatch.from_arrays([batch.column(i).take(keep) for i in range(3)], ["left", "mark", "right"])

    return wide.mapInArrow(judged, "left string, mark string, right string")


def _occurrences(bodies: DataFrame, misread: DataFrame) -> DataFrame:
    """(paper_id, word, times, better) of the misread words in every body."""
    if misread.count() <= BROADCAST_WORDS:
        spark = bodies.sparkSession
        known = spark.sparkContext.broadcast({r["word"] for r in misread.select("word").collect()})  # at most BROADCAST_WORDS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _misread_in(known.value)(batches)

        found = bodies.mapInArrow(run, "paper_id string, word string, times long")
    else:
        found = bodies.mapInArrow(_misread_in(None), "paper_id string, word string, times long")
    return found.join(by_shuffle(misread), "word")


def noise(papers: DataFrame) -> DataFrame:
    """(paper_id, kind): one row per kind of scanning noise in a paper's body.

    'hyphen': a word broken at a line end that isn't a compound. 'page': a page number on a line of
    its own. 'header': a running header printed at least twice. 'misread': at least two words with
    misrecognised characters. Null and empty bodies and rows without paper_id have none; repeated rows
    count once. The whole body is read.
    """
    bodies, words, misread, lines = _trained(papers)
    found = cut(bodies.mapInArrow(_judged_lines(lines), "paper_id string, kind string, left string, mark string, right string"))
    broken = found.where("kind = 'break'").join(by_shuffle(_breaks(found, words)), ["left", "mark", "right"]).select("paper_id", F.lit("hyphen").alias("kind"))
    furniture = found.where("kind <> 'break'").select("paper_id", "kind")
    read = _occurrences(bodies, misread).groupBy("paper_id", "word").agg(F.max("times").alias("times")).groupBy("paper_id").agg(F.sum("times").alias("n"))
    wrong = read.where("n >= 2").select("paper_id", F.lit("misread").alias("kind"))
    return furniture.unionByName(broken).unionByName(wrong).distinct()


def _repaired(model: Boosted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, texts = batch.column(1).to_pylist(), []
            some = [i for i, body in enumerate(bodies) if body and may_have_furniture(body)]
            off = {i: hit for i, (_, hit, _) in zip(some, furniture([bodies[i].split("\n") for i in some], model))}
            for i, (body, fixes, breaks) in enumerate(zip(bodies, *(batch.column(i).to_pylist() for i in (2, 3)))):
                if not body:
                    texts.append(body)
                    continue
                better = {f["word"]: f["better"] for f in fixes or []}
                broken = {(b["left"], b["mark"], b["right"].lower()) for b in breaks or []}
                texts.append(paragraphs(body, off.get(i), better, broken))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(4)], ["paper_id", "text", "kinds"])

    return run


def _cased(new: str, old: str) -> str:
    letters = [c for c in old if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return new.upper()
    return new[:1].upper() + new[1:] if old[:1].isupper() or (not old[:1].isalpha() and letters and letters[0].isupper()) else new


def paragraphs(body: str, off: np.ndarray | None, better: dict[str, str], broken: set[tuple[str, str, str]]) -> str:
    """The body without the lines that are ``off`` as furniture, lines joined to paragraphs, broken words mended and misread words replaced.

    A paragraph ends at an empty or indented line and where a line is shorter than three quarters of
    the usual one after the end of a sentence; furniture between two lines of a sentence leaves no gap.
    """
    raw = body.split("\n")
    stripped = [x.replace("\x0c", "").strip() for x in raw]
    usual = median([len(x) for x in stripped if x.count(" ") > 2] or [1])
    parts: list[list[str]] = [[]]
    gap = False
    for text, furnished in zip(raw, off if off is not None else [False] * len(raw)):
        if furnished:
            continue
        text = text.replace("\x0c", "")
        if not text.strip():
            gap = True
            continue
        last = parts[-1][-1] if parts[-1] else ""
        ended = last[-1:] in ".:!?"
        if last and (gap and (ended or len(last) < 0.75 * usual) or text[:2] == "  " and ended or ended and len(last) < 0.75 * usual):
            parts.append([])
        gap = False
        parts[-1].append(text.strip())
    out = []
    for own in parts:
        joined = ""
        for text in own:
            m = _BREAK.search(joined)
            right = re.match(r"[^\W\d_]{1,40}", text)
            if m and right:
                whole = (m[1].lower(), m[2], right[0].lower()) in broken
                joined = joined[: m.end(1)] + ("" if whole else "-") + text
            else:
                joined += (" " if joined else "") + text
        if better:
            joined = re.sub(r"[^\s\-‐‑/–—]+", lambda m: _mended(m[0], better), joined)
        out.append(joined)
    return "\n\n".join(x for x in out if x)


def _mended(chunk: str, better: dict[str, str]) -> str:
    words = chunk_words(chunk)
    if len(words) == 1 and words[0] in better and (at := chunk.lower().find(words[0])) >= 0:
        old = chunk[at : at + len(words[0])]
        return chunk[:at] + _cased(better[words[0]], old) + chunk[at + len(words[0]) :]
    return chunk


def repaired(papers: DataFrame) -> DataFrame:
    """(paper_id, text, kinds): every body as continuous paragraphs, and the kinds of noise it had, joined by commas.

    One row per paper_id, that of its first harvest; null and empty bodies stay as they are and have
    no kinds. Rows without a paper_id are left out.
    """
    bodies, words, misread, lines = _trained(papers)
    found = cut(bodies.mapInArrow(_judged_lines(lines), "paper_id string, kind string, left string, mark string, right string"))
    broken = cut(found.where("kind = 'break'").join(by_shuffle(_breaks(found, words)), ["left", "mark", "right"]))
    read = cut(_occurrences(bodies, misread))
    # the lists of one paper
    fixes = read.select("paper_id", "word", "better").distinct().groupBy("paper_id").agg(F.collect_list(F.struct("word", "better")).alias("fixes"))
    breaks = broken.distinct().groupBy("paper_id").agg(F.collect_list(F.struct("left", "mark", "right")).alias("breaks"))
    counted = read.groupBy("paper_id", "word").agg(F.max("times").alias("times")).groupBy("paper_id").agg(F.sum("times").alias("n")).where("n >= 2")
    kinds = found.where("kind <> 'break'").select("paper_id", "kind").unionByName(broken.select("paper_id", F.lit("hyphen").alias("kind"))).unionByName(counted.select("paper_id", F.lit("misread").alias("kind")))
    kinds = kinds.groupBy("paper_id").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))
    # what is known of a paper is joined once; papers without any noise have no row here
    known = cut(fixes.join(by_shuffle(breaks), "paper_id", "full").join(by_shuffle(kinds), "paper_id", "full"))
    entries = known.agg(F.sum(1 + F.coalesce(F.size("fixes"), F.lit(0)) + F.coalesce(F.size("breaks"), F.lit(0)))).first()[0] or 0
    whole = one_per_paper(papers, F.col("body").cast("string")).withColumnRenamed("v0", "body")
    joined = whole.join(F.broadcast(known) if entries <= BROADCAST_WORDS else by_shuffle(known), "paper_id", "left")
    return joined.select("paper_id", "body", "fixes", "breaks", F.coalesce("kinds", F.lit("")).alias("kinds")).mapInArrow(_repaired(lines), "paper_id string, text string, kinds string")

