"""Texts that were decoded with a wrong character set: which, and what they said before.

Minimum description length: a text and every text it may have been are compressed with zstandard
dictionaries of each language, and the chain of decodings with the shortest result, its own cost
included, wins; otherwise the text stays as it is. Chains are judged as a whole, so a step that
gains nothing by itself may lead to one that does. Places that a chain leaves as they are cost the
same before and after, so only the changed places and what is around them are compressed.
"""

from __future__ import annotations

import codecs
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, spread

#: Character sets that texts were read in by mistake, and those they were written in, by their codec names.
READ_AS = ["latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "cp437", "cp850", "cp852", "cp866", "koi8-r", "mac_roman", "mac_cyrillic", "iso8859-2", "iso8859-5", "iso8859-7", "gbk"]
WRITTEN_IN = ["cp1252", "cp1250", "cp1251", "cp1253", "cp437", "cp850", "cp852", "cp866", "koi8-r", "mac_roman", "mac_cyrillic", "iso8859-2", "iso8859-5", "iso8859-7"]
#: Bytes of a language's dictionary, and words that are taken to fill it.
DICTIONARY_BYTES = 48 << 10
MOST_WORDS = DICTIONARY_BYTES // 3
#: Share of a language's texts that must have a pair or character for it to count as seen: by the first judge, and by the second.
FIRST_SHARE, SHARE = 0.03, 1 / 400
#: Different pairs, characters and words that are counted together before they are given on.
HELD = 200_000
#: Characters of context on either side of a change that are compressed with it.
CONTEXT = 24
LEVEL = 6
#: Bytes that a character no language's samples have costs besides its own.
NEW_CHARACTER = 3
#: Mistakes in a row that are undone at most, readings that are followed further at each of them, and decodings of single-byte sets kept of each reading.
STEPS, BEAM, KEPT = 3, 6, 2
#: Bytes that no compressed text is below.
FRAME = 6

_HIGH = re.compile(r"[^\x00-\x7f]+")
_SENTENCE = re.compile(r"[^.;?!\n]*(?:[.;?!\n]+|$)")
_LOST = re.compile("�")


def _tables(name: str) -> tuple[dict[str, int], list[str]]:
    """Character to byte and byte to character; bytes the set leaves open stand for C1 controls, as browsers read them."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(b))
    back = {c: b for b, c in reversed(list(enumerate(chars)))}
    return back, chars


_SINGLE = {name: _tables(name) for name in {*READ_AS, *WRITTEN_IN} - {"gbk"}}


def encoded(text: str, name: str) -> bytes | None:
    if name == "gbk":
        try:
            return codecs.encode(text, "gbk")
        except UnicodeEncodeError:
            return None
    back = _SINGLE[name][0]
    try:
        return bytes([back[c] for c in text])
    except KeyError:
        return None


def _may_be_utf8(run: str, read_as: str) -> bool:
    """Whether the first two bytes of a run in that set can begin a character in UTF-8."""
    if read_as == "gbk":
        return run[0] >= "\u2000"
    back = _SINGLE[read_as][0]
    return len(run) > 1 and 0xC2 <= back.get(run[0], 0) <= 0xF4 and 0x80 <= back.get(run[1], 0) <= 0xBF


def _utf8_readings(run: str) -> tuple[tuple[str, str], ...]:
    """The sets in which a run of non-ASCII characters is other valid UTF-8, and what it is then."""
    out = []
    for name in READ_AS:
        if _may_be_utf8(run, name) and (raw := encoded(run, name)) is not None and len(raw) > 1:
            try:
                now = raw.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if now != run:
                out.append((name, now))
    return tuple(out)


_kept_readings = lru_cache(maxsize=100_000)(_utf8_readings)


def utf8_readings(text: str) -> Iterator[tuple[str, str]]:
    """For each set in which some runs are valid UTF-8: its name, and the text with them decoded."""
    found: dict[str, list[tuple[int, int, str]]] = {}
    for m in _HIGH.finditer(text):
        for name, now in (_kept_readings if len(m[0]) <= 64 else _utf8_readings)(m[0]):
            found.setdefault(name, []).append((m.start(), m.end(), now))
    for name in READ_AS:
        if name in found:
            out, done = [], 0
            for start, end, now in found[name]:
                out += [text[done:start], now]
                done = end
            yield name, "".join([*out, text[done:]])


def as_set(text: str, spans: list[tuple[int, int]], read_as: str, written_in: str) -> str:
    """The text with the spans, all of whose characters are in the set they were read in, as they are in another."""
    back, chars = _SINGLE[read_as][0], _SINGLE[written_in][1]
    out, done = [], 0
    for start, end in spans:
        out += [text[done:start], "".join([c if c < "\x80" else chars[back[c]] for c in text[start:end]])]
        done = end
    return "".join([*out, text[done:]])


def _pairs(text: str) -> list[str]:
    """Neighbouring characters of which one at least isn't ASCII."""
    return [text[i : i + 2] for m in _HIGH.finditer(text) for i in range(max(0, m.start() - 1), min(m.end(), len(text) - 1))]


def _parts(text: str) -> Iterator[tuple[str, set[str]]]:
    """What is learnt from a text, once each: pairs, characters and words."""
    if not text.isascii():
        yield "pair", set(_pairs(text))
        yield "character", set("".join(_HIGH.findall(text)))
    yield "word", set(text.split())


def _dictionary(words: list[tuple[str, int]]) -> bytes:
    """The words (word, texts that have it), each with a space before it, that save most, the best last, where they are nearest."""
    raw = sorted(((n * (len(x) - 2), x) for x, n in ((b" " + w.encode("utf-8", "replace"), n) for w, n in words)), reverse=True)
    out, size = [], 0
    for _, x in raw:
        if size + len(x) <= DICTIONARY_BYTES:
            out.append(x)
            size += len(x)
    return b"".join(reversed(out))


class Judge:
    """Dictionaries and seen character pairs of each language, from clean texts."""

    def __init__(self, samples: dict[str, list[str]], share: float = 0.0):
        """``share`` of a language's texts must have a pair or character for it to count as seen."""
        self.samples, self.share = samples, share

    @classmethod
    def of(cls, pairs: frozenset[str], alphabet: frozenset[str], contents: list[bytes]) -> Judge:
        """One that learnt from counts taken elsewhere."""
        made = cls({})
        made.pairs, made.alphabet, made.contents = pairs, alphabet, contents
        return made

    def __getstate__(self) -> dict:
        """What was learnt, without the texts it was learnt from."""
        return {"samples": {}, "share": self.share} | {k: getattr(self, k) for k in ("pairs", "alphabet", "contents", "_tables")}

    @cached_property
    def _counted(self) -> dict[str, Counter]:
        return {lang: Counter((kind, x) for t in texts for kind, own in _parts(t) for x in own) for lang, texts in sorted(self.samples.items())}

    def _seen(self, kind: str) -> frozenset[str]:
        return frozenset(x for lang, counts in self._counted.items() for (k, x), n in counts.items() if k == kind and n > max(1, self.share * len(self.samples[lang])))

    @cached_property
    def pairs(self) -> frozenset[str]:
        return self._seen("pair")

    @cached_property
    def alphabet(self) -> frozenset[str]:
        return self._seen("character")

    @cached_property
    def contents(self) -> list[bytes]:
        """The dictionary of each language."""
        return [_dictionary([(x, n) for (k, x), n in counts.items() if k == "word"]) for counts in self._counted.values()]

    @cached_property
    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for content in self.contents:
            # As raw content: the entropy tables of a trained dictionary make short texts with a byte it lacks much longer.
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out or [zstandard.ZstdCompressor(level=LEVEL)]

    def size(self, text: str) -> int:
        """Bytes of the text under the language that says it shortest; a character that none has costs more."""
        raw = text.encode("utf-8", "replace")
        new = sum(c not in self.alphabet for run in _HIGH.findall(text) for c in run)
        return min(len(c.compress(raw)) for c in self.compressors) + NEW_CHARACTER * new

    def _usual(self, run: str) -> bool:
        """Whether some language has every pair of a run, which has the ASCII characters beside it."""
        memo = self.__dict__.setdefault("_runs", {})
        if (known := memo.get(run)) is None:
            if len(memo) > 100_000:
                memo.clear()
            known = memo[run] = self.pairs.issuperset(_pairs(run))
        return known

    def doubts(self, text: str) -> bool:
        """Whether it would change the text or finds a part of it strange."""
        return bool(not text.isascii() and (self.strange_spans(text) or self.restored(text)[1]))

    def strange_spans(self, text: str) -> list[tuple[int, int]]:
        """Sentences most of whose pairs with a non-ASCII character no language has; neighbours are joined."""
        spans: list[tuple[int, int]] = []
        if all(self._usual(text[max(0, m.start() - 1) : m.end() + 1]) for m in _HIGH.finditer(text)):
            return spans
        for m in _SENTENCE.finditer(text):
            own = _pairs(m[0])
            if len(own) >= 2 and sum(p not in self.pairs for p in own) > 0.4 * len(own):
                if spans and spans[-1][1] == m.start():
                    spans[-1] = (spans[-1][0], m.end())
                else:
                    spans.append((m.start(), m.end()))
        return spans

    @cached_property
    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        """For each set texts were written in: which pairs of bytes are pairs no language has, and which bytes are characters none has."""
        strange, new = np.zeros((len(WRITTEN_IN), 1 << 16), bool), np.zeros((len(WRITTEN_IN), 256), bool)
        for k, name in enumerate(WRITTEN_IN):
            back, chars = _SINGLE[name]
            new[k] = [b >= 128 and c not in self.alphabet for b, c in enumerate(chars)]
            high = np.arange(256) >= 128
            own = high[:, None] | high[None, :]
            for pair in self.pairs:
                if pair[0] in back and pair[1] in back:
                    own[back[pair[0]], back[pair[1]]] = False
            strange[k] = own.ravel()
        return strange, new

    def _single_byte(self, text: str) -> list[tuple[str, str]]:
        """The text as it may have been in other single-byte sets, with the names of the sets: the ``KEPT`` that say it shortest.

        Taken are those that leave less than half of its strange pairs: another set that explains fewer
        is no explanation, however short. They are compressed but for those whose new characters alone
        cost more than the best so far.
        """
        spans = self.strange_spans(text)
        if not spans:
            return []
        was = "\n".join(text[a:b] for a, b in spans)
        high = set("".join(_HIGH.findall(was)))
        before = sum(p not in self.pairs for p in _pairs(was))
        strange, new = self._tables
        options = []
        for name in READ_AS:
            if name == "gbk" or not high <= _SINGLE[name][0].keys():
                continue
            back = _SINGLE[name][0]
            raw = np.frombuffer(was.translate({ord(c): chr(back[c]) for c in high}).encode("latin-1"), np.uint8).astype(np.int64)
            pairs, times = np.unique(raw[:-1] << 8 | raw[1:], return_counts=True)
            counts = np.bincount(raw, minlength=256)
            for k, (odd, unknown) in enumerate(zip(strange[:, pairs] @ times, new @ counts)):
                if WRITTEN_IN[k] != name and 2 * odd < before:
                    options.append((int(unknown), int(odd), len(options), name, WRITTEN_IN[k]))
        sizes: dict[str, float] = {}
        names: dict[str, tuple[str, str]] = {}
        best = math.inf
        for unknown, _, _, name, other in sorted(options):
            if NEW_CHARACTER * unknown + FRAME >= best:
                break  # all that follow have as many new characters
            back, chars = _SINGLE[name][0], _SINGLE[other][1]
            now = was.translate({ord(c): chars[back[c]] for c in high})
            if now != was and now not in sizes:
                sizes[now] = self.size(now)
                names[now] = name, other
                best = min(best, sizes[now])
        return [(as_set(text, spans, *names[now]), "{1} as {0}".format(*names[now])) for now in sorted(sizes, key=lambda x: sizes[x])[:KEPT]]

    def _steps(self, text: str) -> Iterator[tuple[str, str, float]]:
        """Every text that this one may have been before one mistake, the name of the mistake and its cost in bytes."""
        for name, now in utf8_readings(text):
            yield now, f"utf-8 as {name}", math.log2(len(READ_AS)) / 8
        for now, name in self._single_byte(text):
            yield now, name, 2 + math.log2(len(READ_AS) * len(WRITTEN_IN)) / 8

    def restored(self, text: str) -> tuple[str, list[str]]:
        """The text it was, and the chain of up to ``STEPS`` decodings that undoes the damage, empty if none is shorter."""
        best: tuple[float, str, list[str]] = (0.0, text, [])
        seen, frontier = {text}, [(text, [], 0.0)]
        for _ in range(STEPS):
            reached = []
            for now, chain, cost in frontier:
                for after, name, price in self._steps(now):
                    if after not in seen:
                        seen.add(after)
                        reached.append((self._gain(text, after) - cost - price, after, [*chain, name], cost + price))
            reached.sort(key=lambda x: -x[0])
            if reached and reached[0][0] > best[0]:
                best = reached[0][:3]
            frontier = [x[1:] for x in reached[:BEAM]]
            if not frontier:
                break
        return best[1], best[2]

    def _gain(self, was: str, now: str) -> int:
        """Bytes saved on the changed places with their surroundings. Decodings keep ASCII as it is, so the runs between correspond."""
        changes = [(x.start(), x.end(), y.start(), y.end()) for x, y in zip(_HIGH.finditer(was), _HIGH.finditer(now)) if x[0] != y[0]]
        a, b, i = [], [], 0
        while i < len(changes):
            first = last = changes[i]
            while i + 1 < len(changes) and changes[i + 1][0] - last[1] <= 2 * CONTEXT:
                i, last = i + 1, changes[i + 1]
            a.append(was[max(0, first[0] - CONTEXT) : last[1] + CONTEXT])
            b.append(now[max(0, first[2] - CONTEXT) : last[3] + CONTEXT])
            i += 1
        return self.size("\n".join(a)) - self.size("\n".join(b))


def _plainly_damaged(text: str) -> bool:
    return shows_loss(text) or any(name in READ_AS[:2] for name, *_ in utf8_readings(text))


def clean_judge(samples: dict[str, list[str]]) -> Judge:
    """A judge trained twice: the second time without the texts the first one would change."""
    samples = {k: [t for t in texts if not _plainly_damaged(t)] for k, texts in samples.items()}
    first = Judge(samples, FIRST_SHARE)
    return Judge({k: [t for t in texts if not first.doubts(t)] for k, texts in samples.items()}, SHARE)


def _counting(first: Broadcast | None):
    """(lang, kind, item, n): how many texts of a language have each pair, character and word, and, of kind 'text', how many there are.

    With a first judge, those of the texts it has doubts about, as negative numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def out():
            names, items, n = [], [], []
            for name, own in counts.items():
                names += [name] * len(own)
                items += own.keys()
                n += own.values()
            counts.clear()
            return pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in names], pa.string()) for i in (0, 1)), pa.array(items, pa.string()), pa.array([sign * x for x in n], pa.int64())], ["lang", "kind", "item", "n"])

        sign = 1 if first is None else -1
        for batch in batches:
            for i, (lang, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if not text.isascii() and _plainly_damaged(text) or first is not None and (text.isascii() or not first.value.doubts(text)):
                    continue
                for kind, own in (("text", ("",)), *_parts(text)):
                    counts[lang, kind].update(own)
                if i % 64 == 0 and sum(map(len, counts.values())) >= HELD:
                    yield out()
        if counts:
            yield out()

    return run


def _judge_of(counts: DataFrame, share: float) -> Judge:
    """A judge from counts (lang, kind, item, n): the seen pairs and characters and the words of each dictionary reach the driver."""
    totals = counts.where(F.col("kind") == "text").select("lang", F.col("n").alias("texts"))
    known = counts.where(F.col("kind").isin("pair", "character")).join(F.broadcast(totals), "lang")  # a row per label
    seen = known.where(F.col("n") > F.greatest(F.lit(1.0), F.col("texts") * share)).select("kind", "item").distinct().collect()
    saved = F.col("n") * (F.octet_length("item") - 1)  # its space besides
    words = counts.where(F.col("kind") == "word").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc(saved), F.desc("item"))))
    by: dict[str, list[tuple[str, int]]] = defaultdict(list)
    for r in words.where(F.col("r") <= MOST_WORDS).select("lang", "item", "n").collect():
        by[r["lang"]].append((r["item"], r["n"]))
    return Judge.of(*(frozenset(r["item"] for r in seen if r["kind"] == kind) for kind in ("pair", "character")), [_dictionary(by[lang]) for lang in sorted(by)])


def learnt(documents: DataFrame) -> Judge:
    """What :func:`clean_judge` makes, of every labelled text: texts are counted where they lie, whole, and only counts are moved.

    A second scan takes off what the texts the first judge has doubts about had given.
    """
    rows = spread(documents.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull()), "text")
    kind = "lang string, kind string, item string, n long"

    def summed(counts: DataFrame) -> DataFrame:
        return cut(counts.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")).where(F.col("n") > 0))

    every = summed(rows.mapInArrow(_counting(None), kind))
    first = documents.sparkSession.sparkContext.broadcast(_judge_of(every, FIRST_SHARE))
    return _judge_of(summed(every.unionByName(rows.mapInArrow(_counting(first), kind))), SHARE)


def repaired(documents: DataFrame) -> DataFrame:
    """(doc_id, garbled, reason, chain, restored) of every row of ``documents``.

    ``garbled``: the text, wholly or in part, shows a wrong decoding. ``reason`` says by what: 'chain'
    if a chain of decodings makes it shorter, 'loss' if it has characters that only a wrong decoding
    leaves, 'chain and loss' if both, null if neither. ``chain`` names the decodings
    undone, the last mistake first, as 'written in as read'; empty where nothing could be restored.
    ``restored`` is the text with them undone, otherwise the text as it is. Replacement characters
    mark a loss that can't be undone. ASCII, null, empty and blank texts are never garbled. The
    dictionaries and seen pairs are learnt from every labelled row; every whole text is judged. Counts
    are shuffled, texts only for an input of fewer splits than cores.
    """
    context = documents.sparkSession.sparkContext
    judge = context.broadcast(learnt(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = judge.value
        for batch in batches:
            reasons, chains, texts = [], [], []
            for text in batch.column(1).to_pylist():
                now, chain = own.restored(text) if text and not text.isascii() else (text, [])
                reasons.append(REASONS[bool(chain), bool(text) and shows_loss(text)])
                chains.append(chain)
                texts.append(now)
            garbled = pa.array([r is not None for r in reasons], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), garbled, pa.array(reasons, pa.string()), pa.array(chains, pa.list_(pa.string())), pa.array(texts, pa.string())], ["doc_id", "garbled", "reason", "chain", "restored"])

    rows = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id")
    return rows.mapInArrow(run, "doc_id long, garbled boolean, reason string, chain array<string>, restored string")


REASONS = {(True, True): "chain and loss", (True, False): "chain", (False, True): "loss", (False, False): None}
_CONTROLS = re.compile("[\x80-\x84\x86-\x9f]")


def shows_loss(text: str) -> bool:
    """Replacement characters, or C1 controls, which no text has but by a wrong decoding."""
    return bool(_LOST.search(text) or _CONTROLS.search(text))
