"""Which typed names mean the same person or organisation.

Suffix blocking: every token of a name and every suffix of it from ``SHORTEST`` letters on is a
block. A suffix that too many names have is refined with other fields of the name, and blocks that
stay full are compared in tiles, so none is dropped. Names that share a block are compared by the
ratio of their longest common subsequence, part by part.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import by_shuffle, cut
from .links import components, pairs_within, tiles

SHORTEST = 4
#: Names a block may hold before its suffix is refined.
COMMON = 64
SURNAME_RATIO, GIVEN_RATIO = 0.84, 0.74
#: Different proper words beside which a word must stand to tell no organisation from another.
COMPANIONS = 3

#: Words around a name that don't belong to it.
TITLES = frozenset("dr prof professor mr mrs ms sir dame phd md msc bsc dphil jr sr ii iii".split())
#: Small words in front of a family name.
PARTICLES = frozenset("van von der den de del della di da dos du la le al el bin ibn ten ter zu zur af av".split())
#: Words only an organisation has in its name, with their short forms.
ORGANISATION_WORDS = {
    "collaboration": ["collab"], "consortium": ["cons"], "team": [], "group": ["grp"], "observatory": ["obs"], "survey": [], "archive": [], "institute": ["inst"],
    "university": ["univ"], "laboratory": ["lab"], "society": ["soc"], "department": ["dept"], "project": ["proj"], "network": [], "alliance": [], "association": ["assoc"],
    "committee": [], "council": [], "centre": ["center", "ctr"], "foundation": [], "academy": ["acad"], "agency": [], "initiative": [], "corpus": [], "beamline": [],
}
_LONG = {short: word for word, shorts in ORGANISATION_WORDS.items() for short in [word, *shorts]}
_APART = {"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th", "ð": "d"}
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def folded(text: str) -> str:
    """Lower case without marks; letters with a stroke as their plain ones."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return "".join(_APART.get(c, c) for c in plain)


def tokens_of(name: str, generic: frozenset[str] | set[str] = frozenset()) -> tuple[list[str], list[bool], int]:
    """Folded tokens of a typed name in order, whether each is initials, and how many stand before a comma (0: no comma).

    Parts joined by a hyphen are one token of a person's name and several of an organisation's, one
    that has an organisation's word or one of the ``generic`` words.
    """
    apart = _tokens(name, False)
    return apart if is_organisation(apart[0], generic) else _tokens(name, True)


def _tokens(name: str, joined: bool) -> tuple[list[str], list[bool], int]:
    head, comma, tail = name.partition(",")
    if comma and all(t in TITLES for t in folded(tail).replace(".", "").split()):
        head, comma, tail = head, "", ""
    raw: list[tuple[str, bool]] = []
    before = 0
    for part in (head, tail):
        words = part.split() if joined else re.split(r"[\s\-‐‑]+", part)
        for word in words:
            if joined:
                pieces = [p for p in re.split(r"[\-‐‑]+", word) if p]
                word = "".join(pieces[1:] if len(pieces) > 1 and folded(pieces[0]) in PARTICLES else pieces)
            plain = word.replace(".", "")
            dotted = "." in word
            own = _TOKEN.findall(word)
            if not own or folded(plain) in TITLES:
                continue
            if dotted and all(len(t) == 1 for t in own):
                raw += [(t, True) for t in own]
            elif len(own) == 1 and len(own[0]) == 1:
                raw.append((own[0], True))
            elif len(own) == 1 and len(own[0]) <= 3 and own[0].isupper() and any(len(t) > 3 for t in _TOKEN.findall(name)) and folded(own[0]) not in PARTICLES:
                raw += [(c, True) for c in own[0]]
            else:
                raw += [(t, False) for t in own]
        if part is head and comma:
            before = len(raw)
    return [folded(t) for t, _ in raw], [i for _, i in raw], before


def is_organisation(tokens: list[str], generic: frozenset[str] | set[str] = frozenset()) -> bool:
    return any(t in _LONG or t in generic for t in tokens)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per long token of a name, in either reading, with its place: first (1), last (-1) or between (0), and whether the name was typed whole."""
    for batch in batches:
        ids, tokens, places, wholes = [], [], [], []
        for i, name, whole in zip(*(batch.column(c).to_pylist() for c in range(3))):
            own, short, before = tokens_of(name)
            organisation = is_organisation(own)
            long = [t for t, s in zip(own, short) if not s and t not in PARTICLES]
            plain = before == 0 and len(long) > 1 and not organisation
            rows = [(t, (1 if k == 0 else -1 if k == len(long) - 1 else 0) if plain else 0) for k, t in enumerate(long)]
            if whole and not organisation:
                rows += [(t, 0) for t, s in zip(*_tokens(name, False)[:2]) if not s and t not in long]
            for t, place in rows:
                ids.append(i), tokens.append(t), places.append(place), wholes.append(whole)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.string()), pa.array(places, pa.int32()), pa.array(wholes, pa.bool_())], ["id", "token", "place", "whole"])


def _folded_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, formal): familiar forms and the names they stand for, both folded."""
    for batch in batches:
        rows = [(folded(short), folded(full)) for full, short in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if full and short]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], ["token", "formal"])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, kind, family, double, given, forms, common, words, brief, tokens, initials): the parts of a name, and the tokens it is blocked by.

    Each token comes with the share of first places among the names that have it; the order of given
    and family names that fits the shares best is taken, so swapped fields are put right. ``forms``
    has the names each given name may stand for, ``common`` the given names in use or, of an
    organisation, the words that tell none from another.
    """
    for batch in batches:
        out: list[tuple] = []
        for i, name, known in zip(*(batch.column(c).to_pylist() for c in range(3))):
            stats = {k["token"]: (k["share"], k["n"]) for k in known or []}
            generic = {k["token"] for k in known or [] if k["generic"]}
            formal = {k["token"]: k["formal"] or [] for k in known or []}
            own, short, before = tokens_of(name, generic)
            if is_organisation(own, generic):
                words = [_LONG.get(t, t) for t in own if t != "the"]
                usual = [_LONG.get(t, t) for t in own if t in generic or t in _LONG]
                head = [w for w in words if w not in usual and len(w) > 3]
                # acronyms were taken for initials
                brief = "".join(t for t, s in zip(own, short) if s)
                rest = sorted(w for w, s in zip(own, short) if not s and w != "the")
                out.append((i, "organisation", "", None, [], [], usual, [_LONG.get(w, w) for w in rest], brief, head, [head[0][0]] if head else [""]))
                continue
            items = [(t, s) for t, s in zip(own, short) if t not in PARTICLES or s]
            if before:
                n = sum(1 for t, s in zip(own[:before], short[:before]) if t not in PARTICLES or s)
                family, given = [t for t, s in items[:n] if not s], items[n:] + [x for x in items[:n] if x[1]]
            else:
                long = [k for k, (t, s) in enumerate(items) if not s]
                share = {k: stats.get(items[k][0], (0.5, 0))[0] for k in long}
                best, family_at = -1.0, long[-1:]
                for take in range(1, len(long) + 1):
                    for cut_at in ([long[-take:]] if take == len(long) else [long[-take:], long[:take]]):
                        rest = [k for k in long if k not in cut_at]
                        fit = sum(1 - share[k] for k in cut_at) + sum(share[k] for k in rest) + (0.02 if cut_at == long[-1:] else 0)
                        # a name has given names, full or initials
                        if (rest or any(s for _, s in items)) and fit > best + 1e-9:
                            best, family_at = fit, cut_at
                family = [items[k][0] for k in family_at]
                given = [x for k, x in enumerate(items) if k not in family_at]
            common = [t for t, s in given if not s and stats.get(t, (0, 0))[1] >= 5]
            tokens = family + [t for t, s in given if not s]
            forms = [[t, *formal.get(t, [])] for t, _ in given]
            initials = sorted({f[0] for f in (forms[0] if forms else tokens[:1])}) or [""]
            # a full name before the family name may be part of a double one that lost its hyphen
            last = given[-1][0] if len(given) > 1 and len(given[-1][0]) > 2 and given[-1][0] not in common else None
            double = last and last + "".join(family)
            out.append((i, "person", "".join(family), double, [t for t, _ in given], forms, common, [], "", tokens, initials))
        columns = list(zip(*out)) or [[]] * 11
        strings = pa.list_(pa.string())
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), strings, pa.list_(strings), strings, strings, pa.string(), strings, strings]
        names = ["id", "kind", "family", "double", "given", "forms", "common", "words", "brief", "tokens", "initials"]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


_PARTS = "id long, kind string, family string, double string, given array<string>, forms array<array<string>>, common array<string>, words array<string>, brief string, tokens array<string>, initials array<string>"


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit per letter of ``a``."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & places.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a and b else 0.0


def alike(a: str, b: str, least: float) -> bool:
    """Whether the ratio reaches ``least``; lengths that are too far apart are told without looking at letters."""
    if a == b:
        return bool(a)
    return 2 * min(len(a), len(b)) >= least * (len(a) + len(b)) and ratio(a, b) >= least


class Comparer:
    """Compares the parts of two names, as :func:`_parsed` gives them."""

    @staticmethod
    def given_fit(a: str, b: str, one: list[str], two: list[str], known_a: bool, known_b: bool) -> bool:
        if len(a) == 1 or len(b) == 1:
            return bool({x[0] for x in one} & {x[0] for x in two})
        if a == b or set(one) & set(two):
            return True
        if known_a and known_b:  # two names in use
            return False
        return any(alike(x, y, GIVEN_RATIO) for x in one for y in two)

    @staticmethod
    def _readings(x: dict) -> list[tuple[str, list[str], list[list[str]]]]:
        """Family and given names with their forms, in both readings of a name that may be a double one."""
        family, given, forms = x["family"], x["given"], x["forms"]
        return [(family, given, forms), (x["double"], given[:-1], forms[:-1])] if x["double"] else [(family, given, forms)]

    def person(self, a: dict, b: dict) -> bool:
        for family, x, forms_x in self._readings(a):
            for other, y, forms_y in self._readings(b):
                if x and y and alike(family, other, SURNAME_RATIO) and all(self.given_fit(p, q, f, g, p in a["common"], q in b["common"]) for p, q, f, g in zip(x, y, forms_x, forms_y)):
                    return True
        return False

    def organisation(self, a: dict, b: dict) -> bool:
        generic = {*a["common"], *b["common"]}
        if not any(alike(p, q, SURNAME_RATIO) for p in a["tokens"] for q in b["tokens"] if p not in generic and q not in generic):
            return False
        x, y = list(a["words"]), list(b["words"])
        if not self._covered(x, y, b["brief"]) and not self._covered(y, x, a["brief"]):
            return False
        return self._brief_fits(a["brief"], y) and self._brief_fits(b["brief"], x)

    @staticmethod
    def _covered(x: list[str], y: list[str], brief: str) -> bool:
        """Every word of ``x`` has its like in ``y`` or its letter in the acronym beside ``y``."""
        left, letters = list(y), list(brief)
        for w in x:
            like = next((v for v in left if alike(v, w, SURNAME_RATIO)), None)
            if like is not None:
                left.remove(like)
            elif w[0] in letters:
                letters.remove(w[0])
            else:
                return False
        return True

    @staticmethod
    def _brief_fits(brief: str, words: list[str]) -> bool:
        firsts = [w[0] for w in words]
        return not brief or len(words) <= 2 or sum(c in firsts for c in brief) == len(brief)

    def same(self, a: dict, b: dict) -> bool:
        return a["kind"] == b["kind"] and (self.person(a, b) if a["kind"] == "person" else self.organisation(a, b))


def typed_names(papers: DataFrame) -> DataFrame:
    """(id, name, whole) of the different typed names: first name, a space, last name, or the last name alone. Blank ones are left out.

    ``whole``: the name was never typed in two fields.
    """
    author = papers.select(F.explode("authors").alias("a"))
    whole = F.col("a.firstname").isNull()
    name = F.when(whole, F.col("a.lastname")).otherwise(F.concat_ws(" ", "a.firstname", "a.lastname"))
    named = author.select(name.alias("name"), whole.alias("whole")).where(F.length(F.trim("name")) > 0).groupBy("name").agg(F.min("whole").alias("whole"))
    return named.select(F.monotonically_increasing_id().alias("id"), "name", "whole")


def _generic_words(counted: DataFrame) -> DataFrame:
    """(token): words of names typed whole that never stand in two fields and stand beside ``COMPANIONS`` or more proper words.

    A name's proper word is the rarest that others share; a word with several of those is of a kind, not a name.
    """
    own = counted.select("id", "token", "whole").distinct()
    apart = own.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("apart")).where("apart and n >= 2").select("token", "n")
    words = own.where("whole").join(by_shuffle(apart), "token").select("id", "token", "n")
    proper = words.groupBy("id").agg(F.min_by("token", F.struct("n", "token")).alias("proper"))
    return words.join(by_shuffle(proper), "id").select("token", "proper").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMPANIONS).select("token")


def _may_agree() -> Column:
    """Whether two names (kind, family, double) may reach ``SURNAME_RATIO``: what the ratio asks of lengths and edits, told before any name is fetched."""

    def near(p: Column, q: Column) -> Column:
        room = (F.length(p) + F.length(q)) * (1 - SURNAME_RATIO) + 1e-9
        return (F.abs(F.length(p) - F.length(q)) <= room) & (F.levenshtein(p, q) <= room)

    each = [near(F.col(f"x.{p}"), F.col(f"y.{q}")) for p in ("family", "double") for q in ("family", "double")]
    any_near = F.coalesce(each[0], F.lit(False))
    for one in each[1:]:
        any_near = any_near | F.coalesce(one, F.lit(False))
    return (F.col("x.kind") == F.col("y.kind")) & ((F.col("x.kind") == "organisation") | any_near)


def _blocks(parts: DataFrame) -> DataFrame:
    """(block, id, tiles): the tokens of every name and their suffixes, refined where they are common.

    The first refinement is by the first letters of all forms of the given name, as any of them may
    be the one another name has; the second by any two of the first three letters of the family
    name, in order, so two heads that a slip of one letter parts still share a block.
    """
    head = F.when(F.length("family") > 0, F.col("family")).otherwise(F.coalesce(F.get("tokens", F.lit(0)), F.lit("")))
    token = parts.select("id", head.alias("head"), "initials", F.explode(F.array_distinct("tokens")).alias("token"))
    ends = F.sequence(F.lit(0), F.greatest(F.length("token") - SHORTEST, F.lit(0)))
    rest = token.select("id", "head", "initials", F.explode(F.transform(ends, lambda i: F.substring(F.col("token"), i + 1, F.lit(1000)))).alias("suffix"))
    letter = lambda i: F.substring("head", i, 1)
    twos = F.array_distinct(F.array(F.concat(letter(1), letter(2)), F.concat(letter(1), letter(3)), F.concat(letter(2), letter(3))))
    levels = [(None, None, ["suffix"]), ("initial", F.explode("initials"), ["suffix", "initial"]), ("two", F.explode(twos), ["suffix", "initial", "two"])]
    out = None
    for level, (name, value, key) in enumerate(levels):
        if name:
            rest = rest.withColumn(name, value)
        keyed = rest.withColumn("block", F.concat_ws("|", F.lit(str(level)), *key))
        joined = keyed.join(by_shuffle(keyed.groupBy("block").agg(F.count(F.lit(1)).alias("n"))), "block")
        fits = (F.col("n") > 1) if level == len(levels) - 1 else (F.col("n") > 1) & (F.col("n") <= COMMON)
        kept = joined.where(fits).select("block", "id", tiles(F.col("n")).alias("tiles"))
        out = kept if out is None else out.unionByName(kept)
        rest = joined.where(F.col("n") > COMMON).drop("block", "n")
    return out


def linked_names(papers: DataFrame, given_names: DataFrame) -> DataFrame:
    """(name_1, name_2) of different typed names that mean the same, the smaller by code point first.

    Titles, case, marks, order, commas, double spaces and particles don't matter. Family names must
    agree by the ratio of their common subsequence; given names must be equal, a familiar form, a
    misspelling or an initial of each other, place by place, as far as both have them. Organisations
    must share a proper word, and the words of one must be covered by those or an acronym of the
    other; which words are proper is told by the company they keep. Null and blank names are left
    out; names that repeat count once; empty tables give no rows.
    """
    names = cut(typed_names(papers))
    counted = cut(names.mapInArrow(_named, "id long, token string, place int, whole boolean"))
    stats = counted.groupBy("token").agg(F.sum((F.col("place") == 1).cast("int")).alias("firsts"), F.sum((F.col("place") == -1).cast("int")).alias("lasts"))
    stats = stats.select("token", ((F.col("firsts") + 0.5) / (F.col("firsts") + F.col("lasts") + 1)).alias("share"), F.col("firsts").alias("n"))
    formal = given_names.select(F.col("given_name").cast("string"), F.col("short_form").cast("string")).mapInArrow(_folded_forms, "token string, formal string").groupBy("token").agg(F.collect_set("formal").alias("formal"))  # of one short form
    stats = stats.join(by_shuffle(_generic_words(counted).withColumn("generic", F.lit(True))), "token", "left").join(by_shuffle(formal), "token", "left")
    known = F.struct("token", "share", "n", F.coalesce("generic", F.lit(False)).alias("generic"), "formal")
    own = counted.select("id", "token").distinct().join(by_shuffle(stats), "token").groupBy("id").agg(F.collect_list(known).alias("known"))  # the tokens of one name
    parts = cut(names.join(by_shuffle(own), "id", "left").select("id", "name", "known").mapInArrow(_parsed, _PARTS))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comparer = Comparer()
        for batch in batches:
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            same = [i for i in range(len(a)) if comparer.same(x[i], y[i])]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in same], pa.int64()), pa.array([b[i] for i in same], pa.int64())], ["a", "b"])

    struct = F.struct("kind", "family", "double", "given", "forms", "common", "words", "brief", "tokens")
    left, right = (by_shuffle(parts.select(F.col("id").alias(i), struct.alias(x))) for i, x in (("a", "x"), ("b", "y")))

    def confirmed(candidates: DataFrame) -> DataFrame:
        return candidates.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(compared, "a long, b long")

    brief = by_shuffle(parts.select("id", F.struct("kind", "family", "double", F.when(F.col("kind") == "person", F.col("family")).otherwise(F.concat_ws(" ", "words")).alias("spelling")).alias("v")))
    pairs = cut(pairs_within(cut(_blocks(parts).join(brief, "id")), _may_agree()))
    links = cut(confirmed(pairs))
    # Names without a common suffix, such as a slip in the last letters beside initials, may share a neighbour.
    # Those of one spelling of the family name have met already, so only others are paired.
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("b").alias("block"), F.col("a").alias("id"))
    degree = both.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("block", tiles(F.col("n")).alias("tiles"))
    around = pairs_within(cut(both.join(by_shuffle(degree), "block").join(brief, "id")), _may_agree() & (F.col("x.spelling") != F.col("y.spelling")))
    links = links.unionByName(confirmed(around.join(by_shuffle(pairs), ["a", "b"], "left_anti")))
    x, y = (by_shuffle(names.select(F.col("id").alias(i), F.col("name").alias(n))) for i, n in (("a", "p"), ("b", "q")))
    named = links.join(x, "a").join(y, "b")
    return named.select(F.least("p", "q").alias("name_1"), F.greatest("p", "q").alias("name_2"))


def entities(papers: DataFrame, given_names: DataFrame) -> DataFrame:
    """(name, entity, n_links) of every typed name: the least name it is linked to over any number of links."""
    links = cut(linked_names(papers, given_names))
    roots = components(links.select(F.col("name_1").alias("a"), F.col("name_2").alias("b")))
    degree = links.select(F.explode(F.array("name_1", "name_2")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n_links"))
    joined = typed_names(papers).select("name").join(by_shuffle(degree), "name", "left").join(by_shuffle(roots.select(F.col("a").alias("name"), F.col("b").alias("root"))), "name", "left")
    return joined.select("name", F.coalesce("root", "name").alias("entity"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
