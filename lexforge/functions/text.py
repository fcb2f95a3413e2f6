"""Text as Column expressions: cleaning, words, grams and windows, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the ASCII punctuation that indexing strips.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: A word: letters, digits and underscores of any script (``\w`` would be ASCII only).
WORD = r"[\p{L}\p{N}_]+"
#: Latin letters with marks, and their plain forms.
MARKED = "àáâãäåāăąçćčďđèéêëēęěìíîïīłñńňòóôõöøōŕřśšşťțùúûüūůýÿźżžÀÁÂÃÄÅĀĂĄÇĆČĎĐÈÉÊËĒĘĚÌÍÎÏĪŁÑŃŇÒÓÔÕÖØŌŔŘŚŠŞŤȚÙÚÛÜŪŮÝŸŹŻŽ"
PLAIN = "aaaaaaaaacccddeeeeeeeiiiiilnnnooooooorrsssttuuuuuuyyzzzAAAAAAAAACCCDDEEEEEEEIIIIILNNNOOOOOOORRSSSTTUUUUUUYYZZZ"


def folded_case(text: Column) -> Column:
    """Lower case; the final sigma is written like any other, so that case alone never makes two words."""
    return F.translate(F.lower(text), "ς", "σ")


def words(text: Column) -> Column:
    """The words of a text in order, lower-cased; null for null, none for a text without any."""
    return F.regexp_extract_all(folded_case(text), F.lit(f"({WORD})"), F.lit(1))


def strip_punctuation(text: Column) -> Column:
    """Without ASCII punctuation; words on both sides of a hyphen or underscore grow together."""
    return F.translate(text, PUNCTUATION, "")


def plain_ascii(text: Column) -> Column:
    """Marks taken off Latin letters, other non-ASCII characters dropped, lower-cased."""
    return F.lower(F.regexp_replace(F.translate(text, MARKED, PLAIN), r"[^\x00-\x7f]", ""))


def collapsed(text: Column) -> Column:
    """Lower-cased with every run of white space as one space."""
    return F.regexp_replace(F.lower(text), r"\s+", " ")


#: The steps that leave only word-like text: (pattern, replacement), applied in order.
WORDLIKE = [
    (r"-[ ]?\n", ""),  # words broken over lines
    (r"\s+", " "),
    (r" ?\[[0-9]+\]", ""),  # numeric references
    (r"[^A-Za-z_-]+", " "),  # signs and digits
    (r"^ | $", ""),
]


def wordlike(text: Column) -> Column:
    """Letters, underscores and hyphens, words separated by single spaces, broken words joined."""
    for pattern, to in WORDLIKE:
        text = F.regexp_replace(text, pattern, to)
    return text


def sentence_words(text: Column) -> Column:
    """Words and single periods that a space or the end follows, in order; case is kept."""
    return F.regexp_extract_all(text, F.lit(rf"[ ]*({WORD}|\.)(?=[ ]|$)"), F.lit(1))


def valid_query(text: Column) -> Column:
    """Whether a query begins, after spaces, with a word character; null isn't valid."""
    return F.coalesce(text.rlike(r"^ *[\p{L}\p{N}_]"), F.lit(False))


def grams(tokens: Column) -> Column:
    """Structs (pos, term1, term2): all words with an empty second term, then all neighbouring pairs. Repeats stay."""
    n = F.size(tokens)
    single = F.transform(tokens, lambda t, i: F.struct(i.alias("pos"), t.alias("term1"), F.lit("").alias("term2")))
    starts = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(starts, lambda i: F.struct((n + i).alias("pos"), F.get(tokens, i).alias("term1"), F.get(tokens, i + 1).alias("term2")))
    return F.concat(single, pairs)


def first_and_rest(gram: Column) -> tuple[Column, Column]:
    """A gram split at its first space; the second part is empty if there is none."""
    return F.substring_index(gram, " ", 1), F.when(F.instr(gram, " ") > 0, F.regexp_replace(gram, r"^[^ ]* ", "")).otherwise("")


def character_windows(text: Column, width: int = 3) -> Column:
    """Arrays of the code points in every window of ``width`` characters; null for null."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    starts = F.when(F.size(codes) >= width, F.sequence(F.lit(1), F.size(codes) - (width - 1))).otherwise(F.array().cast("array<int>"))
    return F.when(text.isNotNull(), F.transform(starts, lambda i: F.slice(codes, i, width)))
