"""English search words: lower-cased tokens without stop words, stemmed by the published Snowball English algorithm.

Stemming runs on distinct tokens alone (``stemmed``) and is joined back, so Python sees each word once, not each place.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The English stop words.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they "
    "them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does "
    "did doing a an the and but if or because as until while of at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then once here there when where why how all any both each few "
    "more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

# Endings and exceptions of the stemmer.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = frozenset("sky news howe atlas cosmos bias andes".split())
KEPT_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

#: Words whose stems a task remembers.
REMEMBERED = 500_000

_VOWEL = re.compile("[aeiouy]")
_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _region(word: str, start: int) -> int:
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _ending(word: str, endings) -> str:
    """The longest of the endings that word has, '' if none."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def stem(word: str) -> str:
    """Snowball English stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2 or word in KEPT:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = re.sub("(^|[aeiouy])y", r"\1Y", word.removeprefix("'"))
    head = re.match("gener|commun|arsen", w)
    r1 = head.end() if head else _region(w, 0)
    r2 = _region(w, r1)
    w = w[: len(w) - len(_ending(w, ("'", "'s", "'s'")))]
    # 1a: plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in KEPT_AFTER_1A:
        return w
    # 1b: past and present participles
    e = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if e.startswith("eed"):
        if len(w) - len(e) >= r1:
            w = w[: len(w) - len(e)] + "ee"
    elif e and _VOWEL.search(w[: len(w) - len(e)]):
        w = w[: len(w) - len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _SHORT.search(w):
            w += "e"
    # 1c: a last y after a consonant
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # 2
    e = _ending(w, STEP_2)
    at = len(w) - len(e)
    if e and at >= r1 and not (e == "ogi" and w[at - 1] != "l") and not (e == "li" and w[at - 1] not in "cdeghkmnrt"):
        w = w[:at] + STEP_2[e]
    # 3
    e = _ending(w, STEP_3)
    at = len(w) - len(e)
    if e and at >= r1 and not (e == "ative" and at < r2):
        w = w[:at] + STEP_3[e]
    # 4
    e = _ending(w, STEP_4)
    at = len(w) - len(e)
    if e and at >= r2 and not (e == "ion" and w[at - 1] not in "st"):
        w = w[:at]
    # 5
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(StringType())
def stem_of(s: pd.Series) -> pd.Series:
    return s.map(lambda w: None if w is None else stem(w))


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, in order, stop words among them."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def stemmed(rows: DataFrame, column: str = "token") -> DataFrame:
    """rows with column ``lexeme``, the stem of their token; rows of stop words go. Each distinct token is stemmed once."""
    rows = rows.where(~F.col(column).isin(STOP_WORDS))
    words = rows.select(column).distinct()
    return rows.join(words.withColumn("lexeme", stem_of(column)), column)


def counted(rows: DataFrame, lexemes: DataFrame) -> DataFrame:
    """(id, lexeme, n) of rows (id, text): places of each of the lexemes (lexeme), a stated set; a task stems each distinct word of its texts, not each place."""
    shared = rows.sparkSession.sparkContext.broadcast(frozenset(r["lexeme"] for r in lexemes.collect()))
    stop = frozenset(STOP_WORDS)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, wanted = {}, {lexeme: i for i, lexeme in enumerate(sorted(shared.value))}
        names = pa.array(wanted, pa.string())

        def of(word: str) -> int:
            """The number of the word's lexeme, -1 if none asks for it."""
            if word not in own:
                if len(own) >= REMEMBERED:
                    own.clear()
                own[word] = -1 if word in stop else wanted.get(stem(word), -1)
            return own[word]

        for b in batches:
            words = b.column("words")
            coded = words.flatten().dictionary_encode()
            sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
            number = np.array([of(w) for w in coded.dictionary.to_pylist()], np.int64)
            lexeme = number[coded.indices.to_numpy(zero_copy_only=False)] if len(number) else number
            some = np.flatnonzero(lexeme >= 0)
            group, n = np.unique(np.repeat(np.arange(len(sizes)), sizes)[some] * max(1, len(wanted)) + lexeme[some], return_counts=True)
            row, at = np.divmod(group, max(1, len(wanted)))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), names.take(pa.array(at)), pa.array(n, pa.int64())], ["id", "lexeme", "n"])

    return rows.select("id", tokens(F.col("text")).alias("words")).mapInArrow(count, f"id {rows.schema['id'].dataType.simpleString()}, lexeme string, n long")


def positions(rows: DataFrame) -> DataFrame:
    """(id, place, lexeme) of rows (id, text): places count stop words, which have none themselves."""
    places = rows.select("id", F.posexplode(tokens(F.col("text"))).alias("place", "token"))
    return stemmed(places).select("id", "place", "lexeme")
