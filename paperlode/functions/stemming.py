"""English stems after Porter (1980), for dictionaries of distinct words.

Spark has no stemmer, so this is an Arrow UDF. Apply it to distinct words, not to running text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The suffix rules of the paper, by step. A rule applies when the stem before the suffix
# has more than `LIMIT` vowel-consonant sequences.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
]


def _kinds(word: str) -> str:
    """'v' or 'c' per letter; y is a vowel after a consonant."""
    kinds = ""
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and i > 0 and kinds[i - 1] == "c")
        kinds += "v" if vowel else "c"
    return kinds


def _measure(word: str) -> int:
    return _kinds(word).count("vc")


def _short(word: str) -> bool:
    """Ends consonant-vowel-consonant, the last one not w, x or y."""
    return _kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plural(word: str) -> str:
    if word.endswith(("sses", "ies")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    ending = _longest(word, ("ed", "ing"))
    if ending is None or "v" not in _kinds(word[: -len(ending)]):
        return word
    stem = word[: -len(ending)]
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _double(stem) and stem[-1] not in "lsz":
        return stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short(stem) else stem


def _swap(word: str, rules: dict[str, str]) -> str:
    suffix = _longest(word, rules)
    if suffix is None or _measure(word[: -len(suffix)]) == 0:
        return word
    return word[: -len(suffix)] + rules[suffix]


def _strip(word: str) -> str:
    suffix = _longest(word, STEP_4)
    if suffix is None:
        return word
    stem = word[: -len(suffix)]
    if _measure(stem) < 2 or (suffix == "ion" and not stem.endswith(("s", "t"))):
        return word
    return stem


def _final_e(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short(stem)):
            word = stem
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def stem_word(word: str) -> str:
    """The stem of one lower-case word; words of one or two letters, or with other characters, stay as they are."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    word = _past(_plural(word))
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    return _final_e(_strip(_swap(_swap(word, STEP_2), STEP_3)))


def stem(term: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(stem_word, na_action="ignore")

    return run(term)
