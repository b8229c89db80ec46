"""English analysis of terms: a stop list, and the Porter2 stemmer.

Applied to the distinct terms of a batch or a query, never to every occurrence. ``stem`` follows the published description of
the algorithm step by step; a word that has other than the letters a to z stays as it is.
"""

from __future__ import annotations

from functools import lru_cache

#: Words that carry no meaning of their own.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those "
    "am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
#: Words that the rules would spoil, and what they become; words that stay; beginnings with a region of their own.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
STAY = frozenset("sky news howe atlas cosmos bias andes".split())
STAY_AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
BEGINNINGS = ("gener", "commun", "arsen")
#: Suffixes and what they become, in the steps that need them in the first and the second region.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
LI_AFTER = "cdeghkmnrt"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_VOWELS = "aeiouy"


def _region(word: str, at: int) -> int:
    """Where the part begins that follows the first consonant after a vowel, from ``at`` on."""
    for i in range(at + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-1] not in _VOWELS + "wxY" and word[-2] in _VOWELS and word[-3] not in _VOWELS


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _has_vowel(part: str) -> bool:
    return any(c in _VOWELS for c in part)


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and _has_vowel(word[:-2]):
        return word[:-1]
    return word


def _past(word: str, r1: int) -> str:
    suffix = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if suffix in ("eed", "eedly"):
        return word[: -len(suffix)] + "ee" if len(word) - len(suffix) >= r1 else word
    if not suffix or not _has_vowel(word[: -len(suffix)]):
        return word
    word = word[: -len(suffix)]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if word.endswith(DOUBLES):
        return word[:-1]
    return word + "e" if len(word) <= r1 and _short_end(word) else word


def _replace(word: str, rules: dict[str, str], r1: int, r2: int) -> str:
    suffix = _longest(word, rules)
    at = len(word) - len(suffix)
    if not suffix or at < r1:
        return word
    if suffix == "ogi" and word[at - 1] != "l" or suffix == "li" and word[at - 1] not in LI_AFTER or suffix == "ative" and at < r2:
        return word
    return word[:at] + rules[suffix]


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-cased word."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()) or word in STAY:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    letters = list(word)
    for i, c in enumerate(letters):  # a y that is a consonant
        if c == "y" and (i == 0 or letters[i - 1] in _VOWELS):
            letters[i] = "Y"
    word = "".join(letters)
    begin = next((b for b in BEGINNINGS if word.startswith(b)), None)
    r1 = len(begin) if begin else _region(word, 0)
    r2 = _region(word, r1)
    word = _plural(word)
    if word in STAY_AFTER_PLURAL:
        return word
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    word = _replace(word, STEP_2, r1, r2)
    word = _replace(word, STEP_3, r1, r2)
    suffix = _longest(word, STEP_4)
    at = len(word) - len(suffix)
    if suffix and at >= r2 and (suffix != "ion" or word[at - 1 : at] in ("s", "t")):
        word = word[:at]
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or at >= r1 and not _short_end(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def english(term: str) -> str | None:
    """What is indexed of a term: its stem, nothing of a stop word."""
    return None if term in STOP_WORDS else stem(term)


def simple(term: str) -> str | None:
    """What is indexed of a term: itself."""
    return term


#: By name.
ANALYSERS = {"simple": simple, "english": english}
