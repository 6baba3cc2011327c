"""The Snowball stemmer for Russian, after its published description."""

from __future__ import annotations

import re
from functools import lru_cache

# The vowels and endings of the published algorithm.
VOWELS = "аеиоуыэюя"
GERUND_AFTER_A = ["вшись", "вши", "в"]
GERUND = ["ившись", "ывшись", "ивши", "ывши", "ив", "ыв"]
ADJECTIVE = ["ими", "ыми", "его", "ого", "ему", "ому", "ее", "ие", "ые", "ое", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею"]
PARTICIPLE_AFTER_A = ["ем", "нн", "вш", "ющ", "щ"]
PARTICIPLE = ["ивш", "ывш", "ующ"]
REFLEXIVE = ["ся", "сь"]
VERB_AFTER_A = ["ете", "йте", "ешь", "нно", "ла", "на", "ли", "ем", "ло", "но", "ет", "ют", "ны", "ть", "й", "л", "н"]
VERB = ["ейте", "уйте", "ила", "ыла", "ена", "ите", "или", "ыли", "ило", "ыло", "ено", "ует", "уют", "ены", "ить", "ыть", "ишь", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ят", "ит", "ыт", "ую", "ю"]
NOUN = ["иями", "ями", "ами", "ией", "иям", "ием", "иях", "ев", "ов", "ие", "ье", "еи", "ии", "ей", "ой", "ий", "ям", "ем", "ам", "ом", "ах", "ях", "ию", "ью", "ия", "ья", "а", "е", "и", "й", "о", "у", "ы", "ь", "ю", "я"]
DERIVATIONAL = ["ость", "ост"]
SUPERLATIVE = ["ейше", "ейш"]

_REGION = re.compile(f"[{VOWELS}][^{VOWELS}]")


def _cut(word: str, begin: int, endings: list[str], after_a: list[str] = ()) -> str | None:
    """word without the longest of the endings that lies behind begin; those of after_a must follow а or я in the region."""
    for ending in sorted([*endings, *after_a], key=len, reverse=True):
        at = len(word) - len(ending)
        if at >= begin and word.endswith(ending):
            if ending in after_a and ending not in endings and not (at - 1 >= begin and word[at - 1] in "ая"):
                continue
            return word[:at]
    return None


@lru_cache(maxsize=300_000)
def stem(token: str) -> str:
    """Tokens without Russian letters stay as they are."""
    if not re.search("[а-я]", token):
        return token
    word = token.replace("ё", "е")
    first = re.search(f"[{VOWELS}]", word)
    if not first:
        return word
    rv = first.end()
    r1 = m.end() if (m := _REGION.search(word)) else len(word)
    r2 = m.end() if (m := _REGION.search(word, r1)) else len(word)
    cut = _cut(word, rv, GERUND, GERUND_AFTER_A)
    if cut is None:
        word = _cut(word, rv, REFLEXIVE) or word
        cut = _cut(word, rv, ADJECTIVE)
        if cut is not None:
            cut = _cut(cut, rv, PARTICIPLE, PARTICIPLE_AFTER_A) or cut
        else:
            cut = _cut(word, rv, VERB, VERB_AFTER_A)
            if cut is None:
                cut = _cut(word, rv, NOUN)
    word = word if cut is None else cut
    if len(word) - 1 >= rv and word.endswith("и"):
        word = word[:-1]
    word = _cut(word, r2, DERIVATIONAL) or word
    if len(word) - 2 >= rv and word.endswith("нн"):
        return word[:-1]
    cut = _cut(word, rv, SUPERLATIVE)
    if cut is not None:
        return cut[:-1] if len(cut) - 2 >= rv and cut.endswith("нн") else cut
    if len(word) - 1 >= rv and word.endswith("ь"):
        return word[:-1]
    return word
