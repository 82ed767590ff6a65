"""Porter's stemmer, after "An algorithm for suffix stripping" (1980)."""

from __future__ import annotations


def _consonants(w: str) -> list[bool]:
    out: list[bool] = []
    for i, c in enumerate(w):
        out.append(c not in "aeiou" and (c != "y" or i == 0 or not out[i - 1]))
    return out


def _measure(stem: str) -> int:
    c = _consonants(stem)
    return sum(a is False and b for a, b in zip(c, c[1:]))


def _vowel(stem: str) -> bool:
    return not all(_consonants(stem))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonants(w)[-1]


def _cvc(w: str) -> bool:
    c = _consonants(w)
    return len(w) > 2 and c[-3] and not c[-2] and c[-1] and w[-1] not in "wxy"


#: Fixed values of the paper: suffix rules of steps 2, 3 and 4.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


def porter(w: str | None) -> str | None:
    if w is None or len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    more = False
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and _vowel(w[:-2]):
        w, more = w[:-2], True
    elif w.endswith("ing") and _vowel(w[:-3]):
        w, more = w[:-3], True
    if more:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP2, STEP3):
        if (s := _longest(w, rules)) and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + rules[s]
    if (s := _longest(w, STEP4)) and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if _measure(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w
