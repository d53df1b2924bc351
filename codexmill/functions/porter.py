"""The public Porter stemming algorithm (1980), rule by rule."""

from __future__ import annotations

import re

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M0 = re.compile(f"^({_C})?{_V}{_C}")
_M1 = re.compile(f"^({_C})?{_V}{_C}({_V})?$")
_M2 = re.compile(f"^({_C})?{_V}{_C}{_V}{_C}")
_VOWEL = re.compile(f"^({_C})?[aeiouy]")
_CVC = re.compile(f"^{_C}[aeiouy][^aeiouwxy]$")
# The algorithm's suffix tables for steps 2, 3 and 4.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _swap(w: str, table, least: re.Pattern) -> str:
    for end, new in table:
        if w.endswith(end):
            stem = w[: -len(end)]
            return stem + new if least.match(stem) else w
    return w


def stem(w: str) -> str:
    """Of a lower-case word; words of one or two letters and words with other than a-z stay."""
    if len(w) < 3 or not (w.isascii() and w.isalpha()):
        return w
    first_y = w[0] == "y"
    if first_y:
        w = "Y" + w[1:]
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _M0.match(w[:-3]):
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                s = w[: -len(end)]
                if _VOWEL.match(s):
                    if s.endswith(("at", "bl", "iz")):
                        s += "e"
                    elif re.search(r"([^aeiouylsz])\1$", s):
                        s = s[:-1]
                    elif _CVC.match(s):
                        s += "e"
                    w = s
                break
    if w.endswith("y") and _VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(w, sorted(_STEP2, key=lambda p: -len(p[0])), _M0)
    w = _swap(w, sorted(_STEP3, key=lambda p: -len(p[0])), _M0)
    for end in sorted((*_STEP4, "ion"), key=len, reverse=True):
        if w.endswith(end):
            s = w[: -len(end)]
            if _M2.match(s) and (end != "ion" or s.endswith(("s", "t"))):
                w = s
            break
    if w.endswith("e"):
        s = w[:-1]
        if _M2.match(s) or (_M0.match(s) and not _M1.match(s)) or (_M1.match(s) and not _CVC.match(s)):
            w = s
    if w.endswith("ll") and _M2.match(w[:-1]):
        w = w[:-1]
    return "y" + w[1:] if first_y else w
