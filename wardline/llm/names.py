"""Names of institutions as people type them, folded to comparable forms.

A name is taken apart into a proper part (``core``) and the kind of house. What people
vary is undone: compatibility and decomposed characters, invisible signs, spacing,
legal entities and town names around the name, departments, abbreviated or misspelt
kinds, Latin transcription, and Hangul typed with the keyboard in Latin mode.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache, lru_cache

# The letters of a Hangul syllable in code order, and their Latin transcription.
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINALS = ["", *"ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"]
ROMAN_INITIALS = "g kk n d tt r m b pp s ss - j jj ch k t p h".split()
ROMAN_VOWELS = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split()
ROMAN_FINALS = "- k k k n n n t l k m l l l p l m p p t t ng t t k t p t".split()
# Keys of the two-set keyboard and their letters.
KEYS = dict(zip("rRseEfaqQtTdwWczxvgkoiOjpuPhynbml", "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎㅏㅐㅑㅒㅓㅔㅕㅖㅗㅛㅜㅠㅡㅣ"))
DOUBLE_VOWELS = {"ㅗㅏ": "ㅘ", "ㅗㅐ": "ㅙ", "ㅗㅣ": "ㅚ", "ㅜㅓ": "ㅝ", "ㅜㅔ": "ㅞ", "ㅜㅣ": "ㅟ", "ㅡㅣ": "ㅢ"}
DOUBLE_FINALS = {"ㄱㅅ": "ㄳ", "ㄴㅈ": "ㄵ", "ㄴㅎ": "ㄶ", "ㄹㄱ": "ㄺ", "ㄹㅁ": "ㄻ", "ㄹㅂ": "ㄼ", "ㄹㅅ": "ㄽ", "ㄹㅌ": "ㄾ", "ㄹㅍ": "ㄿ", "ㄹㅎ": "ㅀ", "ㅂㅅ": "ㅄ"}
# Kinds of houses, as they end a name, and the English words for them.
KINDS = {
    "정형외과의원": "orthopedic clinic", "정외의원": "orthopedic clinic", "정형외과병원": "orthopedic hospital", "정외병원": "orthopedic hospital", "정형외과": "orthopedic", "정외과": "orthopedic", "정외": "orthopedic",
    "종합병원": "general", "종합": "general", "종병": "general", "요양병원": "convalescent", "요양원": "convalescent", "요양": "convalescent", "요병": "convalescent",
    "재활병원": "rehabilitation", "재활": "rehabilitation", "여성병원": "women", "여성": "women", "치과병원": "dental", "치과": "dental", "한방병원": "korean medicine", "한방": "korean medicine",
    "대학교병원": "university", "대학병원": "university", "대병원": "university", "대학교": "university", "의료원": "medical center", "의료센터": "medical center", "의료": "medical center", "료원": "medical center", "의원": "clinic", "병원": "hospital",
}
ENGLISH = [
    (r"orthop\w*\s+clinic", "orthopedic clinic"), (r"orthop\w*\s+hosp\w*", "orthopedic hospital"), (r"korean\s+medic\w*\s+hosp\w*", "korean medicine"), (r"general\s+hosp\w*", "general"),
    (r"convales\w*\s+hosp\w*", "convalescent"), (r"rehab\w*\s+hosp\w*", "rehabilitation"), (r"women'?s?\s+hosp\w*", "women"), (r"dental\s+(?:hosp\w*|clinic)", "dental"),
    (r"university\s+hosp\w*", "university"), (r"medical\s+cent\w*", "medical center"), (r"clinic", "clinic"), (r"hosp\w*", "hospital"),
]

_LEGAL = re.compile(r"\[[^\]]*\]|의료법인\s*\S*?의료재단|\(의\)\s*\S*?재단|\((?:재|의|사|학)\)\s*\S+(?=\s)|^의료법인(?=\s)")
_DEPARTMENT = re.compile(r"\((?:본관|본원|응급|응급실|별관|신관)\)|\s*(?:응급실|응급센터|본원|본관)\s*$")
_HANGUL = re.compile(r"[가-힣]")


def clean(name: str | None) -> str:
    """Composed, without invisible signs, with single spaces."""
    if not name:
        return ""
    text = "".join(c for c in unicodedata.normalize("NFKC", name) if unicodedata.category(c) != "Cf")
    return " ".join(text.split())


@cache
def letters(syllable: str) -> str:
    """The letters of a Hangul syllable; other characters as they are."""
    n = ord(syllable) - 0xAC00
    if not 0 <= n < 11172:
        return syllable
    return INITIALS[n // 588] + VOWELS[n // 28 % 21] + FINALS[n % 28]


def spelled(text: str) -> str:
    return "".join(map(letters, text))


@cache
def _roman(syllable: str) -> str:
    n = ord(syllable) - 0xAC00
    if not 0 <= n < 11172:
        return syllable.lower()
    return (ROMAN_INITIALS[n // 588] + ROMAN_VOWELS[n // 28 % 21] + ROMAN_FINALS[n % 28]).replace("-", "")


def romanized(text: str) -> str:
    return "".join(map(_roman, text))


def from_keyboard(run: str) -> str | None:
    """Hangul of what was typed in Latin mode; None if it doesn't make whole syllables."""
    typed = [KEYS.get(c) or KEYS.get(c.lower()) for c in run]
    if None in typed:
        return None
    out, i, n = [], 0, len(typed)
    while i < n:
        if typed[i] not in INITIALS or i + 1 >= n or typed[i + 1] not in VOWELS:
            return None
        first, vowel = typed[i], typed[i + 1]
        i += 2
        if i < n and vowel + typed[i] in DOUBLE_VOWELS:
            vowel = DOUBLE_VOWELS[vowel + typed[i]]
            i += 1
        final = ""
        if i < n and typed[i] in FINALS and not (i + 1 < n and typed[i + 1] in VOWELS):
            final = typed[i]
            i += 1
            if i < n and final + typed[i] in DOUBLE_FINALS and not (i + 1 < n and typed[i + 1] in VOWELS):
                final = DOUBLE_FINALS[final + typed[i]]
                i += 1
        out.append(chr(0xAC00 + INITIALS.index(first) * 588 + VOWELS.index(vowel) * 28 + FINALS.index(final)))
    return "".join(out)


def distance(a: str, b: str, most: int) -> int:
    """Edits (swapped neighbours count one) between two short strings; ``most + 1`` if more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    older, old = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        older, old = old, row
    return min(old[-1], most + 1)


@cache
def _mask(syllable: str) -> int:
    """A bit for each letter that a syllable has."""
    return sum({1 << ord(c) % 64 for c in letters(syllable)})


def _letter_mask(text: str) -> int:
    mask = 0
    for c in text:
        mask |= _mask(c)
    return mask


#: Endings with their kinds, letters, letters as bits, and the sizes of an ending of a name that can be a misspelt one.
_ENDINGS = tuple((k, kind, spelled(k) if len(k) >= 2 else "", _letter_mask(k), (len(k), len(k) - 1, len(k) + 1) if len(k) > 3 else (len(k),)) for k, kind in KINDS.items())


@lru_cache(50_000)
def _kinds_at_end(text: str) -> tuple[tuple[str, str], ...]:
    """(rest, kind) of a Hangul name without spaces: its exact ending, and all longer or only misspelt ones, the likeliest first.

    A misspelt ending has a letter or two wrong, its syllables in another order, or one
    of several syllables missing.
    """
    found: list[tuple[float, str, str]] = []
    exact = max((len(e) for e in KINDS if text.endswith(e) and len(text) > len(e)), default=0)
    masks: dict[int, int] = {}
    for ending, kind, spelt, mask, sizes in _ENDINGS:
        n = len(ending)
        if text.endswith(ending) and len(text) > n:
            if n == exact or n == 2 and text.endswith("대병원"):  # which may be an abbreviation, or a name that ends so
                found.append((-0.6 * n, text[:-n], kind))
            continue
        if n <= exact or n == 2 and ending not in ("병원", "의원") or n == 3 and ending[-1] != "원":
            continue
        for size in sizes:
            if len(text) <= size:
                continue
            end, allowed = text[-size:], 1 if n < 4 else 2
            own = masks.get(size)
            if own is None:
                own = masks[size] = _letter_mask(end)
            part = size == n - 1 and n > 3 and not own & ~mask
            if not part and ((own & ~mask).bit_count() > allowed or (mask & ~own).bit_count() > allowed):
                continue  # each letter that only one has is an edit
            if own == mask and sorted(end) == sorted(ending):
                cost = 0.8
            elif part and any(ending[:i] + ending[i + 1 :] == end for i in range(n)):
                cost = 1.0
            else:
                cost = distance(spelled(end), spelt, allowed)
                if cost > allowed:
                    continue
            found.append((cost - 0.6 * n, text[:-size], kind))
    if text.endswith("H") and len(text) > 1:
        found.append((-2.0, text[:-1], "hospital"))
    found.sort()
    out: list[tuple[str, str]] = []
    for _, rest, kind in found:
        if all(kind != k for _, k in out):
            out.append((rest, kind))
    return tuple(out) or ((text, ""),)


def parse(name: str | None, town: str | None = None, keyboard: bool = True) -> list[tuple[str, str]]:
    """Readings ``(core, kind)`` of a name, the likeliest first; [] for an empty name.

    ``core`` is Hangul, or lower-case Latin letters where only a transcription is known;
    ``kind`` is "" where none is given. ``town`` is the town's name without its suffix.
    Repeated syllables are merged, and left as they are in a later reading. With
    ``keyboard`` Latin letters are read as keys of the Hangul keyboard first, where that is possible.
    """
    text = clean(name).replace("요양원(병원)", "요양병원")
    text = _DEPARTMENT.sub("", _LEGAL.sub(" ", text))
    text = re.sub(r"[·*\"'`.,]", lambda m: "'" if m.group() == "'" else "", text)
    if town:
        text = re.sub(rf"\(\s*{re.escape(town)}\s*\)|\s-\s*{re.escape(town)}\s*$", " ", text)
    text = re.sub(r"\([^)]*\)?", " ", text).strip()
    kind, typed = "", False
    if re.search(r"[A-Za-z]{2}", text):
        for pattern, found in ENGLISH:
            if re.search(rf"\b{pattern}(?!\w)", text, re.I):
                kind, text = found, re.sub(rf"\b{pattern}(?!\w)", " ", text, count=1, flags=re.I)
                break
        if not kind and keyboard:
            text = re.sub(r"[A-Za-z]+", lambda m: from_keyboard(m.group()) or m.group(), text)
            typed = _HANGUL.search(text) is not None
    words = [w for w in re.split(r"[\s\-]+", text) if w]
    if not words:
        return []
    if town and len(words) > 1 and (words[0] == town or distance(words[0].lower(), romanized(town), 1) <= 1):
        words = words[1:]
    if not kind and len(words) > 1 and words[0] in KINDS:
        kind, words = KINDS[words[0]], words[1:]
    whole = "".join(words)
    core = re.sub(r"([가-힣])\1+", r"\1", whole)
    if not kind and _HANGUL.search(core):
        readings = list(_kinds_at_end(core))
        if whole != core:
            readings += _kinds_at_end(whole)
    elif not kind and core.endswith("H") and len(core) > 1:
        readings = [(core[:-1], "hospital")]
    else:
        readings = [(core, kind)]
    out: list[tuple[str, str]] = []
    for core, kind in readings:
        if re.search(r"[A-Za-z]", core):
            core = re.sub(r"[^a-z]", "", romanized(core).lower())
        else:
            core = re.sub(r"[^가-힣]", "", core)
        if not core:
            continue
        if town and core.startswith(town) and len(core) >= len(town) + 2:
            out.append((core[len(town) :], kind))
        out.append((core, kind))
        if town and not core.startswith(town) and not kind and len(core) >= 3 and core[0] == town[0]:
            out.append((core[1:], kind))
    if typed:
        out += parse(name, town, keyboard=False)
    return list(dict.fromkeys(out))


def compatible(a: str, b: str) -> bool:
    """Whether two kinds can be the same: equal, one unknown, or one a part of the other's name."""
    if not a or not b or a == b:
        return True
    return "orthopedic" in (a, b) and a.startswith("orthopedic") and b.startswith("orthopedic")
