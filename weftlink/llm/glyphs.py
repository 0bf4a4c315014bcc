"""One spelling for texts that look the same (problem 2), and the Latin folding built on it.

A token's letters each belong to a set of scripts: their own, plus those in which a letter of the
same shape exists. Intersecting these sets over the token says in which scripts the whole token
can be written. A token of several scripts with a common one (mixed-script confusable), or of one
script that can be written in Latin throughout (whole-script confusable), is rewritten in that
script. What remains is normalised: wide and narrow forms, typographic ligatures, canonical
composition, kinds of blank, invisible characters. Letter case, accents and visible signs stay.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Letters of one shape in two scripts (Unicode confusables, single letters only).
CYRILLIC_LATIN = dict(zip("АВЕЅІЈКМНОРСТУХаеорсухѕіјһӏԁԛԝԚԜҮ", "ABESIJKMHOPCTYXaeopcyxsijhldqwQWY"))
GREEK_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναρι", "ABEZHIKMNOPTYXovapi"))
ARMENIAN_LATIN = dict(zip("օսհՕՍ", "ouhOU"))
CHEROKEE_LATIN = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"))
# Other letters of the Latin script itself that are drawn alike.
LATIN_TWINS = {"ɡ": "g"}
# Typographic ligatures that show as the letters they join.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
# Characters without a shape beside those of category Cf.
INVISIBLE_RANGES = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF))
# Format characters of category Cf that are drawn.
DRAWN_FORMAT = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x08E2}

TO_LATIN = CYRILLIC_LATIN | GREEK_LATIN | ARMENIAN_LATIN | CHEROKEE_LATIN


def _replacements() -> dict[int, str | None]:
    """Character → what replaces it, by rule over all code points."""
    out: dict[int, str | None] = {}
    for cp in range(0x80, 0x110000):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        wide = unicodedata.decomposition(ch)
        if kind == "Zs":
            out[cp] = " "
        elif kind == "Cf" and cp not in DRAWN_FORMAT or kind == "Cc":
            out[cp] = None
        elif wide.startswith(("<wide>", "<narrow>")):
            out[cp] = unicodedata.normalize("NFKC", ch)
        elif kind == "Nl" and wide.startswith("<compat>") and len(wide.split()) == 2:
            # Roman numerals of one letter.
            out[cp] = unicodedata.normalize("NFKC", ch)
    for first, last in INVISIBLE_RANGES:
        out.update(dict.fromkeys(range(first, last + 1)))
    out.update({ord(k): v for k, v in (LIGATURES | LATIN_TWINS).items()})
    return out


_REPLACE = _replacements() | dict.fromkeys((*range(9, 14), 0x85, 0x2028, 0x2029), " ")
_FOREIGN = re.compile("[" + "".join(TO_LATIN) + "]")


@lru_cache(maxsize=20_000)
def script(ch: str) -> str | None:
    """Script of a letter by the first word of its Unicode name; None for common characters."""
    if not unicodedata.category(ch).startswith(("L", "M")):
        return None
    name = unicodedata.name(ch, "").replace("KATAKANA-HIRAGANA", "KANA")
    return None if name.startswith(("COMBINING", "MODIFIER")) or not name else name.split()[0]


@lru_cache(maxsize=20_000)
def natural_scripts(ch: str) -> frozenset[str] | None:
    """Scripts that a letter itself is written in, those of mixed writing included; None for common characters."""
    own = script(ch)
    if own is None:
        return None
    sets = {"HIRAGANA", "KATAKANA"} if own == "KANA" else {own}
    if own in ("CJK", "HIRAGANA", "KATAKANA", "KANA"):
        sets.add("JAPANESE")
    if own in ("CJK", "HANGUL"):
        sets.add("KOREAN")
    return frozenset(sets)


@lru_cache(maxsize=20_000)
def script_set(ch: str) -> frozenset[str] | None:
    """Scripts in which a letter of this shape exists; None for characters common to all."""
    own = natural_scripts(ch)
    if own is None:
        return None
    sets = set(own)
    if ch in TO_LATIN:
        sets.add("LATIN")
    sets.update(script(k) for k in _FROM_LATIN.get(ch, ()))
    return frozenset(sets)


_FROM_LATIN: dict[str, list[str]] = {}
for _foreign, _latin in TO_LATIN.items():
    _FROM_LATIN.setdefault(_latin, []).append(_foreign)


def resolved_scripts(token: str, of=script_set) -> frozenset[str] | None:
    """Scripts in which the whole token can be written; empty if none, None if any."""
    common: frozenset[str] | None = None
    for ch in token:
        sets = of(ch)
        if sets is not None:
            common = sets if common is None else common & sets
    return common


def is_confusable(token: str) -> bool:
    """Whether the token mixes scripts that are not written together, or is of another script but could be Latin."""
    own = resolved_scripts(token, natural_scripts)
    return own is not None and (not own or "LATIN" not in own and "LATIN" in resolved_scripts(token))


@lru_cache(maxsize=20_000)
def consistent_token(token: str) -> str:
    """The token spelled in one script: Latin where possible, else the only script that fits."""
    scripts = resolved_scripts(unicodedata.normalize("NFD", token))
    if not scripts:
        return token
    if "LATIN" in scripts:
        return "".join(TO_LATIN.get(ch, ch) for ch in token)
    target = min(scripts)
    return "".join(next((k for k in _FROM_LATIN.get(ch, ()) if script(k) == target), ch) for ch in token)


def visual_key(text: str | None) -> str | None:
    """The one consistent spelling of a text; equal for texts that look the same."""
    if text is None:
        return None
    if text.isascii():
        return text.translate(_REPLACE).strip(" ")
    text = unicodedata.normalize("NFC", text.translate(_REPLACE)).strip(" ")
    if _FOREIGN.search(text):
        text = unicodedata.normalize("NFC", " ".join(consistent_token(t) for t in text.split(" ")))
    return text


# Devanagari letters as the Latin letters they sound like.
DEVANAGARI_CONSONANTS = dict(zip("कखगघचछजझञटठडढणतथदधनपफबभमयरलवशषसहङळ", "k kh g gh ch chh j jh n t th d dh n t th d dh n p ph b bh m y r l v sh sh s h n l".split()))
DEVANAGARI_VOWELS = dict(zip("अआइईउऊऋएऐओऔऑऍ", "a a i i u u ri e ai o au o e".split()))
DEVANAGARI_SIGNS = dict(zip("ािीुूृेैोौॉॅ", "a i i u u ri e ai o au o e".split()))
NUKTA_FORMS = {"j": "z", "ph": "f", "k": "q", "g": "g", "kh": "kh", "d": "r", "dh": "rh"}
_DEVANAGARI = re.compile("[ऀ-ॿ]+")


def _sounded(match: re.Match) -> str:
    word, out, bare = unicodedata.normalize("NFD", match.group()), [], False
    for ch in word:
        if ch in DEVANAGARI_CONSONANTS:
            out += ["a"] * bare + [DEVANAGARI_CONSONANTS[ch]]
            bare = True
        elif ch == "़" and out:
            out[-1] = NUKTA_FORMS.get(out[-1], out[-1])
        elif ch == "्":
            bare = False
        elif ch in DEVANAGARI_SIGNS:
            out.append(DEVANAGARI_SIGNS[ch])
            bare = False
        else:
            out += ["a"] * bare + [DEVANAGARI_VOWELS.get(ch, "n" if ch in "ंँ" else "")]
            bare = False
    return "".join(out)


# Latin letters that canonical decomposition leaves whole.
_WHOLE = {ord(k): v for k, v in {"ß": "ss", "ø": "o", "đ": "d", "ł": "l", "æ": "ae", "œ": "oe", "ı": "i"}.items()}


def latin_fold(text: str | None) -> str:
    """Lower-case Latin text for comparison: look-alikes resolved, accents off, Devanagari sounded out."""
    if not text:
        return ""
    if text.isascii() and text.isprintable():
        return text.strip(" ").lower()
    text = visual_key(text)
    if not text.isascii():
        text = _DEVANAGARI.sub(_sounded, text.lower())
        text = unicodedata.normalize("NFKD", text.translate(_WHOLE))
        if not text.isascii():
            text = "".join([ch for ch in text if ch < "\x80" or not unicodedata.combining(ch)])
    return text.lower()
