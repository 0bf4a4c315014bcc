"""Names and postal addresses of business records taken apart into comparable pieces.

A name becomes its identifying words (the core), its trade words and its legal form; an address
its house number, street, street type, city, postcode and unit. Both start from
:func:`weftlink.llm.glyphs.latin_fold`. All functions accept None, empty and very long text.
"""

from __future__ import annotations

import re
from functools import lru_cache
from operator import eq

from weftlink.llm.glyphs import latin_fold

# Nicknames and written short forms of given names.
NICKNAMES = {
    "edward": "ed eddie ted ned", "patricia": "pat trish patty", "joseph": "joe jos", "margaret": "maggie peggy meg", "robert": "bob rob robt bobby",
    "richard": "dick rich rick", "james": "jim jas jimmy", "charles": "chuck chas charlie", "elizabeth": "liz eliza beth lizzie", "william": "bill wm will billy",
    "katherine": "kate kathy kath katie", "thomas": "tom thos tommy", "john": "jack jno johnny", "michael": "mike mick", "george": "geo", "samuel": "sam saml",
    "alexander": "alex sandy", "andrew": "andy", "anthony": "tony", "benjamin": "ben benj", "daniel": "dan danny", "david": "dave", "susan": "sue susie", "barbara": "barb",
}
# Legal forms as one code, with the ways of writing them (words after folding).
LEGAL_FORMS = {
    "corp": "corp corporation", "inc": "inc incorporated", "llc": "llc|limited liability company", "pvt ltd": "pvt ltd|private limited|pvt limited|private ltd|p ltd|p limited|praivet limited|pra li|pra limited",
    "ltd": "ltd limited", "co": "co company", "sons": "sons", "sa": "sa|sociedad anonima|sociedade anonima|societe anonyme", "sl": "sl|sociedad limitada", "ltda": "ltda limitada",
    "sas": "sas|societe par actions simplifiee|societe par actions", "gmbh": "gmbh|gesellschaft mbh|gesellschaft mit beschrankter haftung", "ag": "ag aktiengesellschaft", "plc": "plc", "pvt": "pvt private",
}
# Words of trades, with their short forms.
TRADE_WORDS = {
    "engineering": "engg engr eng", "works": "wks", "supply": "sup supplies", "office": "ofc", "dental": "dent", "clinic": "cln clin", "auto": "", "repair": "rpr repairs", "bakery": "bkry", "associates": "assoc assocs",
    "serv": "services service svcs svc servicios servicos", "logistics": "logist", "pharmacy": "pharm", "plumbing": "plbg", "constr": "construction const construccion construcoes", "trading": "trdg",
    "manufacturing": "mfg manuf", "flooring": "floors floor", "international": "intl", "hardware": "hdwe", "stores": "store strs stors", "sweets": "swts", "electricals": "elect electrical", "medical": "med medikal",
    "textiles": "tex textile teksatails", "agencies": "agcy agency", "brothers": "bros bradars", "jewellers": "jwlrs jewelers", "traders": "trdrs tredars", "foods": "fds food phuds", "indust": "industries inds industria ind indastrij",
    "enterprises": "ent enterprise entarapraijej", "comerc": "comercial com comercio", "padaria": "pad", "boulangerie": "boul", "baustoffe": "baust", "menuiserie": "menuis", "panaderia": "pan", "almacen": "alm",
    "generique": "gen", "societe": "ste", "entrepot": "entr", "electricite": "elec", "mobelhaus": "mobel", "backerei": "back", "gebaudetechnik": "gebtech", "grosshandel": "grossh", "bhandar": "",
}
# Street types as one code, with their short forms.
STREET_TYPES = {
    "street": "st str", "road": "rd", "avenue": "ave av aven avn", "court": "ct crt", "boulevard": "blvd bvd boul", "lane": "ln la lne", "drive": "dr drv", "cross": "crs cros x", "nagar": "ngr nagr", "marg": "mg mrg maarg",
    "colony": "col colny clny", "place": "pl", "way": "", "square": "sq", "terrace": "ter", "highway": "hwy", "parkway": "pkwy",
}
LEADING_TYPES = {"avenida": "avda avd", "calle": "cl cll c", "plaza": "pza plz pl", "rua": "r", "travessa": "tv trv tr trav", "rue": "", "chemin": "ch che chem", "praca": "", "paseo": "", "boulevard": "", "avenue": "", "rodovia": "", "place": ""}
GLUED_TYPES = {"strasse": "str strase", "weg": "wg", "allee": "alee all", "gasse": "", "platz": "", "ring": "", "damm": "", "ufer": ""}
UNIT_WORDS = frozenset("unit suite ste apt apartment flat office shop gala floor piso local sala loja bureau bat batiment etage fl room rm stock wohnung whg haus buro".split())
NUMBER_MARKERS = frozenset("no num nr door plot h house hno number numero".split())
LANDMARK_WORDS = frozenset("near opp opposite behind beside next".split())
LANDMARK_NOUNS = frozenset("school temple talkies bank stand hospital market church mosque park station".split())
NUMBER_WORDS = {w: str(i + 1) for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split())}
FILLERS = frozenset(("", "na", "n a", "none", "null", "nil", "unknown", "not available", "tbd", "x", "xx", "xxx"))


def deletions(word: str) -> set[str]:
    """The word, and it with any one letter left out: two words within one edit share a member."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


#: Letters of a word above which words an edit off are met by its parts instead of by letters left out.
LONG_WORD = 24


def edit_keys(word: str, most: int) -> set[str]:
    """Keys of which two words within ``most`` edits (swaps of neighbours count one) share at least one.

    Up to LONG_WORD letters: the word with up to ``most`` letters left out. Beyond that, where
    these would be too many: 2 most + 1 stretches, of which ``most`` edits leave one untouched,
    each at the places that the edits before it can shift it to.
    """
    keys: set[str] = set()
    if len(word) <= LONG_WORD + most:
        keys, last = {word}, {word}
        for _ in range(most):
            last = {d for w in last for d in deletions(w)} - keys
            keys |= last
    if len(word) > LONG_WORD - most:
        parts = 2 * most + 1
        for size in range(max(parts, len(word) - most), len(word) + most + 1):
            ends = [size * k // parts for k in range(parts + 1)]
            for k, (low, high) in enumerate(zip(ends, ends[1:])):
                keys |= {f"{size}:{k}:{word[low + shift : high + shift]}" for shift in range(-most, most + 1) if 0 <= low + shift and high + shift <= len(word)}
    return keys


def _lexicon(table: dict[str, str]) -> dict[str, str]:
    return {w: code for code, ways in table.items() for w in (code, *ways.split())}


def _fuzzy(words: dict[str, str], least: int = 5) -> dict[str, tuple[str, str]]:
    out: dict[str, tuple[str, str]] = {}
    for w, code in words.items():
        if len(w) >= least:
            for d in deletions(w):
                out.setdefault(d, (w, code))
    return out


def near(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours as one, or most + 1 as soon as it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    # What both begin and end with costs nothing.
    low, high = 0, min(len(a), len(b))
    while low < high and a[low] == b[low]:
        low += 1
    tail = 0
    while tail < high - low and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[low : len(a) - tail], b[low : len(b) - tail]
    if len(a) > len(b):
        a, b = b, a
    if len(a) <= 1:
        return min(len(b) - (a in b) if a else len(b), most + 1)
    # An edit changes two of the letters that only one of them has, at most.
    if len({*a} ^ {*b}) > 2 * most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row, twice = row, [i], before
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if twice is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, twice[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before = last
    return min(row[-1], most + 1)


def _ends(fuzzy: dict[str, tuple[str, str]]) -> tuple[frozenset[str], frozenset[str]]:
    """First and last letters of the words of a lexicon, of which a word one edit off keeps one: two, of four letters the last one."""
    words = {w for w, _ in fuzzy.values()}
    return frozenset(w[:2] for w in words), frozenset(w[-2:] if len(w) > 4 else w[-1] for w in words)


_TRADES = _lexicon(TRADE_WORDS)
_TRADES_NEAR = _fuzzy(_TRADES)
_TYPES = _lexicon(STREET_TYPES)
_TYPES_NEAR = _fuzzy(_TYPES, 4)
_LEADING = _lexicon(LEADING_TYPES)
_LEADING_NEAR = _fuzzy({w: c for w, c in _LEADING.items() if c in ("avenida", "calle", "plaza", "travessa", "chemin")})
_TRADES_ENDS, _TYPES_ENDS, _LEADING_ENDS = map(_ends, (_TRADES_NEAR, _TYPES_NEAR, _LEADING_NEAR))
_LEGAL_PHRASES = sorted(((tuple(way.split()), code) for code, ways in LEGAL_FORMS.items() for way in (ways.split("|") if "|" in ways else ([ways] if code == "pvt ltd" else ways.split()))), key=lambda x: -len(x[0]))
_LEGAL_FIRST: dict[str, list[tuple[tuple[str, ...], str]]] = {}
for _way, _code in _LEGAL_PHRASES:
    _LEGAL_FIRST.setdefault(_way[0], []).append((_way, _code))
FORMAL = {nick: name for name, nicks in NICKNAMES.items() for nick in nicks.split()}
GIVEN_NAMES = frozenset(NICKNAMES)


def _look_up(word: str, exact: dict[str, str], fuzzy: dict[str, tuple[str, str]], ends: tuple[frozenset[str], frozenset[str]], least: int) -> str | None:
    """Code of a word of the lexicon, or of one that lies one edit off it."""
    if word in exact:
        return exact[word]
    if len(word) >= least and (word[:2] in ends[0] or word[-2:] in ends[1] or word[-1] in ends[1]):
        for d in deletions(word):
            hit = fuzzy.get(d)
            if hit and near(word, hit[0], 1) <= 1:
                return hit[1]
    return None


@lru_cache(maxsize=20_000)
def trade_near(word: str) -> str | None:
    return _look_up(word, _TRADES, _TRADES_NEAR, _TRADES_ENDS, 6)


@lru_cache(maxsize=20_000)
def type_near(word: str) -> str | None:
    return _look_up(word, _TYPES, _TYPES_NEAR, _TYPES_ENDS, 4)


_DOUBLED = re.compile(r"(.)\1+")


def sound_of(word: str) -> str:
    """The word with spellings of one sound made equal and doubled letters single."""
    word = word.replace("oo", "u").replace("ee", "i").replace("ph", "f").replace("c", "k").replace("q", "k").replace("w", "v").replace("y", "i")
    return _DOUBLED.sub(r"\1", word) if any(map(eq, word, word[1:])) else word


#: The same for words that come often.
sound = lru_cache(maxsize=20_000)(sound_of)


_DEVANAGARI = re.compile("[\u0900-\u097f]")
_DOTTED = re.compile(r"\b[a-z](?:\.[a-z])+\b\.?")
_WORD = re.compile(r"[^\W_]+")


def name_words(text: str | None) -> list[str]:
    """Folded words of a name; dots of initials that stand together go, the courtesy prefix too."""
    s = latin_fold(text)
    if "." in s:
        s = _DOTTED.sub(lambda m: m.group().replace(".", ""), s)
    if "/" in s or "(" in s:
        s = s.replace("m/s", " ").replace("s/a", "sa").replace("(p)", "pvt")
    return _WORD.findall(s)


def parse_name(text: str | None) -> tuple[str, str, str]:
    """(core words, trade words, legal form), each as a string of words, empty where missing.

    >>> parse_name("M/s Kargil  Takvenim Bkry (P) Ltd.")
    ('kargil takvenim', 'bakery', 'pvt ltd')
    """
    words = name_words(text)
    core: list[str] = []
    trade: list[str] = []
    legal: list[str] = []
    i, n = 0, len(words)
    while i < n:
        w = words[i]
        for way, code in _LEGAL_FIRST.get(w, ()):
            if (len(way) == 1 or tuple(words[i : i + len(way)]) == way) and (i or n == 1):
                legal.append(code)
                i += len(way)
                break
        else:
            code = _TRADES.get(w)
            if code:
                trade.append(code)
            elif w == "the" and i == 0 or w == "and" or w == "n" and i:
                pass
            else:
                core.append(w)
            i += 1
    if (len(core) > 2 or len(core) == 2 and not trade) and not _DEVANAGARI.search(text):
        kept = []
        for w in core:
            code = trade_near(w) if len(w) > 5 and w not in GIVEN_NAMES else None
            if code:
                trade.append(code)
            else:
                kept.append(w)
        core = kept or core
    if text and not text.isascii() and _DEVANAGARI.search(text):
        # Trade and legal form are translated between scripts, so they compare with nothing.
        trade, legal = [], []
    return " ".join(core), " ".join(sorted(set(trade))), " ".join(legal)


_ADDRESS_WORD = re.compile(r"[^\W\d_]+|\d+|[,;]|(?<=\s)[-–](?=\s)|#")
_SPLIT_CODE = re.compile(r"(?<!\d)(\d{3}) (\d{3})(?!\d)")
_UNIT_ID = re.compile(r"[a-z]")
#: A blank that may part a code; found faster than the code itself.
_SPLIT_BLANK = re.compile(r" (?=\d{3}(?!\d))(?<=\d{3} )")
_HNO = re.compile(r"\bh\.? ?no\b\.?|\bn[o°º]\b\.?")
_HYPHEN = re.compile(r"(?<=\w)-(?=[^\W\d_])")
#: What an address is read by, but figures; all other words stay as they are.
_ADDRESS_MARKS = frozenset((",", ";", "-", "–", "#", "nr")) | UNIT_WORDS | LANDMARK_WORDS | NUMBER_MARKERS | frozenset(NUMBER_WORDS)


def parse_address(text: str | None) -> tuple[str, str, str, str, str, str]:
    """(house number, street words, street type, city words, postcode, unit); empty where missing.

    >>> parse_address("Flat 3B, No. 540 Mirnikot Rd, Jiviford 34685")
    ('540', 'mirnikot', 'road', 'jiviford', '34685', '3b')
    """
    s = latin_fold(text)
    if s.strip(" ./-").replace("/", "") in FILLERS:
        return "", "", "", "", "", ""
    if _SPLIT_BLANK.search(s):
        s = _SPLIT_CODE.sub(r"\1\2", s)
    s = s.replace("'", "").replace(".", " ")
    if "no" in s or "°" in s or "º" in s:
        s = _HNO.sub(" no ", s)
    if "-" in s:
        s = _HYPHEN.sub(" ", s)
    words = _ADDRESS_WORD.findall(s)
    unit = postcode = number = stype = ""
    # Units, landmarks, postcodes and house numbers leave marks; what stays are words in segments.
    segments: list[list[str]] = [[]]
    holder = -1  # segment that has the house number
    at = 0  # position in that segment where the number stood
    i, n = 0, len(words)
    marked = False
    while i < n:
        w = words[i]
        if w not in _ADDRESS_MARKS and not w.isdigit():
            segments[-1].append(w)
            i += 1
            continue
        nxt = words[i + 1] if i + 1 < n else ""
        if w in (",", ";", "-", "–"):
            if segments[-1]:
                segments.append([])
        elif w in UNIT_WORDS and (nxt.isdigit() or nxt in ("no", "#") and i + 2 < n and words[i + 2].isdigit()):
            i += 1 if nxt.isdigit() else 2
            unit = words[i]
            if i + 2 < n and len(words[i + 1]) == 1 and words[i + 1].isalpha() and (words[i + 2] in (",", ";", "-", "#") or words[i + 2].isdigit()):
                unit += words[i + 1]
                i += 1
        elif w.isdigit() and nxt in ("st", "nd", "rd", "th") and i + 2 < n and words[i + 2] in ("floor", "fl"):
            unit = w
            i += 2
        elif w in LANDMARK_WORDS or w == "nr" and nxt.isalpha():
            j = i + 1
            while j < n and j < i + 5 and words[j] not in (",", ";", "-") and words[j] not in LANDMARK_NOUNS:
                j += 1
            i = j if j < n and words[j] in LANDMARK_NOUNS else min(j, i + 2) - (j < n and words[min(j, i + 2)] in (",", ";", "-"))
        elif w == "#":
            # '#40, 884 Tatgerrim' names a unit, '#665 Julgalket' the house.
            after = words[i + 2] if i + 2 < n else ""
            if nxt.isdigit() and after.isdigit() and len(after) < 5:
                unit = nxt
                i += 1
            elif nxt.isdigit() and after in (",", ";", "-") and any((x.isdigit() and len(x) < 5 or x in NUMBER_WORDS) and y not in UNIT_WORDS for y, x in zip(words[i + 2 :], words[i + 3 :])):
                unit = nxt
                i += 1
        elif w in NUMBER_MARKERS and (nxt.isdigit() or nxt in NUMBER_MARKERS or nxt in NUMBER_WORDS or nxt == "#"):
            marked = marked or nxt.isdigit()
        elif w.isdigit():
            if len(w) >= 5 and not (marked and not number and len(w) < 5):
                postcode = postcode or w
            elif not number:
                number, holder, at = w.lstrip("0") or "0", len(segments) - 1, len(segments[-1])
                marked = False
            else:
                unit = unit or w
        elif w in NUMBER_WORDS and not number and (nxt.isalpha() and (not segments[-1] or postcode) or segments[-1] and (len(segments[-1]) > 1 or not nxt.isalpha())):
            number, holder, at = NUMBER_WORDS[w], len(segments) - 1, len(segments[-1])
        else:
            segments[-1].append(w)
        i += 1
    segments = [x for x in segments if x] if holder < 0 or all(segments) else segments
    street: list[str] = []
    city: list[str] = []
    if holder >= 0 and holder < len(segments) and segments[holder]:
        seg = segments[holder]
        street, stype, rest = _street(seg, at)
        city = rest + [w for k, x in enumerate(segments) if k != holder for w in x]
    elif segments:
        # The number stands in a segment of its own, or there is none: the segment with a type.
        for k, seg in enumerate(segments):
            if seg and (seg[0] in _LEADING or any(w in _TYPES for w in seg[1:]) or any(w.endswith(_GLUED_CODES) for w in seg)):
                street, stype, rest = _street(seg, len(seg) if seg[0] in _LEADING else 0)
                city = rest + [w for m, x in enumerate(segments) if m != k for w in x]
                break
        else:
            filled = [x for x in segments if x]
            if number and filled:
                street, city = filled[0], [w for x in filled[1:] for w in x]
            else:
                city = [w for x in filled for w in x]
    return number, " ".join(street), stype, " ".join(city), postcode, unit


def _street(seg: list[str], at: int) -> tuple[list[str], str, list[str]]:
    """Street words, type and the other words of a segment (its city, where no comma parts them).

    ``at`` is the place of the house number among the words.
    """
    size = len(seg)
    if 0 < at < size:
        # The number inside: 'Fesju Creek 609 Kotfekse Drive', 'Calle Tesgorgo 98 Fembar del Rio'.
        head = seg[0] in _LEADING or _look_up(seg[0], _LEADING, _LEADING_NEAR, _LEADING_ENDS, 5) is not None
        if not head and size > at + 1 and (seg[at] in _LEADING or any(w in _TYPES for w in seg[at + 1 : at + 3])):
            street, stype, rest = _street(seg[at:], 0)
            return street, stype, seg[:at] + rest
    if at > 1:
        # The number behind: 'Calle Kedanvi 428', 'Ranu Alto Calle Mambiskot 857'.
        for k in range(at - 1):
            lead = _LEADING.get(seg[k]) or (_look_up(seg[k], _LEADING, _LEADING_NEAR, _LEADING_ENDS, 5) if k == 0 else None)
            lead = "avenida" if seg[k] in ("av", "ave") else lead
            if lead and at - k <= 3:
                return seg[k + 1 : at], lead, seg[:k] + seg[at:]
    if at >= 1:
        # 'Kukgekninstrasse 876', 'Foo Road 12'.
        street, rest = seg[:at], seg[at:]
        if len(street) > 1 and type_near(street[-1]):
            return street[:-1], type_near(street[-1]), rest
        street, stype = _glued(street[-1:])
        return street, stype, seg[: at - 1] + rest
    if size > 1:
        lead = _LEADING.get(seg[0]) or _look_up(seg[0], _LEADING, _LEADING_NEAR, _LEADING_ENDS, 5)
        lead = "avenue" if seg[0] in ("av", "ave") else lead
        if lead and not any(w in _TYPES for w in seg[1:3]):
            # '58 Avenue Niktatves'
            return seg[1:2], lead, seg[2:]
    for k in range(1, min(size, 4)):
        if seg[k] in _TYPES:
            return seg[:k], _TYPES[seg[k]], seg[k + 1 :]
    if size > 1 and type_near(seg[1]):
        return seg[:1], type_near(seg[1]), seg[2:]
    street, stype = _glued(seg[:1])
    return street, stype, seg[1:]


_GLUED_CODES = tuple(GLUED_TYPES)
_GLUED_WAYS = [(way, code) for code, short in GLUED_TYPES.items() for way in (code, *short.split())]
_GLUED_ENDS = tuple(way for way, _ in _GLUED_WAYS)


def _glued(street: list[str]) -> tuple[list[str], str]:
    last = street[-1]
    if last.endswith(_GLUED_ENDS):
        for way, code in _GLUED_WAYS:
            if last.endswith(way) and len(last) > len(way) + 2:
                return [*street[:-1], last[: -len(way)]], code
    return street, ""


def country_key(text: str | None) -> str:
    """Country as compared: folded, blanks at the ends off; empty if unknown."""
    return latin_fold(text).strip()
