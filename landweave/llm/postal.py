"""Postal addresses as typed tokens, whatever their spelling and order."""

from __future__ import annotations

import re

#: Usual abbreviations of directions, street types and units in postal addresses.
DIRECTIONS = {
    "N": "N", "NORTH": "N", "S": "S", "SOUTH": "S", "E": "E", "EAST": "E", "W": "W", "WEST": "W", "NE": "NE", "NORTHEAST": "NE", "NW": "NW", "NORTHWEST": "NW", "SE": "SE", "SOUTHEAST": "SE", "SW": "SW", "SOUTHWEST": "SW",
}
STREET_TYPES = {
    "ALLEY": "ALY", "ALY": "ALY", "AVENUE": "AVE", "AVE": "AVE", "AV": "AVE", "BOULEVARD": "BLVD", "BLVD": "BLVD", "BOUL": "BLVD", "CIRCLE": "CIR", "CIR": "CIR", "CIRC": "CIR", "COURT": "CT", "CT": "CT", "CRT": "CT", "COVE": "CV", "CV": "CV", "DRIVE": "DR", "DR": "DR", "DRV": "DR", "HIGHWAY": "HWY", "HWY": "HWY", "LANE": "LN", "LN": "LN", "LOOP": "LOOP", "PARKWAY": "PKWY", "PKWY": "PKWY", "PKY": "PKWY", "PLACE": "PL", "PL": "PL", "PLZ": "PLZ", "PLAZA": "PLZ", "POINT": "PT", "PT": "PT", "ROAD": "RD", "RD": "RD", "SQUARE": "SQ", "SQ": "SQ", "STREET": "ST", "ST": "ST", "STR": "ST", "TERRACE": "TER", "TER": "TER", "TERR": "TER", "TRAIL": "TRL", "TRL": "TRL", "TR": "TRL", "WAY": "WAY",
}
UNITS = {"APT", "APARTMENT", "UNIT", "STE", "SUITE", "#", "RM", "ROOM", "LOT"}
ORDINALS = {w: str(i) for i, w in enumerate("FIRST SECOND THIRD FOURTH FIFTH SIXTH SEVENTH EIGHTH NINTH TENTH ELEVENTH TWELFTH".split(), 1)}
STATES = {"FL", "FLA", "FLORIDA", "USA", "US"}
#: Codes of the states, which end an address.
STATE_CODES = frozenset("AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY".split())
#: Usual short forms of words in names of streets and places.
PLACE_WORDS = {"FT": "FORT", "LK": "LAKE", "MT": "MOUNT", "ST": "SAINT", "SPGS": "SPRINGS", "SPG": "SPRING", "HTS": "HEIGHTS", "HLS": "HILLS", "BCH": "BEACH", "PK": "PARK", "VLG": "VILLAGE", "JCT": "JUNCTION", "MDWS": "MEADOWS", "CRK": "CREEK", "RDG": "RIDGE", "MEM": "MEMORIAL", "JR": "JUNIOR"}
#: The place of an address whose street's name may end in it, as nothing stands between them.
OPEN = "?"

_BOX = re.compile(r"\b(?:P ?O ?B(?:OX)?|POST OFFICE BOX|P ?O BOX)(?: ?(?:NO|#))? ?#? ?(\d+)\b")
_CARE = re.compile(r"^(?:C/O|CARE OF|ATTN)\b[^0-9#]*?(?=\b(?:P ?O ?B|POST OFFICE|STE|SUITE|APT|APARTMENT|NO)\b|[0-9#])")
_ZIP = re.compile(r"\b(\d{5})(?:-\d{4})?$")
_TOKEN = re.compile(r"[A-Z0-9]+|#|,")
_ORDINAL = re.compile(r"^(\d+)(?:ST|ND|RD|TH)$")
_HALF = re.compile(r"\b(\d+)[ -](\d)/(\d)\b")
_NUMBER = re.compile(r"\d+(?:H\d\d)?[A-Z]?")
_UNIT_FIRST = re.compile(r"^(?:(?:(?:APT|APARTMENT|UNIT|STE|SUITE)\b ?#?|#) ?([A-Z0-9]+) ?,? ?(?=(?:NO )?\d)|(\d+) ?, ?(?=\d+ ))")


def parse(text: str | None) -> tuple[str, str, str, str, str, str, str] | None:
    """(number, direction, street, type, unit, city, zip), in canonical spelling, an absent part empty.

    A numbered post box has the number ``BOX n`` and no street. A care-of line, state and country are dropped. Halves
    and letters belong to the number. Where neither a street type nor a comma divides street and place, all words are
    the street's and the city is ``OPEN``. None for a text without a number."""
    if text is None:
        return None
    s = " ".join(text.upper().replace(".", " . ").split())
    s = re.sub(r"\b([A-Z]) \. (?=[A-Z] \.)", r"\1", s)
    s = " ".join(s.replace(" . ", " ").replace(" .", "").split())
    s = re.sub(r"\b([NS]) ([EW])\b", r"\1\2", s)
    s = _HALF.sub(r"\1H\2\3", s)
    s = _CARE.sub("", s)
    place = unit = ""
    if " - " in s:  # the place first
        place, _, s = s.partition(" - ")
        s = s.strip()
    if m := _UNIT_FIRST.match(s):
        unit, s = m[1] or m[2], s[m.end() :]
    if m := _BOX.search(s):
        number, rest = f"BOX {m[1]}", s[m.end() :] + " " + place
        street = kind = way = ""
    else:
        tokens = _TOKEN.findall(s)
        if tokens and tokens[0] == "NO":
            tokens = tokens[1:]
        at = next((i for i, t in enumerate(tokens) if t.isdigit()), None)
        lettered = next((i for i, t in enumerate(tokens) if _NUMBER.fullmatch(t)), None)
        if lettered is not None and (at is None or lettered < at) and (lettered == 0 or tokens[lettered - 1] == ","):
            at = lettered
        if at is None:
            return None
        number, tokens = tokens[at], tokens[at + 1 :]
        if len(tokens) > 1 and tokens[0] == "," :
            tokens = tokens[1:]
        way = kind = ""
        name: list[str] = []
        i, n = 0, len(tokens)
        if i < n - 1 and tokens[i] in DIRECTIONS and tokens[i + 1] not in STREET_TYPES and tokens[i + 1] != ",":
            way, i = DIRECTIONS[tokens[i]], i + 1
        comma = next((j for j in range(i + 1, n) if tokens[j] == "," or tokens[j] in UNITS), None)
        # a comma that a place follows ends the street
        divided = comma is not None and any(t.isalpha() and t not in STATES and t not in STATE_CODES and t not in UNITS for t in tokens[comma + 1 :])
        kinds = [j for j in range(i + 1, n if comma is None else comma) if tokens[j] in STREET_TYPES]
        end = None
        if kinds and divided and tokens[comma] == ",":
            end = kinds[-1]
        elif kinds:
            end = kinds[0]
            while end + 1 in kinds and (end + 2 >= n or tokens[end + 2] == "," or tokens[end + 2] in UNITS):
                end += 1
        opened = False
        if end is not None:
            name, kind, i = tokens[i:end], STREET_TYPES[tokens[end]], end + 1
        elif comma is not None and (divided or tokens[comma] in UNITS):
            name, i = tokens[i:comma], comma
        else:
            stop = next((j for j in range(i + 1, n) if tokens[j] == "," or tokens[j] in STATES or tokens[j].isdigit() or tokens[j] in STATE_CODES and (j + 1 == n or tokens[j + 1].isdigit())), n)
            name, i = tokens[i:stop], stop
            opened = len(name) > 1 and not place
        if len(name) > 1 and name[-1] in DIRECTIONS and not way:
            way, name = DIRECTIONS[name[-1]], name[:-1]
        if i < n and tokens[i] in DIRECTIONS and not way:
            way, i = DIRECTIONS[tokens[i]], i + 1
        street = " ".join(ORDINALS.get(t) or (m[1] if (m := _ORDINAL.match(t)) else t) for t in name)
        rest_tokens = tokens[i:]
        while rest_tokens and rest_tokens[0] == ",":
            rest_tokens = rest_tokens[1:]
        if rest_tokens and rest_tokens[0] in UNITS:
            k = 2 if len(rest_tokens) > 1 and rest_tokens[1] == "#" else 1
            if len(rest_tokens) > k:
                unit, rest_tokens = rest_tokens[k], rest_tokens[k + 1 :]
        if rest_tokens and rest_tokens[0] in DIRECTIONS and not way:
            way, rest_tokens = DIRECTIONS[rest_tokens[0]], rest_tokens[1:]
        rest = " ".join(rest_tokens) + " " + place
    words = [t for t in _TOKEN.findall(rest) if t != "," and t not in STATES]
    zip_ = next((t for t in words if len(t) == 5 and t.isdigit()), "")
    words = [t for t in words if not t.isdigit()]
    while words and words[-1] in STATE_CODES:
        words.pop()
    city = " ".join(words)
    if street and opened and not city:
        city = OPEN
    return number.lstrip("0") or "0", way, street, kind, unit.lstrip("0"), city, zip_
