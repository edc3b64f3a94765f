"""Names of people and organisations as comparable parts, whatever their spelling and order."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from landweave.llm.strings import osa

#: Usual short forms of given names.
NICKNAMES = {
    "ABBY": "ABIGAIL", "ANDY": "ANDREW", "DREW": "ANDREW", "TONY": "ANTHONY", "BARB": "BARBARA", "BARBIE": "BARBARA", "BEN": "BENJAMIN", "CHUCK": "CHARLES", "CHARLIE": "CHARLES", "CHRIS": "CHRISTINE", "TINA": "CHRISTINE", "CONNIE": "CONSTANCE", "CINDY": "CYNTHIA", "DAN": "DANIEL", "DANNY": "DANIEL", "DAVE": "DAVID", "DEB": "DEBORAH", "DEBBIE": "DEBORAH", "DON": "DONALD", "DOT": "DOROTHY", "DOTTIE": "DOROTHY", "ED": "EDWARD", "EDDIE": "EDWARD", "TED": "EDWARD", "NELL": "ELEANOR", "ELLIE": "ELEANOR", "BETH": "ELIZABETH", "BETTY": "ELIZABETH", "LIZ": "ELIZABETH", "LIZZIE": "ELIZABETH", "PACO": "FRANCISCO", "FRED": "FREDERICK", "GABY": "GABRIELA", "GREG": "GREGORY", "LUPE": "GUADALUPE", "HATTIE": "HARRIET", "NACHO": "IGNACIO", "JACKIE": "JACQUELINE", "JIM": "JAMES", "JIMMY": "JAMES", "JEN": "JENNIFER", "JENNY": "JENNIFER", "JACK": "JOHN", "JOHNNY": "JOHN", "JOE": "JOSEPH", "JUDY": "JUDITH", "KATE": "KATHERINE", "KATHY": "KATHERINE", "KATIE": "KATHERINE", "KEN": "KENNETH", "LARRY": "LAWRENCE", "LEN": "LEONARD", "LENNY": "LEONARD", "PEGGY": "MARGARET", "MAGGIE": "MARGARET", "MEG": "MARGARET", "MATT": "MATTHEW", "MIKE": "MICHAEL", "NICK": "NICHOLAS", "PAM": "PAMELA", "PAT": "PATRICIA", "TRISH": "PATRICIA", "PATTY": "PATRICIA", "PHIL": "PHILIP", "RAY": "RAYMOND", "BECKY": "REBECCA", "DICK": "RICHARD", "RICK": "RICHARD", "RICH": "RICHARD", "BOB": "ROBERT", "ROB": "ROBERT", "BOBBY": "ROBERT", "RON": "RONALD", "SAM": "SAMUEL", "STEVE": "STEVEN", "SUE": "SUSAN", "SUSIE": "SUSAN", "TERRY": "THERESA", "TESS": "THERESA", "TOM": "THOMAS", "TOMMY": "THOMAS", "TIM": "TIMOTHY", "VICKY": "VICTORIA", "GINNY": "VIRGINIA", "WALT": "WALTER", "BILL": "WILLIAM", "WILL": "WILLIAM", "BILLY": "WILLIAM", "MARTY": "MARTHA",
}
#: Further given names without a short form of their own.
GIVEN = frozenset("BRIAN CARLOS ELLEN FATIMA GLORIA HELEN INGRID IVAN KEITH LUIS MARTHA OLGA OMAR PRIYA RUTH WEI MARIA MARY LINDA KAREN NANCY LISA SANDRA MARK PAUL GEORGE KEVIN JASON GARY ERIC FRANK SCOTT JOSE ANNA ROSE ALICE JUAN CARMEN HENRY PETER".split()) | frozenset(NICKNAMES.values())
GENERATIONS = {"JR": "JR", "JUNIOR": "JR", "SR": "SR", "SENIOR": "SR", "II": "II", "III": "III", "IV": "IV"}
TITLES = frozenset("DR MR MRS MS MISS".split())
#: Usual abbreviations of words in company names.
BUSINESS = {
    "ASSOCIATES": "ASSOCIATES", "ASSOC": "ASSOCIATES", "ASSOCS": "ASSOCIATES", "BUILDERS": "BUILDERS", "BLDRS": "BUILDERS", "BLDR": "BUILDERS", "COMPANY": "COMPANY", "CO": "COMPANY", "CONSTRUCTION": "CONSTRUCTION", "CONSTR": "CONSTRUCTION", "CONST": "CONSTRUCTION", "DEVELOPMENT": "DEVELOPMENT", "DEVEL": "DEVELOPMENT", "DEV": "DEVELOPMENT", "ENTERPRISES": "ENTERPRISES", "ENTERP": "ENTERPRISES", "ENT": "ENTERPRISES", "GROUP": "GROUP", "GRP": "GROUP", "HOLDINGS": "HOLDINGS", "HLDGS": "HOLDINGS", "HLDG": "HOLDINGS", "INVESTMENTS": "INVESTMENTS", "INVESTMENT": "INVESTMENTS", "INVEST": "INVESTMENTS", "INV": "INVESTMENTS", "LAND": "LAND", "MANAGEMENT": "MANAGEMENT", "MGMT": "MANAGEMENT", "MGT": "MANAGEMENT", "PARTNERS": "PARTNERS", "PTNRS": "PARTNERS", "PTRS": "PARTNERS", "PROPERTIES": "PROPERTIES", "PROPS": "PROPERTIES", "PROP": "PROPERTIES", "REALTY": "REALTY", "RLTY": "REALTY", "SERVICES": "SERVICES", "SVCS": "SERVICES", "TRUST": "TRUST", "AGENT": "AGENTS", "AGENTS": "AGENTS", "REGISTERED": "REGISTERED", "REG": "REGISTERED", "CORPORATE": "CORPORATE", "FILINGS": "FILINGS",
}
PUBLIC = frozenset("STATE COUNTY CITY TOWN COMMISSION BOARD DISTRICT AUTHORITY DEPARTMENT RESERVE SCHOOL TRANSPORTATION UTILITIES UTILITY PARK COUNCIL WATER AGENCY BUREAU OFFICE HOUSING FIRE".split())
#: Usual abbreviations of words in names of public bodies.
PUBLIC_SHORT = {"DEPT": "DEPARTMENT", "DPT": "DEPARTMENT", "CTY": "COUNTY", "CNTY": "COUNTY", "AUTH": "AUTHORITY", "COMM": "COMMISSION", "COMMN": "COMMISSION", "DIST": "DISTRICT", "TRANSP": "TRANSPORTATION", "BD": "BOARD"}
NUMERALS = {"II": "2", "III": "3", "IV": "4", "V": "5", "VI": "6", "VII": "7", "VIII": "8", "IX": "9", "X": "10", "ONE": "1", "TWO": "2", "THREE": "3", "FOUR": "4", "FIVE": "5", "SIX": "6", "SEVEN": "7", "EIGHT": "8", "NINE": "9", "TEN": "10"}

_FORMS = (
    (re.compile(r"\bLIMITED LIABILITY (?:COMPANY|CO)\b|\bL ?L ?C\b"), " LLC "),
    (re.compile(r"\b(?:LIMITED|LTD) (?:PARTNERSHIP|PTNRSHP)\b|\bL ?P\b|\bL ?L ?L ?P\b"), " LP "),
    (re.compile(r"\b(?:INCORPORATED|INC|CORPORATION|CORP)\b"), " CORP "),
)
_TAIL = re.compile(r"\bET (?:AL|UX|VIR)\b|\((?:FL|FLA|FLORIDA)\)")


class Name(NamedTuple):
    """kind P: core is the surname, first, middle and last of generation in extra; kind O: core without blanks, the
    business words in first, the number in middle, the legal form in extra."""

    kind: str
    core: str
    first: str
    middle: str
    extra: str


def squeezed(text: str) -> str:
    """Letters and digits in upper case, words kept apart, without the legal form."""
    s = re.sub(r"[^A-Z0-9]+", " ", text.upper())
    for pattern, _ in _FORMS:
        s = pattern.sub(" ", s)
    return s


@lru_cache(200_000)
def given_name(token: str) -> str:
    """The full form of a given name, also of one with a typing error; empty if it is none."""
    if token in NICKNAMES:
        return NICKNAMES[token]
    if token in GIVEN:
        return token
    if len(token) < 4:
        return ""
    best = sorted((osa(token, g, 2), g) for g in _FULL if abs(len(g) - len(token)) <= 2)
    if best and (best[0][0] == 1 or best[0][0] == 2 and len(token) >= 7) and (len(best) == 1 or best[1][0] > best[0][0]):
        return NICKNAMES.get(best[0][1], best[0][1])
    return ""


_FULL = sorted(GIVEN | {n for n in NICKNAMES if len(n) >= 5})
_FULL_BUSINESS = [b for b in sorted(set(BUSINESS.values())) if len(b) >= 6]


def _organisation(text: str) -> Name | None:
    s = re.sub(r"[^A-Z0-9]+", " ", text)
    form = ""
    for pattern, name in _FORMS:
        if pattern.search(s):
            form = form or name.strip()
            s = pattern.sub(" ", s)
    core, business, number = [], [], ""
    for t in s.split():
        if t in ("THE", "AND", "OF", "NO"):
            continue
        t = PUBLIC_SHORT.get(t, t)
        if t in PUBLIC:
            business.append(t)
        elif t.isdigit():
            number = t.lstrip("0") or "0"
        elif core and t in NUMERALS:
            number = NUMERALS[t]
        elif t in BUSINESS:
            business.append(BUSINESS[t])
        else:
            core.append(t)
    if not business and len(core) > 1:
        for i, t in enumerate(core):
            if len(t) >= 5 and (near := [b for b in _FULL_BUSINESS if osa(t, b, 2) <= 1 + (len(t) > 8)]):
                business, core = [near[0]], core[:i] + core[i + 1 :]
                break
    if not core:
        core, business = business, []
    return Name("O", "".join(core), " ".join(sorted(business)), number, form) if core else None


def parse_name(text: str | None) -> Name | None:
    """The parts of a name; None for a null name or one without a letter. Where neither a comma, an initial nor a known
    given name tells which of two words is the surname, it is the first in alphabetical order."""
    read = read_name(text)
    return read and read[0]


def read_name(text: str | None) -> tuple[Name, Name | None] | None:
    """The parts of a name, and, where its words could as well be in the other order, the parts in that order."""
    if text is None:
        return None
    s = _TAIL.sub(" ", " ".join(text.upper().replace("'", "").split()))
    tokens = re.findall(r"[A-Z0-9]+", s.replace(".", " "))
    if not any(t.isalpha() for t in tokens):
        return None
    joined = " ".join(tokens)
    if any(t in BUSINESS or t in PUBLIC or t in PUBLIC_SHORT or t.isdigit() for t in tokens) or "&" in s or any(p.search(joined) for p, _ in _FORMS):
        whole = _organisation(joined)
        return whole and (whole, None)
    generation = next((GENERATIONS[t] for t in tokens if t in GENERATIONS), "")
    comma = s.find(",")
    left = [t for t in re.findall(r"[A-Z]+", s[:comma].replace("-", "")) if t not in TITLES and t not in GENERATIONS] if comma >= 0 else []
    words = [t for t in re.findall(r"[A-Z]+", s.replace("-", "")) if t not in TITLES and t not in GENERATIONS]
    if not words:
        return None
    long_ = [t for t in words if len(t) > 1]
    if len(left) >= 1 and len(words) > len(left):
        last, rest = "".join(left), words[len(left) :]
    elif len(long_) == 1:
        last = long_[0]
        rest = [t for t in words if t != last]
    elif not long_:
        return Name("P", "".join(words), "", "", generation), None
    elif len(words) == 2 and words[0] != words[1] and (known := [w in NICKNAMES or w in GIVEN for w in words])[0] == known[1] and (known[0] or bool(given_name(words[0])) == bool(given_name(words[1]))):
        a, b = sorted(words)
        return tuple(Name("P", last, given_name(first) or first, "", generation) for last, first in ((a, b), (b, a)))
    else:
        a, b = words[0], words[-1] if len(words[-1]) > 1 else long_[-1]
        ga, gb = given_name(a) if len(a) > 1 else "", given_name(b)
        exact_b = b in NICKNAMES or b in GIVEN
        exact_a = a in NICKNAMES or a in GIVEN
        first_is_given = len(a) == 1 or exact_a and not exact_b or bool(ga) and not gb or (bool(ga) == bool(gb) and len(words) > 2 and len(words[-1]) > 1)
        if first_is_given:
            last, rest = b, [t for t in words if t != b] if b != a else words[:-1]
        else:
            last, rest = a, words[1:]
    first = rest[0] if rest else ""
    middle = rest[1][0] if len(rest) > 1 else ""
    return Name("P", last, given_name(first) or first, middle, generation), None
