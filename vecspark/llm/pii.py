"""Personal information inside free text.

Regular expressions propose spans of e-mail addresses, phone numbers, identity
numbers, street addresses and names.  A proposal's form gives it a score that is
not always enough: checksums (Luhn, modulo 97, letter of modulo 23) and lengths
confirm numbers, words and findings nearby speak for or against any span.  Spans
that reach THRESHOLD are returned, or replaced by typed placeholders.  So a
number whose check fails needs a word that says what it is, and a known given
name needs a family name that is known or formed like one, or such a word.

Names are known from a register (members' given and family names, which a model
of endings generalises) and from a short list of common given names.  A register
of up to REGISTER names travels with the tasks; a larger one is joined to the
words of each text.  Members themselves are public persons and no findings.

Defined cases: null, empty and blank texts have no findings and stay as they
are; whole texts are searched; of overlapping spans the earlier kind in KINDS
wins, then the longer; a span's text is returned once per document and kind,
exactly as it is; repeated rows count each in ``masked`` and once in ``found``;
members with a blank name exclude nobody.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.6
KINDS = ("email", "address", "idno", "phone", "name")
#: Names of each kind that travel with the tasks; a larger register is joined.
#: The model of endings is fitted to as many, those with the smallest hashes.
REGISTER = 100_000

_S = r"(?:\r\n|\s)"  # a single white space, which may be a line break
_W = r"[^\W\d_a-zß-öø-ÿ][\w\xad]*(?:[-’'][^\W\d_a-zß-öø-ÿ][\w\xad]*)*"  # a capitalised word

_DOT = rf"(?:\.|{_S}?[\[(]{_S}?(?:dot|punkt|point|punto){_S}?[\])]{_S}?|{_S}(?:dot|punkt|point|punto){_S})"
_LOCAL = r"(?<![\w.+\-])[\w][\w.+\-]*"
_LABEL = r"[\w\-]+"
EMAIL = [
    re.compile(rf"{_LOCAL}@{_LABEL}(?:\.{_LABEL})+"),
    re.compile(rf"{_LOCAL}{_S}?[\[(]{_S}?(?:at|arroba|@){_S}?[\])]{_S}?{_LABEL}(?:{_DOT}{_LABEL})+", re.I),
    re.compile(rf"{_LOCAL}{_S}(?:at|arroba){_S}{_LABEL}(?:{_S}(?:dot|punkt|point|punto){_S}{_LABEL})+", re.I),
]

_B, _E = r"(?<![\w+/.\-])", r"(?![\w/])(?!-\d)"
PHONE = [
    re.compile(p)
    for p in (
        rf"(?<![\w+])\+\d{{1,3}}{_S}?\(\d{{1,4}}\){_S}?\d{{3}}[- ]\d{{4}}{_E}",
        rf"(?<![\w+])\+\d{{1,3}}(?:{_S}\d{{1,4}}){{1,2}}(?:{_S}\d{{2,4}}){{1,3}}{_E}",
        rf"(?<![\w+])\+\d{{1,3}}(?:[.\-]\d{{2,4}}){{2,4}}{_E}",
        rf"(?<![\w+])\+\d{{9,14}}{_E}",
        rf"{_B}00[1-9]\d{{9,12}}{_E}",
        rf"{_B}\(0\d{{2,4}}\){_S}?\d{{3}}[-\s]?\d{{3,4}}{_E}",
        rf"{_B}0\d{{2,4}}/\d{{3,5}}(?:-\d{{2,4}})?{_E}",
        rf"{_B}0\d{{2,4}}{_S}\d{{3}}{_S}\d{{2}}{_S}\d{{2}}{_E}",
        rf"{_B}0\d{{2,4}}{_S}\d{{6,8}}{_E}",
        rf"{_B}\d{{3}}-\d{{4}}{_E}",
    )
]
#: Forms that are also those of bills, votes and budget lines.
_SHORT = PHONE[-1]
_SLASHED = PHONE[6]
_ABROAD = PHONE[:5]

IDNO = [
    re.compile(p)
    for p in (
        rf"{_B}\d{{11}}{_E}",
        rf"{_B}\d{{4}}{_S}\d{{3}}{_S}\d{{4}}{_E}",
        rf"{_B}[A-Z]{{2}}-\d{{2}}-\d{{6}}-[A-Z]{_E}",
        rf"{_B}[A-Z]\d{{7}}{_E}",
        rf"{_B}\d{{2}}/\d{{6}}/\d{{2}}{_E}",
        rf"{_B}\d{{6}}-\d{{4}}{_E}",
        rf"{_B}[A-Z]\d{{2}}[A-Z]\d{{4}}[A-Z]{_E}",
        rf"{_B}\d{{8}}-?[A-Z]{_E}",
        rf"{_B}\d{{3}}-\d{{2}}-\d{{4}}{_E}",
    )
]

ADDRESS = [
    re.compile(p)
    for p in (
        rf"{_B}\d{{1,4}}[A-Za-z]?{_S}(?:{_W}{_S}){{1,3}}(?:(?:Row|Lane|Street|Avenue|Close|Road|Drive|Way|Court|Square|Terrace|Crescent|Gardens)\b|(?:St|Ave|Rd|Dr|Ln)\.)",
        rf"(?<![\w\-]){_W}(?:(?:straße|strasse|gasse|weg|platz|allee|ring|ufer|damm)|str\.){_S}\d{{1,4}}[a-z]?\b",
        rf"(?<![\w\-])[\w\xad]+-(?:Allee|Straße|Strasse|Gasse|Weg|Platz|Ring|Ufer|Damm|Str\.){_S}\d{{1,4}}[a-z]?\b",
        rf"{_B}\d{{1,4}}(?:{_S}(?:bis|ter|quater))?,?{_S}(?:rue|avenue|impasse|chemin|boulevard|allée|quai|place|square|cours|route){_S}(?:de{_S}la{_S}|de{_S}l['’]|de{_S}|du{_S}|des{_S}|d['’])?{_W}",
        rf"(?<![\w/])(?:C/|[Cc]alle|[Aa]venida|[Aa]vda\.|[Pp]laza|[Pp]aseo|[Cc]amino|[Rr]onda){_S}(?:de{_S}la{_S}|de{_S}|del{_S})?{_W},?{_S}(?:n\.?º{_S}?|núm\.{_S}?)?\d{{1,4}}[A-Za-z]?\b",
    )
]

# Context words (fixed values), by class and in English, German, French, Spanish.

#: Words before a number that make it something else than a person's.
_OTHER = re.compile(
    r"(?:\b(?:bills?|docket|votes?|voted|stood at|lot|form|room|serial|budget line|line|section|clause|annex|number of|invoice|order|"
    r"titel|anlage|drucksache|aktenzeichen|abstimmung endete|endete|raum|kapitel|rechnung|paragraf|"
    r"dossier|annexe|ligne|scrutin|salle|facture|article|expediente|anexo|partida|resultado fue|fue|votación|sala|factura)"
    r"\W{0,3}(?:no\.?|nr\.?|n\.º|n°)?\s*)$",
    re.I,
)
#: Words that say that a phone number follows.
_CALL = re.compile(
    r"(?:\b(?:tel|telephone|phone|(?<!roll )call|dial|ring|try|fax|mobile|cell|(?:\w+ )?line is|reached (?:at|on|under)|"
    r"telefon\w*|ruf\w*|anruf\w*|handy|erreich\w+|unter|tél|téléphone|appel\w+|joindre|portable|"
    r"teléfono|móvil|llam\w+)\b)\.?(?:[^.!?]|\.(?!\s)|(?<=\b[A-Z])\.){0,50}$",
    re.I,
)
#: Words near an identity number.
_IDENTITY = re.compile(
    r"\b(?:cards?|passport|insur\w+|citizen|identity|\bid\b|social security|licen[cs]e|born|account holder|on (?:the|his|her) form|records?|"
    r"ausweis\w*|personalausweis|reisepass|versicher\w+|steuer\w*|geboren|formular|"
    r"carte|passeport|assur\w+|sécurité sociale|né|née|dossier|"
    r"dni|nie|cédula|documento|pasaporte|seguro|nacid[oa]|ficha)\b",
    re.I,
)
#: Roles of private persons.
_ROLE = (
    r"(?:land(?:lord|lady)|tenant|neighbou?r|constituent|patient|client|customer|(?:account |card )?holder|witness|applicant|petitioner|owner|"
    r"employee|worker|pensioner|retiree|widow(?:er)?|nurse|fisher|farmer|teacher|driver|student|baker|clerk|carpenter|doctor|"
    r"vermieter(?:in)?|mieter(?:in)?|nachbar(?:in)?|rentner(?:in)?|zeug(?:e|in)|patient(?:in)?|kund(?:e|in)|antragsteller(?:in)?|lehrer(?:in)?|"
    r"locataire|propriétaire|voisine?|témoin|titulaire|retraitée?|assurée?|infirmi(?:er|ère)|"
    r"inquilin[oa]|vecin[oa]|testigo|titular|jubilad[oa]|pensionista|maestr[oa])"
)
_PERSONAL = re.compile(rf"\b(?:{_ROLE}|(?:on|auf) (?:the|dem) form\w*|formular|dossier|ficha|witness|contact|kontakt|contacto)\b", re.I)
#: Words before a person's name: contact and letters, roles, labels of forms,
#: clauses that single a person out.
_BEFORE = re.compile(
    r"(?:(?:spoke (?:with|to)|talked (?:with|to)|heard from|met(?: with)?|(?:due|grateful|indebted) to|(?:letter|call|message|complaint|petition|mail) from|"
    r"(?:evidence|statement|testimony|file|case|name|letter|death|and) of|on behalf of|according to|signed(?: by)?|"
    r"dank gilt|schrieb|schreibt|gesprochen mit|brief von|erreichen|laut|meldete|gemeldet hat das|im namen von|"
    r"remercie|joindre|(?:lettre|plainte|appel|témoignage|nom) de|parlé avec|au nom de|selon|"
    r"gracias a|(?:carta|teléfono|nombre|denuncia|queja) de|escribió|hablé con|según"
    rf"|\b{_ROLE}(?: is| ist| est| es|,|:)?"
    r"|(?:witness|name|contact|stands|formular|dossier|nom|témoin|ficha|nombre|testigo|contacto|kontakt|zeuge)\s?:|record show that"
    r"|\bit was|\bwhen|, as|\bwer|\bc['’]est|\bfue)\s+)$",
    re.I,
)
#: What follows a person's name: ways to reach the person, documents, speech,
#: roles, places of living.
_AFTER = re.compile(
    r"\s*(?:can be reached|may be reached|\(|–|;"
    r"|, (?:passport|card|born|aged|carte|passeport|née?|con documento|con dni|versicherungsnummer|ausweis|geboren)\b"
    r"|(?:asked|told the|wrote to|received|called|kennt,|fragte|demande|pregunta)"
    rf"|, (?:a |an |the )?{_ROLE}\b"
    r"|(?:unter|aus|au)\s|, de\s)",
    re.I,
)
#: Common given names (fixed values).
GIVEN = frozenset(
    "adam alice amanda amelia andrea andreas andrew anna anne antonio barbara benjamin bernard brigitte carlos carmen caroline catherine "
    "charles charlotte christian christine christopher claire claudia daniel david deborah diego dorothy edward eleanor elena elizabeth "
    "emily emma enrique eric eva fernando francisco françois franz george gerhard hannah hans heather heinrich helen helga henry ingrid "
    "isabel isabelle jacob jacques james javier jean jennifer jessica johann john jonathan jorge joseph josé juan julia julie jürgen karen "
    "karl katharina kenneth klaus laura linda lucía luis manuel marcel margaret maria marie marta martin mary matthew maría michael michel "
    "miguel monika nancy nathalie nicholas nicolas olivia pablo patricia paul pedro peter philippe pierre rachel rafael rebecca renate "
    "richard robert samuel sandra sarah sofía sophie stefan stephen susan susanne teresa thomas timothy ursula victoria virginia walter "
    "werner wilhelm william wolfgang yves".split()
)
#: Words after a given name that make both a body or a place (fixed values).
_BODIES = {"agency", "council", "commission", "authority", "board", "office", "committee", "party", "street", "road", "bridge", "act", "avenue",
           "amt", "rat", "behörde", "straße", "partei", "agence", "conseil", "rue", "junta", "calle", "partido", "ministry", "university",
           "hospital", "school", "college", "club", "union", "bank"}
_PARTICLE = rf"(?:{_S}(?:de|del|della|di|da|du|la|le|van|von|der|den|[^\W\d_a-zß-ÿ]\.))"
_WORD = re.compile(rf"(?<![\w’'\-])({_W})")
_C = re.compile(r"[cdlCDLqQ][’']$")
_FAMILY = re.compile(rf"({_PARTICLE}*){_S}({_W})")
_GIVEN = re.compile(rf",{_S}({_W})(?:{_S}[^\W\d_a-zß-ÿ]\.(?={_S}))*")
_TITLES = {"speaker", "president", "chair", "port", "saint", "upper", "lower", "new", "old", "mr", "mrs", "ms", "dr", "herr", "frau", "hon", "señor", "señora", "sr", "sra", "mme", "m", "monsieur",
           "madame", "sir", "lady", "the", "die", "der", "das", "when", "wer", "it", "c'est", "c’est"}


#: Cheap tests for what a text must hold before patterns are tried on it.
_AT = re.compile(r"[\[(]\s{0,2}(?:at|arroba|@)\s{0,2}[\])]", re.I)
_AT_WORD = re.compile(r"\s(?:at|arroba)\s{1,2}[\w\-]+\s{1,2}(?:dot|punkt|point|punto)\s", re.I)
_STREET = (
    ("Row", "Lane", "Street", "Avenue", "Close", "Road", "Drive", "Way", "Court", "Square", "Terrace", "Crescent",
     "Gardens", "St.", "Ave.", "Rd.", "Dr.", "Ln."),
    ("straße", "strasse", "gasse", "weg", "platz", "allee", "ring", "ufer", "damm", "str."),
    ("-Allee", "-Stra", "-Gasse", "-Weg", "-Platz", "-Ring", "-Ufer", "-Damm", "-Str."),
    ("rue", "avenue", "impasse", "chemin", "boulevard", "allée", "quai", "place", "square", "cours", "route"),
    ("C/", "alle", "venida", "vda.", "laza", "aseo", "amino", "onda"),
)
_NUMBER = re.compile(r"\d(?:[-/.]|\)?(?:\r\n|\s)\(?|\))\d|\d{7}|[A-Z]\d{2}[A-Z]|[A-Z]{2}-\d{2}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(digits: str) -> bool:
    """ISO 7064: the whole leaves 1, or the last two complement the rest."""
    return len(digits) > 3 and (int(digits) % 97 == 1 or (int(digits[:-2]) + int(digits[-2:])) % 97 == 0)


def letter23(number: str) -> bool:
    """A last letter that says the digits' rest modulo 23."""
    digits = re.sub(r"\D", "", number)
    return bool(digits) and number[-1:].isalpha() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23] == number[-1:]


class Endings:
    """How often names and places end in the same 2 to 4 letters."""

    def __init__(self, names: list[str], places: list[str]):
        self.names, self.places = Counter(self._of(names)), Counter(self._of(places))

    @staticmethod
    def _of(words: list[str]) -> Iterator[str]:
        return (w[-n:] for w in words if len(w) > 4 for n in (2, 3, 4))

    def likely(self, word: str, least: int) -> bool:
        """Whether the longest ending of ``least`` letters or more that was
        seen belongs to names rather than to places."""
        for n in range(4, least - 1, -1):
            a, b = self.names[word[-n:]], self.places[word[-n:]]
            if a or b:
                return 2 * a >= b
        return False


class Register:
    """Known given names, family names and words of places."""

    def __init__(self, given: Iterable[str], family: Iterable[str], places: Iterable[str], endings: Endings | None = None):
        self.given, self.family = set(given), set(family)
        self.places = {w for p in places for w in p.split()}
        self.endings = endings or Endings(sorted(self.family), sorted(self.places))


def _plain(word: str) -> str:
    return word.replace("\xad", "").lower()


def _name_score(r: Register, given: str, family: str, before: str, after: str) -> float:
    parts = given.split("-")
    if {given, family, *parts} & _TITLES or {given, family, *parts} & r.places or family in _BODIES:
        return 0.0
    score = 0.4 * (given in r.given or any(p in r.given for p in parts))
    if any(p in GIVEN for p in parts):
        score = 0.6
    if family in r.family:
        score += 0.3
    elif r.endings.likely(family, 3):
        score += 0.25
    weak = 0.2 if not score and r.endings.likely(family, 2) else 0.0
    if score >= THRESHOLD or not score + weak:  # words nearby decide nothing
        return score
    return score + weak + 0.4 if _BEFORE.search(before) or _AFTER.match(after) else score


def _names(text: str, r: Register) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, given, family) of names in either order."""
    for m in _WORD.finditer(text):
        at, end, word = m.start(), m.end(), m.group()
        cut = _C.match(word[:2])
        if cut:  # an article or the like joined by an apostrophe
            at += 2
            word = word[2:]
        first = _plain(word)
        f = _FAMILY.match(text, end)
        if f:
            family = _plain(f.group(2))
            score = _name_score(r, first, family, text[max(0, at - 30) : at], text[f.end() : f.end() + 25])
            if score >= THRESHOLD:
                yield at, f.end(), first, family
                continue
        g = _GIVEN.match(text, end)
        if g:
            given = _plain(g.group(1))
            before = text[max(0, at - 30) : at]
            if given in r.given or given in GIVEN or _BEFORE.search(before):
                score = _name_score(r, given, first, before, text[g.end() : g.end() + 25])
                if score >= THRESHOLD:
                    yield at, g.end(), given, first


def spans(text: str | None, r: Register) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, given, family) of all findings, in order, without
    overlaps; names of members are still among them."""
    if not text:
        return []
    got: list[tuple[int, int, str, str, str]] = []

    def add(a: int, b: int, kind: str, given: str = "", family: str = "") -> None:
        if all(b <= x[0] or a >= x[1] for x in got):
            got.append((a, b, kind, given, family))

    def matches(patterns: list[re.Pattern[str]]) -> list[re.Match[str]]:
        found = [m for p in patterns for m in p.finditer(text)]
        return sorted(found, key=lambda m: (m.start(), -m.end()))

    emails = [p for p, on in zip(EMAIL, ("@" in text, _AT.search(text), _AT_WORD.search(text))) if on]
    if emails:
        for m in matches(emails):
            add(m.start(), m.end(), "email")
    streets = [p for p, words in zip(ADDRESS, _STREET) if any(w in text for w in words)]
    if streets:
        for m in matches(streets):
            add(m.start(), m.end(), "address")
    if _NUMBER.search(text):
        for kind, patterns, score in (("idno", IDNO, _idno_score), ("phone", PHONE, _phone_score)):
            for m in matches(patterns):
                # another finding just before makes a record of a person likely
                beside = any(0 <= m.start() - x[1] <= 12 for x in got)
                if score(m, text, beside) >= THRESHOLD:
                    add(m.start(), m.end(), kind)
    for a, b, given, family in _names(text, r):
        add(a, b, "name", given, family)
    return sorted(got)


def _idno_score(m: re.Match[str], text: str, beside: bool) -> float:
    number = m.group()
    digits = re.sub(r"\D", "", number)
    before, after = text[max(0, m.start() - 80) : m.start()], text[m.end() : m.end() + 40]
    valid = luhn(digits) or mod97(digits) or letter23(number)
    cue = _IDENTITY.search(before) or _IDENTITY.search(after)
    return 0.4 + 0.25 * valid + 0.3 * bool(cue) + 0.2 * beside - 0.5 * bool(_OTHER.search(before))


def _phone_score(m: re.Match[str], text: str, beside: bool) -> float:
    number = m.group()
    n = sum(c.isdigit() for c in number)
    before = text[max(0, m.start() - 60) : m.start()]
    called = bool(_CALL.search(before))
    personal = beside or bool(_PERSONAL.search(before))
    if m.re is _SHORT or m.re is _SLASHED and "-" not in number:
        score = 0.3 + 0.35 * called + 0.3 * personal
    else:
        whole = 8 <= n - 2 * number.startswith("00") <= 15 if m.re in _ABROAD else 8 <= n <= 12
        score = 0.45 + 0.2 * whole + 0.2 * called + 0.1 * personal
    return score - 0.5 * bool(_OTHER.search(before))


def _names_of(names: DataFrame, c: str) -> DataFrame:
    """(w): the distinct non-blank names, or words of places, in column ``c``."""
    plain = F.lower(F.trim(c))
    words = names.select((F.explode(F.split(plain, r"\s+")) if c == "constituency" else plain).alias("w"))
    return words.where(F.col("w") != "").distinct()


_KINDS_OF_NAMES = ("given_name", "family_name", "constituency")


def register(names: DataFrame) -> tuple[Register, bool]:
    """The register of a table of given_name, family_name, constituency, and
    whether it is whole: of more than REGISTER names a kind only the model of
    endings is there."""
    known = [
        [x["w"] for x in _names_of(names, c).orderBy(F.xxhash64("w"), "w").limit(REGISTER + 1).collect()]
        for c in _KINDS_OF_NAMES
    ]
    whole = all(len(k) <= REGISTER for k in known)
    endings = Endings(known[1], known[2])
    return Register(*(known if whole else ([], [], [])), endings), whole


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def _with_known(base: DataFrame, names: DataFrame) -> DataFrame:
    """``base`` with the words of each text that the register knows, of every
    kind; by joins, for a register of any size."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                found = {w for m in re.finditer(_W, t or "") for w in (_plain(m.group()), _plain(m.group()[2:]))}
                found |= {p for w in found for p in w.split("-")}
                rows += [i] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(out, pa.string())], ["doc", "w"])

    keyed = base.withColumn("doc", F.xxhash64("text"))
    used = keyed.where("text is not null").select("doc", "text").mapInArrow(words, "doc long, w string").distinct()
    known = None
    for k, c in enumerate(_KINDS_OF_NAMES):
        own = used.join(_names_of(names, c), "w").select("doc", "w", F.lit(k).alias("k"))
        known = own if known is None else known.unionByName(own)
    # of one text's words, so bounded by the text
    known = known.groupBy("doc").agg(*(F.collect_set(F.when(F.col("k") == k, F.col("w"))).alias(f"known{k}") for k in range(3)))
    return keyed.join(known, "doc", "left").select("id", "text", "known0", "known1", "known2")


def _registers(b: pa.RecordBatch, r: Register) -> Iterator[Register]:
    """The register of each text of a batch."""
    if b.num_columns == 2:
        while True:
            yield r
    for known in zip(*(b.column(2 + k).to_pylist() for k in range(3))):
        yield Register(*(k or [] for k in known), r.endings)


def _all_spans(base: DataFrame, r: Register, keep: str = "id") -> DataFrame:
    """(keep, start, end, pii_type, pii_text, given, family) of all findings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, got, texts = [], [], []
            for i, (t, own) in enumerate(zip(b.column(1).to_pylist(), _registers(b, r))):
                for x in spans(t, own):
                    rows.append(i)
                    got.append(x)
                    texts.append(t[x[0] : x[1]])
            at, to, kinds, given, family = zip(*got) if got else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(at, pa.int32()), pa.array(to, pa.int32()),
                 *(pa.array(c, pa.string()) for c in (kinds, texts, given, family))],
                ["id", "start", "end", "pii_type", "pii_text", "given", "family"],
            )

    id_type = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(run, f"id {id_type}, start int, end int, pii_type string, pii_text string, given string, family string")


def _public(members: DataFrame) -> DataFrame:
    """(given, family, pii_type) of members who have both names."""
    return members.select(
        F.lower(F.trim("given_name")).alias("given"), F.lower(F.trim("family_name")).alias("family"), F.lit("name").alias("pii_type")
    ).where("given <> '' and family <> ''").distinct()


def found(docs: DataFrame, members: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pii_type, pii_text), each once per document."""
    r, whole = register(members)
    base = _base(docs, id_col, text_col)
    rows = _all_spans(base if whole else _with_known(base, members), r)
    return (
        rows.join(_public(members), ["given", "family", "pii_type"], "left_anti")
        .select(F.col("id").alias(id_col), "pii_type", "pii_text").distinct()
    )


def _mask(text: str | None, found: Iterable[tuple[int, int, str]]) -> str | None:
    at, parts = 0, []
    for a, e, kind in found:
        parts += [text[at:a], f"[{kind.upper()}]"]
        at = e
    return text if text is None else "".join([*parts, text[at:]])


def masked(docs: DataFrame, members: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): the text with ``[EMAIL]``, ``[PHONE]``, ``[IDNO]``,
    ``[ADDRESS]`` and ``[NAME]`` in the place of findings."""
    r, whole = register(members)
    base = _base(docs, id_col, text_col)
    id_type = base.schema["id"].dataType.simpleString()
    public = {(x["given"], x["family"]) for x in _public(members).limit(REGISTER + 1).collect()} if whole else set()
    if whole and len(public) <= REGISTER:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [
                    _mask(t, [(a, e, kind) for a, e, kind, g, f in spans(t, r) if kind != "name" or (g, f) not in public])
                    for t in b.column(1).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["id", "text"])

        return base.mapInArrow(run, f"id {id_type}, text string").withColumnRenamed("id", id_col)

    # too many members for the tasks: their names leave by a join
    known = _with_known(base, members)
    rows = _all_spans(known.withColumn("id", F.xxhash64("text")).dropDuplicates(["id"]), r)
    spans_of = rows.join(_public(members), ["given", "family", "pii_type"], "left_anti").groupBy(F.col("id").alias("doc")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "pii_type"))).alias("found")
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [
                _mask(t, [(x["start"], x["end"], x["pii_type"]) for x in f or ()])
                for t, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["id", "text"])

    met = base.withColumn("doc", F.xxhash64("text")).join(spans_of, "doc", "left").select("id", "text", "found")
    return met.mapInArrow(apply, f"id {id_type}, text string").withColumnRenamed("id", id_col)
