import pytest

from vecspark.llm import pii

MEMBERS = [(1, "Hedir", "Mendmann", "A", "Ulorstead"), (2, "Nilette", "Ilavock", "B", "Port Norholm"), (3, "Elvio", "Maraik", None, None)]

CASES = [
    ("Please send replies to jo.doe+a1@mail.example.co.uk; thanks.", {("email", "jo.doe+a1@mail.example.co.uk")}),
    ("Write to jo_doe at field dot co dot example and wait.", {("email", "jo_doe at field dot co dot example")}),
    ("Mail: jo[at]field[dot]example. Or A.B (at) field-post.test.", {("email", "jo[at]field[dot]example"), ("email", "A.B (at) field-post.test")}),
    ("Vote @ 14:30, says the order paper. Follow @harbourwatch.", set()),
    ("Call +999 (46) 555-0167 or 0555 345 67 90, (0555) 393-9591, 0555/9842-94.",
     {("phone", "+999 (46) 555-0167"), ("phone", "0555 345 67 90"), ("phone", "(0555) 393-9591"), ("phone", "0555/9842-94")}),
    ("Call +999.05.555.0621, +999 60 555 05 74 or 00999745555169. Telephone: 555-0145.",
     {("phone", "+999.05.555.0621"), ("phone", "+999 60 555 05 74"), ("phone", "00999745555169"), ("phone", "555-0145")}),
    ("The vote stood at 901-2205. Docket 1760-2183-3024. Budget line 0102/165 covers this. Bill 1368-3888.", set()),
    ("Her card, 00039068248, and 9514 835 3547, XP-62-803485-T, E5915597, 94/521493/30, 703139-5683, P69A4801F.",
     {("idno", x) for x in ("00039068248", "9514 835 3547", "XP-62-803485-T", "E5915597", "94/521493/30", "703139-5683", "P69A4801F")}),
    ("He lives at 23b Kelavstone Avenue. At 12 Norulcroft St. in Town. Lot 18 on Wenelow Road was sold.",
     {("address", "23b Kelavstone Avenue"), ("address", "12 Norulcroft St.")}),
    ("Wohnhaft Norosrowstraße 18. In der Crorberry-Allee 29 in Ulm. Die Straße nach Ulm misst 138 m.",
     {("address", "Norosrowstraße 18"), ("address", "Crorberry-Allee 29")}),
    ("Au 80 bis, rue de Tarortree, rien. Au 2, impasse Ulanfield, rien.", {("address", "80 bis, rue de Tarortree"), ("address", "2, impasse Ulanfield")}),
    ("En C/ Kelavstone 119 no hay. En plaza Fenimstone, n.º 39 no hay.", {("address", "C/ Kelavstone 119"), ("address", "plaza Fenimstone, n.º 39")}),
    ("Thanks are due to Hedir de Ilavock. It was MARAIK, Nilette who found it, signed Elvio K. Mendmann.",
     {("name", "Hedir de Ilavock"), ("name", "MARAIK, Nilette"), ("name", "Elvio K. Mendmann")}),
    ("Hedir Mendmann (A): I thank HEDIR MENDMANN and Ms Ilavock of Port Norholm.", set()),
    ("", set()), (" \n", set()), (None, set()),
]


@pytest.fixture(scope="module")
def members(spark):
    return spark.createDataFrame(MEMBERS, "member_id int, given_name string, family_name string, party string, constituency string")


def test_found(spark, members):
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(CASES)], "doc_id long, text string, given string")
    got = {}
    for r in pii.found(docs.union(docs.limit(3)), members).collect():
        got.setdefault(r["doc_id"], []).append((r["pii_type"], r["pii_text"]))
    for i, (t, want) in enumerate(CASES):
        assert sorted(got.get(i, [])) == sorted(want), t


def test_masked(spark, members):
    docs = spark.createDataFrame([(1, CASES[0][0]), (2, None), (3, "Hedir Mendmann spoke.")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.masked(docs, members).collect()}
    assert got == {1: "Please send replies to [EMAIL]; thanks.", 2: None, 3: "Hedir Mendmann spoke."}


def test_long_and_empty(spark, members):
    text = "Nothing here. " * 50_000 + "Mail: a.b@c.example"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [tuple(r) for r in pii.found(docs, members).collect()] == [(1, "email", "a.b@c.example")]
    assert pii.found(docs.limit(0), members.limit(0)).count() == 0


def test_checksums():
    assert pii.luhn("79927398713") and not pii.luhn("79927398710")
    assert pii.mod97("3214282912345698765432161182") and not pii.mod97("1234")


def test_a_call_cue_lifts_short_and_slashed_numbers():
    r = pii.Register([], [], [])

    def phones(text):
        return [text[a:b] for a, b, kind, *_ in pii.spans(text, r) if kind == "phone"]

    assert phones("Telephone: 482-0145. Call 731-2288, Fax 0711/12345; Rufen Sie 0711/54321 an.") == [
        "482-0145", "731-2288", "0711/12345", "0711/54321"]
    assert not phones("The vote stood at 901-2205. Bill 368-3888. Budget line 0102/165. Roll call 901-2205. Call bill 368-3888.")


def test_hyphenated_given_names():
    r = pii.Register(["karl", "heinz", "jean-pierre"], ["weber", "martin"], ["Nieder-Ulm"])
    text = "Gestern kam Karl-Heinz Weber. Puis Jean-Pierre Martin. Nach Ober-Saint Weber und Nieder-Ulm Weber."
    assert [text[a:b] for a, b, kind, *_ in pii.spans(text, r)] == ["Karl-Heinz Weber", "Jean-Pierre Martin"]


@pytest.mark.parametrize("query", [pii.found, pii.masked])
def test_a_register_beyond_the_bound_is_joined(spark, members, monkeypatch, query):
    docs = spark.createDataFrame(
        [(i % 7, t, "x") for i, (t, _) in enumerate(CASES)] + [(None, CASES[12][0], "y")], "doc_id long, text string, w string")
    docs = docs.union(docs)
    want = sorted(query(docs, members).collect(), key=str)
    monkeypatch.setattr(pii, "REGISTER", 0)
    # the model of endings has no names to learn from, the register is complete
    few = [t for t, _ in CASES[:11]] + [CASES[13][0]]
    got = query(docs.where(docs.text.isin(few) | docs.text.isNull()), members).collect()
    assert sorted(got, key=str) == sorted(query(docs.where(docs.text.isin(few) | docs.text.isNull()), members).collect(), key=str)
    monkeypatch.setattr(pii, "REGISTER", 2)
    assert sorted(query(docs, members).collect(), key=str) == want


def test_members_without_names_exclude_nobody(spark, members):
    docs = spark.createDataFrame([(1, "Mail: jo@field.example, or Hedir Ilavock, a nurse.")], "doc_id long, text string")
    blank = spark.createDataFrame([(9, "", " ", None, None), (10, None, None, None, None), (11, "Hedir", "", None, None)], members.schema)
    for who in (members, members.union(blank)):
        assert {tuple(r) for r in pii.found(docs, who).collect()} == {(1, "email", "jo@field.example"), (1, "name", "Hedir Ilavock")}
        assert pii.masked(docs, who).collect()[0]["text"] == "Mail: [EMAIL], or [NAME], a nurse."


#: Sentences that have nothing to do with the tables: what is found in each.
ELSEWHERE = [
    ("Tel. 389-4821", ["389-4821"]),
    ("Our score was 389-4821 and room 312-4455 stayed empty.", []),
    ("I spoke with Barbara Whitfield yesterday.", ["Barbara Whitfield"]),
    ("My neighbour, Thomas Brandt, dialled (030) 123-4567.", ["Thomas Brandt", "(030) 123-4567"]),
    ("The University hired Sarah Miller; Robert Street is closed.", ["Sarah Miller"]),
    ("Frau Ursula Weber, wohnhaft Hauptstraße 5, Telefon 0711/12345.", ["Ursula Weber", "Hauptstraße 5", "0711/12345"]),
    ("Die Rechnung 0711/12345 ist offen.", []),
    # a valid check is enough, and so is a word that says what it is
    ("The code 79927398713 was printed.", ["79927398713"]),
    ("The code 79927398710 was printed.", []),
    ("The passport 79927398710 was printed.", ["79927398710"]),
    ("Cédula 12345678A.", ["12345678A"]),
    ("Ref 12345678Z was paid in May, while ref 12345678A was not.", ["12345678Z"]),
    # too many digits for a phone number, unless it is called one
    ("Der Wert (01234) 567-8901 gilt.", ["(01234) 567-8901"]),
    ("Bill (0555) 393-9591 failed.", []),
]


@pytest.mark.parametrize("text, want", ELSEWHERE)
def test_sentences_from_elsewhere(text, want):
    r = pii.Register([], [], [])
    assert [text[a:b] for a, b, *_ in pii.spans(text, r)] == want


def test_endings_tell_names_from_places():
    e = pii.Endings(["kelorley", "tamley", "brandtmann"], ["yaroburn", "ulorburn", "tamley"])
    assert e.likely("sandley", 3) and not e.likely("peraburn", 3) and not e.likely("xyz", 2)
