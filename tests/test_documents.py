"""Text functions and document operators against plain Python."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperlode.functions import text as T
from paperlode.operators import documents as D

SAMPLES = [
    "write to ann.lee+x@mail.example.com or (415) 555-0100, then 415-555-0100.",
    "Ünïcode 😀 before 212.555.0199 and after\nbob@x.org\r\nbob@x.org!",
    "nothing here",
    "",
    "12 @ 34 ... a@b 1-2-3",
    "(415) 555-0100(415) 555-0100x@y.co",
]


@pytest.fixture
def samples(rows):
    return rows([*enumerate(SAMPLES), (99, None)], "id bigint, text string")


@pytest.mark.parametrize("pattern", [T.EMAIL, T.PHONE])
def test_spans(samples, pattern):
    got = {r.id: r.s for r in samples.select("id", T.spans(F.col("text"), pattern, 5).alias("s")).collect()}
    for i, text in enumerate(SAMPLES):
        expected = [
            (m.start() + 1, m.group(), re.sub("[\r\n]", " ", text[max(m.start() - 5, 0) : m.end() + 5]))
            for m in re.finditer(pattern, text)
        ]
        assert [tuple(s) for s in got[i]] == expected
    assert got[99] == []


def test_phones_keep_order_and_form(samples):
    got = {r.id: r.p for r in samples.select("id", T.phones(F.col("text")).alias("p")).collect()}
    assert got[0] == ["(415) 555-0100"]
    assert got[1] == ["(212) 555-0199"]


def test_emails_sorted_and_distinct(rows):
    df = rows([(1, "z@z.org a@a.org z@z.org")], "id bigint, text string")
    assert df.select(T.emails(F.col("text"))).first()[0] == ["a@a.org", "z@z.org"]


@pytest.mark.parametrize(
    ("text", "found"),
    [("id 123-45-6789.", True), ("123-45-67890", False), ("9123-45-6789", False), ("1-123-45-6789", False), ("", False)],
)
def test_ssn_shape(rows, text, found):
    assert rows([(text,)], "text string").select(T.has_ssn_shape(F.col("text"))).first()[0] is found


def test_mask_round_trip(samples):
    keyed = samples.withColumn("e", T.mask_table(F.col("text"))).withColumn("m", T.mask(F.col("text"), F.col("e")))
    back = keyed.select("text", "m", T.unmask(F.col("m"), F.col("e")).alias("back")).collect()
    assert all(r.text == r.back for r in back)
    assert "@x.org" not in back[1].m and "555" not in back[0].m


def test_mask_many_and_nested_values(rows):
    text = " ".join(f"u{i}@example.org" for i in range(1, 13)) + " xu1@example.org u1@example.org.uk"
    df = rows([(text,)], "text string").withColumn("e", T.mask_table(F.col("text")))
    row = df.select(T.mask(F.col("text"), F.col("e")).alias("m"), "e").first()
    assert re.fullmatch(r"(\[\[ENTITY-\d+\]\] ?)+", row.m)
    assert len(row.e) == 14
    assert df.select(T.unmask(F.lit(row.m), F.col("e"))).first()[0] == text


@pytest.mark.parametrize("size", [1, 4, 7, 1000])
def test_byte_chunks(samples, size):
    got = {}
    for r in D.byte_chunks(samples, "id", "text", size).orderBy("id", "chunk_no").collect():
        assert r.chunk_id == f"{r.id}-{r.chunk_no:06d}"
        got.setdefault(r.id, []).append((r.chunk_no, r.byte_offset, r.byte_size, r.chunk_hash))
    for i, text in enumerate(SAMPLES):
        raw = text.encode()
        expected = [
            (n, n * size, len(raw[n * size : (n + 1) * size]), hashlib.sha256(raw[n * size : (n + 1) * size]).hexdigest())
            for n in range(-(-len(raw) // size))
        ]
        assert got.get(i, []) == expected
    assert 99 not in got


def test_sections_carry_their_title(rows):
    html = (
        "<head><title>no</title></head><p>lead</p><h1 class='a'>One</h1><p>first</p><p>second</p>"
        "<H2>Two</H2><h3>Three &amp;</h3><script>var a='<h1>x</h1>'</script><p>third</p><!-- <h1>gone</h1> -->"
    )
    odd = "x &amp; y\x01b<h1\n>A&nbsp;<b\n>B</b></h1\n>c &lt;p&gt; &#233;<script\t>1</style><h2>no</h2></script ><h2>D &copy</h2>e"
    df = rows([(1, html), (2, "<p>plain</p>"), (3, ""), (4, "<header>kept</header>"), (5, odd)], "id int, html string")
    got = [tuple(r) for r in D.html_sections(df, "id", "html").orderBy("id", "section_no").collect()]
    assert got == [
        (1, 0, None, "lead"),
        (1, 1, "One", "first second"),
        (1, 3, "Three &", "third"),
        (2, 0, None, "plain"),
        (4, 0, None, "kept"),
        (5, 0, None, "x & y\x01b"),
        (5, 1, "A\xa0 B", "c <p> é"),
        (5, 2, "D ©", "e"),
    ]


@pytest.mark.parametrize(
    ("uri", "kind"),
    [
        ("mailto:a@b.c", "email"), ("sms:123", "message"), ("file:///x/y.PDF", "pdf"), ("http://h/a.html?q=1#t", "page"),
        ("http://h/a", "file"), ("a.eml", "email"), ("", "file"), ("tel:+1", "call"), ("http://h.org/", "file"),
    ],
)
def test_document_type(rows, uri, kind):
    assert rows([(uri,)], "u string").select(D.document_type(F.col("u"))).first()[0] == kind


def test_dates(rows):
    text = "due 2024-02-29, 2023-02-29, 2/29/2024, 12/31/1999, 13/1/2000, March 5, 2020 and 3/5/2020; May 32, 2020"
    df = rows([(1, text), (2, "none"), (3, None)], "id int, text string")
    got = {(r.id, str(r.day), r.form) for r in D.found_dates(df, "id", "text").collect()}
    assert got == {(1, "2024-02-29", "iso"), (1, "1999-12-31", "us"), (1, "2020-03-05", "us")}


def test_amounts(rows):
    df = rows([(1, "$1,234.50 and USD 7 then 8.25 USD, $1,234.50; $ 3")], "id int, text string")
    got = sorted((r.start, str(r.amount)) for r in D.found_amounts(df, "id", "text").collect())
    assert got == [(1, "1234.50"), (15, "7.00"), (26, "8.25"), (36, "1234.50"), (47, "3.00")]


def test_amounts_overlap_once_and_keep_large_ones(rows):
    df = rows([(1, "$100 USD, USD 12345678901234567890.25")], "id int, text string")
    got = sorted((r.start, r.value, str(r.amount)) for r in D.found_amounts(df, "id", "text").collect())
    assert got == [(1, "$100", "100.00"), (11, "USD 12345678901234567890.25", "12345678901234567890.25")]


def test_many_matches_in_one_text(rows):
    df = rows([(1, "$1 or 2/2/2020, " * 100_000)], "id int, text string")
    assert D.found_amounts(df, "id", "text").count() == 100_000
    assert D.found_spans(df, "id", "text", {"day": T.US_DATE}, 5).count() == 100_000
    assert D.found_dates(df, "id", "text").count() == 1


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("+15551234567", "(555) 123-4567"), ("9995551234", "(999) 555-1234"), ("+1 (706) 555-3138", "(706) 555-3138"),
        ("1-415-555-0100", "(415) 555-0100"), ("4644348398010899", None), ("12345678901", None), ("415-555-01000", None),
    ],
)
def test_phone_forms(rows, text, found):
    got = rows([(f"call {text} now",)], "text string").select(T.phones(F.col("text"))).first()[0]
    assert got == ([found] if found else [])


@pytest.mark.parametrize("text", ["12020-01-01", "2020-01-011", "112/3/20200", "AB12345678901"])
def test_digit_boundaries(rows, text):
    df = rows([(text,)], "text string")
    for pattern in (T.ISO_DATE, T.US_DATE, T.SERIAL_ID):
        assert df.select(T.matches(F.col("text"), pattern)).first()[0] == []


def test_serials_skip_stop_prefixes(rows):
    df = rows([(1, "ABC0001234 ABC0001234 PAGE-1234 XY 99999 abc1234 TOOLONGPREFIX1234")], "id int, text string")
    assert sorted(r.serial for r in D.serial_ids(df, "id", "text", ("PAGE",)).collect()) == [
        "ABC0001234", "XY 99999",
    ]


def test_precedence_names_a_value_once(rows):
    df = rows([(1, "ann@x.org and bad@local ann@x.org")], "id int, text string")
    found = D.merged_finds(df, "id", "text", [("email", T.EMAIL), ("loose", r"[a-z]+@[a-z.]+")])
    assert {(r.value, r.kind) for r in found.collect()} == {("ann@x.org", "email"), ("bad@local", "loose")}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="aA é-_9\n", max_size=12), min_size=1, max_size=6))
def test_name_key_and_trigrams(spark, names):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    for r in df.select("i", T.name_key(F.col("n")).alias("k"), T.trigrams(F.col("n")).alias("g")).collect():
        key = re.sub(" +", " ", re.sub("[^a-z0-9 ]+", " ", names[r.i].lower()))
        assert r.k == key
        grams = {f"  {w} "[j : j + 3] for w in key.split(" ") if w for j in range(len(w) + 1)}
        assert set(r.g) == grams and len(r.g) == len(grams)


def test_legal_references(rows):
    text = (
        "Under 42 U.S.C. §§ 1983 and 42 U.S.C. § 1983, 29 C.F.R. § 1604.11, 410 U.S. 113, No. 2:98-cv-00123; "
        "see § 1983 and §77 and § 77."
    )
    df = rows([(1, text), (2, "nothing"), (3, None)], "id int, text string")
    got = {(r.id, r.reference, r.kind) for r in D.legal_references(df, "id", "text").collect()}
    assert got == {
        (1, "42 U.S.C. § 1983", "code"), (1, "29 C.F.R. § 1604.11", "regulation"), (1, "410 U.S. 113", "opinion"),
        (1, "2:98-cv-00123", "docket"), (1, "§ 77", "section"),
    }


def test_wider_legal_references(rows):
    text = "See 11 U.S.C. ch. 7 and 12 F.4th 345; 98 F. Supp. 3d 11, 5 P.3d 77. No. 21-476, Section 12 and section 3a. Bar No. 123456"
    df = rows([(1, text)], "id int, text string")
    got = {(r.reference, r.kind) for r in D.legal_references(df, "id", "text").collect()}
    assert got == {
        ("11 U.S.C. ch. 7", "code"), ("12 F.4th 345", "opinion"), ("98 F. Supp. 3d 11", "opinion"), ("5 P.3d 77", "opinion"),
        ("No. 21-476", "docket"), ("Section 12", "section"), ("section 3a", "section"),
    }
    assert df.select(T.bar_numbers(F.col("text"))).first()[0] == ["123456"]


@pytest.mark.parametrize(("reference", "year"), [("2:98-cv-00123", 1998), ("1:24-cr-5", 2024), ("No. 21-476", 2021), ("x", None)])
def test_docket_year(rows, reference, year):
    assert rows([(reference,)], "r string").select(D.docket_year(F.col("r"), 70)).first()[0] == year


def test_intake_describes_new_contents_only(rows):
    incoming = rows([(5, "a@b.org x"), (4, "a@b.org x"), (6, "known"), (7, "")], "id bigint, text string")
    stored = rows([(1, "known")], "id bigint, text string")
    got = {r.id: (r.n_copies, r.n_chunks, r.n_words, r.n_entities) for r in D.intake(incoming, stored, "id", "text", 4).collect()}
    assert got == {4: (2, 3, 2, 1), 7: (1, 0, 0, 0)}


def test_email_parts(rows):
    whole = "Received: a\r\nReceived: b\r\nSUBJECT: one\r\n\ttwo\r\n\r\nBody\r\n\r\nSubject: not this"
    df = rows([(1, whole), (2, "From: x"), (3, "\n\nonly body"), (4, None), (5, "")], "id int, m string")
    got = {r.id: (r.received, r.subject, getattr(r, "from"), r.body) for r in D.email_parts(df, "id", "m", ["Received", "Subject", "From"]).collect()}
    assert got[1] == ("a", "one two", None, "Body\r\n\r\nSubject: not this")
    assert got[2] == (None, None, "x", "") and got[3] == (None, None, None, "only body")
    assert got[5] == (None, None, None, "")


def test_date_flags(rows):
    df = rows([(1, "2024-02-30 and 2/29/2024, 2/29/2024; June 31, 2020")], "id int, text string")
    got = {(r.value, r.possible) for r in D.date_flags(df, "id", "text").collect()}
    assert got == {("2024-02-30", False), ("2/29/2024", True), ("June 31, 2020", False)}


def test_names_are_masked_and_restored(rows):
    df = rows([(1, "Ann Lee met Ann (a@b.org); call 415-555-0100", ["Ann", "Ann Lee", "", "Bob"])], "id int, t string, n array<string>")
    made = df.select("t", T.mask_table(F.col("t"), F.col("n")).alias("e")).select("*", T.mask(F.col("t"), F.col("e")).alias("m"))
    row = made.select("*", T.unmask(F.col("m"), F.col("e")).alias("back"), T.depends_on_masked(F.col("m"), F.col("e")).alias("d")).first()
    assert row.m == "[[ENTITY-4]] met [[ENTITY-3]] ([[ENTITY-1]]); call [[ENTITY-2]]" and row.back == row.t and row.d


def test_word_boundaries_beside_other_letters(rows):
    phone, day = "555-123-4567", "2024-05-06"
    texts = [f"é{phone}", f"{phone}é", f"電話{phone}番", f"日{day}日", f"x{phone}", f"{day}_"]
    df = rows(list(enumerate(texts)), "doc_id bigint, text string")
    spans = D.found_spans(df, "doc_id", "text", {"phone": T.PHONE, "day": T.ISO_DATE}).collect()
    assert {(r.doc_id, r.value) for r in spans} == {(0, phone), (1, phone), (2, phone), (3, day)}
    found = df.select("doc_id", T.matches(F.col("text"), T.PHONE).alias("p"), T.matches(F.col("text"), T.ISO_DATE).alias("d"))
    assert {r.doc_id: (r.p, r.d) for r in found.collect()} == {
        0: ([phone], []), 1: ([phone], []), 2: ([phone], []), 3: ([], [day]), 4: ([], []), 5: ([], [])
    }
