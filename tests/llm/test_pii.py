import random

import pytest
from gradus.llm import mentions, pii

GIVEN = ["Kofi", "Lucía", "Ana-Lena", "Pieter", "Zeynep", "Marek"]
FAMILY = ["Harbquist", "Tolquist", "Marquist", "Ostnemann", "Drumlomann", "Cravmann", "Velski", "Dovzuski", "Gorposki"]


def corpus():
    """Texts with known items; filler sentences with numbers and capitals that are none."""
    rng, rows, want = random.Random(6), [], set()
    for i in range(220):
        g, f = rng.choice(GIVEN), rng.choice(FAMILY)
        n = f"{rng.randrange(200, 999)}"
        phone = rng.choice([f"({n}) 555-01{i % 90 + 10}", f"{n}-555-01{i % 90 + 10}", f"+44 20 7946 0{n}", f"0{n}{n}{i % 90 + 10}1", f"{n} 555 01{i % 90 + 10}"])
        mail = f"{f.lower()}.{i}@mail.example.com"
        code, label = rng.choice([(f"9{i % 90 + 10}-41-{i + 1000}", "SSN"), (f"XQ{i + 1000000}", "passport"), (f"{i + 20000000}", "student id")])
        street = rng.choice([f"{i + 1} Oxbow Road, Norvale ZQ{n} 4XX", f"Tannenweg {i + 1}, 00{n} Obertal", f"{i + 1} bis rue des Ormelles, 00{n} Valmoret"])
        name = rng.choice([f"{g} {f}", f"{f}, {g}"])
        line = rng.choice(["Contact: {p} | {m} | {t}", "Submitted by {p} ({l} {c}).", "Graded for {p}, {l} {c}, on 2024-01-02.", "Phone: {t}", "tel {t} / mail {m}", "| {p} | {l} {c} | 12 points |", "As {p} noted in week 4, it holds.", "Return address:\n{a}", "my number changed to {t} btw", "My {l} {c}, please fix it."])
        for k, kind, item in (("{p}", "person", name), ("{m}", "email", mail), ("{t}", "phone", phone), ("{c}", "id_number", code), ("{a}", "address", street)):
            if k in line:
                want.add((i, kind, item))
        text = line.format(p=name, m=mail, t=phone, c=code, l=label, a=street)
        rows.append((i, f"The Lake Ardwin data set holds {n} 555 {i + 1000} samples.\n{text}\nGrant no. NF-{i + 1000}-0{n}1 paid for it. The Harrow Institute and Norvale College agree."))
    return rows, want


@pytest.fixture(scope="module")
def found(spark):
    rows, want = corpus()
    extra = [(900, None), (901, ""), (902, " \n"), (None, "Contact: Kofi Harbquist | a.b@mail.example.com | 222-555-0111"), (903, "x " * 60_000 + "reach me at late.item@mail.example.com"), (0, rows[0][1])]
    df = spark.createDataFrame(rows + extra, "doc_id bigint, text string").selectExpr("doc_id", "text", "'c' kind", "1 start", "2 doc")
    return df, pii.found_items(df, "doc_id", "text").collect(), want


def test_precision_and_recall(found):
    _, rows, want = found
    got = {(r.doc_id, r.kind, r.found_text) for r in rows}
    assert len(got) == len(rows)
    assert (903, "email", "late.item@mail.example.com") in got
    got = {x for x in got if x[0] < 900}
    assert len(got & want) / len(want) > 0.97 and len(got & want) / len(got) > 0.97


def test_redaction_changes_nothing_else(found):
    df, rows, _ = found
    source = {(r.doc_id, r.text) for r in df.collect()}
    out = [r for r in pii.redact(df, "doc_id", "text").collect()]
    assert len(out) == df.count()
    items = {}
    for r in rows:
        items.setdefault(r.doc_id, []).append(r)
    for r in out:
        before = next(t for k, t in source if k == r.doc_id)
        for x in sorted(items.get(r.doc_id, []), key=lambda x: -len(x.found_text)):
            before = before.replace(x.found_text, pii.PLACEHOLDERS[x.kind])
        assert r.text == before


@pytest.mark.parametrize("copies", [1, 5])
def test_initials_are_found_in_copies(spark, copies):
    """A family name that stands with initials only is found however often its text is stored, and in other texts of its family."""
    rows, _ = corpus()
    rows += [(1000 + i, "Submitted by R. Branquist (SSN 912-41-1234).") for i in range(copies)] + [(2000 + i, f"Submitted by {x}. Kelmann (SSN 912-41-1234).") for i, x in enumerate("RTM")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.found_text) for r in pii.found_items(df, "doc_id", "text").where("kind = 'person' and doc_id >= 1000").collect()}
    assert got == {(1000 + i, "R. Branquist") for i in range(copies)} | {(2000 + i, f"{x}. Kelmann") for i, x in enumerate("RTM")}


def test_nothing_to_find(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert pii.found_items(empty, "doc_id", "text").count() == 0 and pii.redact(empty, "doc_id", "text").count() == 0


@pytest.mark.parametrize("text, item", [("write to a.b [at] example [dot] org now", "a.b [at] example [dot] org"), ("A_B(at)x.example.", "A_B(at)x.example"), ("mailto:q&#64;x.example\"", "q&#64;x.example"), ("n AT x DOT example", "n AT x DOT example"), ("@override and recall@20 or @quizbot", None)])
def test_emails(text, item):
    assert [m.text for m in mentions.emails(text)] == ([item] if item else [])


@pytest.mark.parametrize("text, item", [("at 48B W. Fallowgate Close, Flat 12, Ardwin", "48B W. Fallowgate Close, Flat 12"), ("Calle Olmedal n.º 189, 2.º B, 00995 Montarín.", "Calle Olmedal n.º 189, 2.º B, 00995 Montarín"), ("in Brunnenstr. 28 b, 00516 Obertal last", "Brunnenstr. 28 b, 00516 Obertal"), ("17 LARKMOOR RD\nEASTERBECK ZQ140 4XX", "17 LARKMOOR RD\nEASTERBECK ZQ140 4XX"), ("Lane 7 of the pipeline and Street View tiles", None)])
def test_addresses(text, item):
    assert [m.text for m in mentions.addresses(text) if m.shape != "open"] == ([item] if item else [])


def test_ways_of_writing_are_learned_from_contexts(spark):
    """Addresses with (at) and streets without a postal code are found for the contexts they share with plain ones, others are not."""
    lines = ["Contact: {} | room 4", "mail {} for more", "As {} wrote, it holds"]
    rows = [(i, line.format(f"a{i}.b@mail.example.com")) for i, line in enumerate(lines)]
    rows += [(10 + i, line.format(f"c{i}.d (at) mail.example.com")) for i, line in enumerate(lines)]
    rows += [(20, "we met at school dot com day")]
    streets = ["Return address: {}.", "lives at {}.", "sent to {}."]
    rows += [(30 + i, line.format(f"{i + 4} Oxbow Road, Norvale ZQ{200 + i} 4XX")) for i, line in enumerate(streets)]
    rows += [(40 + i, line.format(f"{i + 4} Elmgate Terrace")) for i, line in enumerate(streets)] + [(50, "chapter 7 Marble Place of honour")]
    got = {(r.doc_id, r.kind) for r in pii.found_items(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").collect()}
    assert {(i, "email") for i in (0, 1, 2, 10, 11, 12)} <= got and {(i, "address") for i in (30, 31, 32, 40, 41, 42)} <= got
    assert not {k for k in got if k[0] in (20, 50)}


def test_trust_grows_to_its_fixpoint(spark):
    from gradus.session import Scratch

    # A chain: each shape shares two contexts with the one before; ten links are further than any fixed number of rounds.
    links = spark.createDataFrame([(f"s{i}", f"c{j}", 1) for i in range(10) for j in (2 * i, 2 * i + 1, 2 * i + 2, 2 * i + 3)] + [("lone", "x", 5)], "node string, pattern string, n long")
    nodes, _ = pii._grown(Scratch(spark, "t"), links, links.where("node = 's0'"), "node", "pattern", 1, 2)
    assert {r.node for r in nodes.collect()} == {f"s{i}" for i in range(10)}


def test_given_names_stay_apart_from_families_when_texts_are_many(spark):
    """In many texts families stand before capitals where second given names stand too: they stay families, and "ask" is no given name."""
    pairs = [(g, f) for g in GIVEN for f in FAMILY]
    lines = ["Contact: {g} {f} | {m}", "Graded for {g} {f}, on 2024-01-02.", "Hello.\nask {f}, {g} or mail {m}"]
    rows = [(f"{f}, {g}" if "ask" in line else f"{g} {f}", line.format(g=g, f=f, m=f"{f.lower()}@mail.example.com")) for g, f in pairs for line in lines]
    rows += [(f"{g} {f}", f"Best wishes from {g} {f} Regards, and thanks.") for g, f in pairs]
    rows += [(f"{g} {h} {FAMILY[0]}", f"Seen with {g} {h} {FAMILY[0]}, in May.") for g in GIVEN for h in GIVEN if g != h]
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id bigint, text string")
    got = {(r.doc_id, r.found_text) for r in pii.found_items(docs, "doc_id", "text").where("kind = 'person'").collect()}
    assert not {(i, name) for i, (name, text) in enumerate(rows) if "Regards" not in text} - got
