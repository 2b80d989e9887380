import random

import pytest

from strataquery.llm import names as N
from strataquery.llm.names import Reading

SCHEMA = "author_id long, name string, email string"

ONE_PERSON = [
    (1, "Søren Vikhinmorgla", "soren.vikhinmorgla@merridun.example"),
    (2, "SOREN VIKHINMORGLA", None),
    (3, "Vikhinmorgla, Søren", "dev@team.example"),
    (4, "Dr. SÃ¸ren  B. Vikhinmorgla ", "1234+vikhinmorglaso11@noreply.forge.example"),
    (5, None, " SVIKHINMORGLA+git@osmundra.test "),
    (6, "Søren Vikhinmorgla", "svikhinmorgla@mail.osmundra.test"),
    (7, "Søren Vikhinmorlga", "builds@ci.example"),
    (8, "SV", "soren-vikhinmorgla@noreply.forge.example"),
]
OTHERS = [
    (20, "Sebastian Vikhinmorgla", "sebastian.vikhinmorgla@merridun.example"),
    (21, "Kate Norselvamyol", "katherine.norselvamyol@x.example"),
    (22, "Katherine Norselvamyol", "root@localhost"),
    (23, "Bertrand Norselvamyol", "root@localhost"),
    (30, "Rasastglajasbal Consulting", "info@rasastglajasbal.test"),
    (31, "The Raasstglajasbal team", "dev@rasastglajasbal.test"),
    (32, "rasastglajasbal-consulting", None),
    (40, "unknown", None),
    (41, "", " "),
    (42, None, None),
    (43, "dev", "dev@team.example"),
    (None, "Søren Vikhinmorgla", None),
]
GROUPS = [{1, 2, 3, 4, 5, 6, 7, 8}, {21, 22}, {30, 31, 32}]


def test_variants_are_linked_and_namesakes_are_not(spark):
    df = spark.createDataFrame(ONE_PERSON + OTHERS + ONE_PERSON[:2], SCHEMA).selectExpr("*", "1 as key", "'x' as box", "2 as n")
    found = {}
    for r in N.linked(df).collect():
        found.setdefault(r.entity, set()).add(r.author_id)
    assert sorted((g for g in found.values() if len(g) > 1), key=min) == GROUPS
    assert N.linked(df.where("false")).collect() == []


PAIRS = [
    ("robert", "robrrt"), ("salvador", "savador"), ("isidora", "isinora"), ("benjamin", "benajmin"), ("nellevbrebor", "nellevrbebor"), ("kanelmobabo", "kanelmobbbo"),
    ("schneider", "schneiker"), ("meyer", "meter"), ("hartmann", "harkmann"), ("a" * 400 + "b" * 400, "a" * 400 + "c" + "b" * 400), ("ab" * 100, "ab" * 100 + "x"),
]


def groups(spark, rows):
    found = {}
    for r in N.linked(spark.createDataFrame(rows, SCHEMA)).collect():
        found.setdefault(r.entity, set()).add(r.author_id)
    return sorted(found.values(), key=min)


def test_any_error_leaves_a_block_in_common(spark):
    rows = [(2 * i + j, f"Ottoline {w}", None) for i, pair in enumerate(PAIRS) for j, w in enumerate(pair)]
    assert groups(spark, rows) == [{2 * i, 2 * i + 1} for i in range(len(PAIRS))]
    for x, y in PAIRS:
        assert set(N.blocks("kemquopelvik", x)) & set(N.blocks("kemquopelvik", y))


def test_blocks_lose_no_pair_that_is_alike(spark):
    random.seed(3)
    letters = "abdeiklmnorst"
    words = ["".join(random.choices(letters, k=random.randrange(3, 9))) for _ in range(7)]
    spellings = set()
    for _ in range(250):
        first, last = random.choice(words), random.choice(words)
        at = random.randrange(len(last))
        typed = random.choice([last, last[:at] + last[at + 1 :], last[:at] + random.choice(letters) + last[at:], last[:at] + last[at + 1 : at + 2] + last[at : at + 1] + last[at + 2 :]])
        if len(typed) > 1:
            spellings.add((*random.choice([(first, typed), (typed, first)]), False, False))
    spellings = sorted(spellings)
    met = {s: set(N.blocks(*s[:2])) for s in spellings}
    near = [(x, y) for i, x in enumerate(spellings) for y in spellings[i + 1 :] if N.alike(x, y)[0]]
    assert len(near) > 50 and all(met[x] & met[y] for x, y in near)


def test_blocks_stay_small():
    words = [f"{a}elmobabo" for a in "bcdfgklmnprstvwz"] * 50
    blocks = [b for w in set(words) for b in N.blocks("ottoline", w)]
    assert max(blocks.count(b) for b in set(blocks)) <= 16


def test_common_nicknames(spark):
    known = [("Richard", "Dick"), ("Edward", "Ted"), ("James", "Jim"), ("Charles", "Chuck"), ("Margaret", "Peggy"), ("Thomas", "Tom"), ("Joseph", "Joe"), ("Katherine", "Kate"), ("Robert", "Bob")]
    rows = [(10 * i + j, f"{n} Vikhinmor{'abcdefghi'[i] * 3}lan", None) for i, pair in enumerate(known) for j, n in enumerate(pair)]
    assert groups(spark, rows) == [{10 * i, 10 * i + 1} for i in range(len(known))]


def test_a_spelling_near_two_people_joins_one(spark):
    people = [(1, "Ottoline Kanelmoba", "ottoline.kanelmoba@a.example"), (2, "Ottoline Kanelmobi", "ottoline.kanelmobi@b.example"), (3, "Ottoline Kanelmob", None)]
    assert len(groups(spark, people)) == 1 and {1, 2} - groups(spark, people)[0]
    chain = [(i, f"Ottoline {w}", None) for i, w in enumerate(["kanelmoba", "kanelmoda", "kanelmodi", "kanelmogi"])]
    assert groups(spark, chain) == [{0, 1, 2, 3}]


@pytest.mark.parametrize(("a", "b", "expected"), [("abcd", "abxd", True), ("abcd", "acbd", True), ("abcd", "abd", True), ("abcd", "abcde", True), ("abcd", "badc", False), ("abcd", "ab", False)])
def test_one_error(a, b, expected):
    assert N.one_error(a, b) == expected == N.one_error(b, a)


def test_long_names_take_no_long(spark):
    rows = [(1, "a" * 50_000 + " " + "b" * 50_000, "a" * 50_000 + "@x.example"), (2, "(" * 50_000, "[" * 50_000 + "@x"), (3, "A" * 50_000 + " " + "b" * 50_001, "b" * 50_000 + "@x.example")]
    assert groups(spark, rows) == [{1, 3}]  # one typing error apart, however long


def test_readings():
    assert N.mailbox(" 12+Ab.C+git@Mail.X.example ") == ("ab.c", "x.example") and N.mailbox("nobody") is None
    assert N.name_tokens("MaximilianTurlumneltur (brelko) via x") == ["maximilian", "turlumneltur"]
    assert N.phonetic("turrrikborgla") == N.phonetic("turrikborgla")
    assert Reading("a@b.example", "Ann Longname").spellings == Reading("Ann Longname", "a@b.example").spellings  # swapped columns
    assert Reading("x" * 100_000, "y" * 100_000 + "@z").keys is not None
    assert not N.alike(("kemquopelvik", "zoe", True, True), ("kemquopelvik", "ines", True, True))[0]
    assert not N.alike(("ann", "kemquopelvik", True, True), ("ann", "kemquopelvig", True, True))[0]  # both spelled by mailboxes
    assert N.alike(("ann", "kemquopelvik", True, True), ("ann", "kemquopelvig", True, False))[2]
