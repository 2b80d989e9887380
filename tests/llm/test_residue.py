import random
import time

import pytest
from conftest import rows

from strataquery.llm import residue as R

CASES = [
    "502 Bad Gateway", "# Page\n\nMenu\n\nErreur 404 : la page demandée est introuvable. Revenez à l'accueil.\n", "You need to enable JavaScript to run osmundra.", "<noscript>This viewer does not work without JavaScript.</noscript>",
    "## Motivation\n\n<!-- describe what you changed and why -->\n", "Owner:\n{{ owner }}\n", "Name: <NAME>", "[INSERT OWNER HERE] $$release notes$$ ($$description$$)", "Dear &lt;component&gt;,\n", "# «reason»", "- %BUILD ID%", "module: xxxx-module-xxxx",
    "blah blah blah blah blah blah blah blah blah", "Lorem ipsum dolor sit amet, consectetur adipiscing elit", "# T\n\n## Environment\n\njuark rulsdgdud fwjwqdeq eqjelh resjawa fdh hkgufh\n", "## Actual behaviour\n\n1.\n2.\n3.\n", '{"status": 502, "error": "Bad Gateway", "path": "/raw/8e9d0070"}',
    "<html><head><title>403 Forbidden</title></head><body><h1>Forbidden</h1><p>The address x could not be served.</p></body></html>", "TEXTO DE RELLENO, TEXTO DE RELLENO. TEXTO DE RELLENO", "Your content here. Your content here.", "foo bar baz qux foo bar baz qux",
]
NONE = [
    None, "", "  \n\t", "﻿", "A 404 page not found answer is cached for 244 seconds.", "Templates use `{{ title }}` for the title and `<TICKET>` for the ticket.", 'Readers without scripts see the notice "Please enable JavaScript"; its wording lives elsewhere.',
    "    const page = `<h1>${date}</h1><p>{{ ticket }}</p><noscript>Please enable JavaScript</noscript>`;", '        return NotFound("Page not found"); // 404', "// TODO: fill in the component", "  template: `<h2>{{ a.b }}</h2><app-x></app-x>`",
    "The fixture fills the body with lorem ipsum so that the pump has something to split.", "<?xml version=\"1.0\"?>\n<Template>\n  <value>x</value>\n</Template>", "<owner>\n  a b c\n</owner>", "```\n{{ owner }}\n```", "_log.Info($\"done {name}\");", "1. first\n2. second\n3. third", "x" * 300_000,
    "When the gateway answers 503 Service Unavailable, `Split` waits 7 ms and tries again.", "Cette règle s'applique aussi aux répertoires générés. " * 3,
]


def own(text):
    return bool(text) and bool(R.kinds_of(text))


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert own(text)


@pytest.mark.parametrize("text", NONE)
def test_no_cases(text):
    assert not own(text)


def test_long_lines_take_no_long():
    for text in ("x" * 300_000, "=" * 60 + " x", "=" * 100_000 + "x", "do" * 100_000, "<" * 100_000, "{{" * 50_000, "( " * 50_000, "- " * 50_000 + "x", "%a" * 50_000, "__" * 50_000):
        began = time.perf_counter()
        own(text)
        assert time.perf_counter() - began < 5, text[:10]


def test_templates_and_documents(spark):
    docs = [(i, t, "x") for i, t in enumerate(CASES + NONE)] + [(0, CASES[0], "again"), (None, CASES[0], "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, leaf string")
    assert rows(R.residue(df), "doc_id") == sorted([(i,) for i in range(len(CASES))], key=repr)
    assert rows(R.residue(df.where("false"))) == []


def test_templates_are_counted(spark):
    lines = [f"You need to enable JavaScript to run site{c}." for c in "abc"] + [f"rate limit reached for this address, retry after {n} s" for n in (9, 12)] + ["a plain line of text that says nothing"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string").repartition(4)
    assert rows(R.templates(df), "kind", "n_lines") == [("error", 2), ("script", 1), ("script", 1), ("script", 1)]
    assert R.leaf(R.masked("- Error 404 at 12:30")) == R.leaf(R.masked("* error 503 at 99"))
    assert R.is_open("error <status>", True) and not R.is_open("private static", True)


FIELDS = "".join(f"<p>Row {i} of this table has a name and a value.</p>" for i in range(40))
LONG = [
    f"<html><head><title>404 Not Found</title></head><body><h1>Not Found</h1>{FIELDS}</body></html>",
    f"<!DOCTYPE html><html><body><h2>Internal Server Error</h2>{FIELDS}</body></html>",
    f"<div>{FIELDS}<noscript>Please enable JavaScript to view this page.</noscript></div>",
    "Access denied. You do not have permission to view this page. " + "Reference 77 was noted for the owners of the place. " * 12,
    '{"status": 502, "error": "Bad Gateway", "path": "/' + "x/" * 400 + '", "trace": "' + "at a b c " * 60 + '"}',
    "Menu of the page with all entries in their order and with links to each. " * 6 + "Oops! We can't find the page you were after. Go back to the start page or search again.",
]
LONG_NONE = [
    "Access is a matter of the caller. When permission is missing the gateway answers 403 Forbidden and the page says so. " * 8,
    f"<p>The title of such a page is 404 Not Found.</p>{FIELDS}",
    "A page says that access was refused. Access denied. " + "This is told in the next part of the text at length. " * 10,
]


@pytest.mark.parametrize("text", LONG)
def test_long_lines_are_read_whole(text):
    assert len(text) > 400 and own(text)


@pytest.mark.parametrize("text", LONG_NONE)
def test_long_lines_about_messages_are_none(text):
    assert not own(text)


def test_an_open_fence_hides_nothing():
    assert own("```\ncode\n```\n502 Bad Gateway") and own("```\n502 Bad Gateway\nmore") and not own("```\n502 Bad Gateway\n```")


#: Messages of well-known servers, frameworks and issue forms, none of them from the tables of this project.
UNSEEN = [
    "The requested URL /x was not found on this server.", "Error establishing a database connection", "Whitelabel Error Page", "404. That's an error.", "HTTP/1.1 503 Service Unavailable", "The page you requested could not be found.",
    "The page you are looking for might have been removed, had its name changed, or is temporarily unavailable.", "Something went wrong. Please try again later.", "An unexpected error occurred. Please contact the administrator.",
    "This page isn't available right now", "We can't find the page you asked for", "You are not authorized to view this page.", "Please log in to continue", "Just a moment...", "Please complete the security check to access the site", "Your session has timed out. Please log in again.",
    "Die gesuchte Seite existiert nicht.", "La page que vous recherchez n'existe plus.", "La página solicitada no existe.", "Une erreur est survenue, veuillez réessayer plus tard.",
    "We're sorry but app doesn't work properly without JavaScript enabled. Please enable it to continue.", "JavaScript seems to be disabled in your browser.", "Your browser does not support JavaScript!", "You need to enable JavaScript to run this app.", "For full functionality of this site it is necessary to enable JavaScript.",
    "JavaScript ist deaktiviert.", "Por favor, active JavaScript para continuar", "A clear and concise description of what the bug is.", "If applicable, add screenshots to help explain your problem.", "Add any other context about the problem here.", "Insert text here", "Enter your description here", "This is a placeholder text", "Click to add title", "Inhalt folgt",
]
UNSEEN_NONE = [
    "This page is not complete; see the wiki for the rest of it.", "The file was not found when the build ran in the new folder.", "We log in to continue the trace of the session on the other host.", "Something went wrong with my merge and now the index is off.",
    "You are not allowed to throw from a destructor here.", "An error occurred in line 7 of the parser, which the log shows.", "The requested page size is rounded up to a power of two.", "The page cache you requested in #12 is merged, not yet released in full? See below for moved files.",
    "JavaScript is compiled by the bundler before tests run.", "Add the description to the summary of the commit.", "Click the title to sort rows by name.", "Enable scripting only in the test profile, not in release, is what the guide says: `scripting = off`.",
]


def test_messages_that_no_table_holds():
    found = [t for t in UNSEEN if own(t)]
    assert len(found) >= 0.9 * len(UNSEEN), set(UNSEEN) - set(found)
    wrong = [t for t in UNSEEN_NONE if own(t)]
    assert len(wrong) <= 0.1 * len(UNSEEN_NONE), wrong


@pytest.mark.parametrize("parts", [1, 4])
def test_other_lines_of_a_leaf_hide_no_message(spark, parts):
    pairs = [
        ("You do not have permission to view this page.", "You do not have to restart the whole server."),
        ("The server at example gave no further detail.", "The server at example keeps all its answers."),
        ("Go back to the start page or search again.", "Go back to the old plan if tests fail."),
        ("This wide old viewer does not work without JavaScript.", "This wide old viewer shows each file in order."),
    ]
    for first, second in pairs:
        assert R.leaf(R.masked(first)) == R.leaf(R.masked(second))
    df = spark.createDataFrame([(10 * i + j, t) for i, pair in enumerate(pairs) for j, t in enumerate(pair)], "doc_id long, text string").repartition(parts)
    assert rows(R.residue(df), "doc_id") == [(0,), (10,), (20,), (30,)]


def test_more_documents_change_nothing(spark):
    docs = [(i, t) for i, t in enumerate(CASES + NONE + LONG) if t]
    alone = {d for d, t in docs if R.kinds_of(t)}
    around = [(1000 + i, t) for i, t in enumerate("\n".join(line.rsplit(" ", 1)[0] + f" word{j}" for line in (t or "").splitlines()) for _, t in docs for j in range(3))]
    both = spark.createDataFrame(docs + around, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in R.residue(both).where("doc_id < 1000").collect()} == alone


def lines_like_messages(seed):
    """Masked lines around those of the tests, some tokens changed, by leaves."""
    rng = random.Random(seed)
    texts = [line for t in [*CASES, *LONG, *UNSEEN, *UNSEEN_NONE, *filter(None, NONE)] for line in t.splitlines() if 4 < len(line.split()) < 40]
    leaves = {}
    for line in texts:
        tokens = R.masked(line)
        for _ in range(8):
            changed = [rng.choice(["page", "not", "javascript", "javascript.", "enabled.", "to", "￿", "<status>", "x"]) if i >= R.DEPTH and rng.random() < 0.3 else t for i, t in enumerate(tokens)]
            leaves.setdefault(R.leaf(changed), set()).add(tuple(changed))
    return [sorted(lines) for lines in leaves.values()]


@pytest.mark.parametrize("seed, groups, held", [(1, 64, 100_000), (2, 1, 100_000), (3, 64, 3)])
def test_a_template_gives_its_lines_the_verdict_they_have_alone(monkeypatch, seed, groups, held):
    monkeypatch.setattr(R, "HELD_GROUPS", groups)
    monkeypatch.setattr(R, "HELD_LINES", held)
    merged = 0
    for lines in lines_like_messages(seed):
        told = [(line, kind, len(members)) for _, kind, members in R.mined(lines) for line in members]
        assert sorted(line for line, _, _ in told) == lines
        assert {line: kind for line, kind, _ in told} == {line: R._kind(" ".join(line)) for line in lines}
        merged += sum(n > 1 and kind is not None for _, kind, n in told)
    assert merged or held < 100_000


def test_a_template_is_classified_once(monkeypatch):
    calls, settled = [], R.settled
    monkeypatch.setattr(R, "settled", lambda template: calls.append(template) or settled(template))
    lines = [tuple(f"you need to enable javascript to run {a}{b}.".split()) for a in "abcdefgh" for b in "klmnopqr"]
    ((template, kind, members),) = R.mined(lines)
    assert (template[-1], kind, members, len(calls)) == (None, "script", lines, 1)


@pytest.mark.parametrize("parts", [1, 5])
def test_one_tree_merges_lines_of_all_tasks(spark, parts):
    lines = [f"You need to enable JavaScript to run site{c}." for c in "abcde"] + ["You need to enable users to run this.", "You do not have permission to view this page.", "You do not have permission to see this file.", "You do not have time to read this text."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string").repartition(parts)
    expected = [("you do not have permission to see this file.", "error", 1), ("you do not have permission to view this page.", "error", 1), ("you need to enable javascript to run <*>", "script", 5)]
    assert rows(R.merged_templates(df), "template", "kind", "n_lines") == expected
    assert rows(R.residue(df), "doc_id") == [(i,) for i in (0, 1, 2, 3, 4, 6, 7)]


@pytest.mark.parametrize("limit", [R.BROADCAST_BYTES, -1])
def test_verdicts_come_back_to_all_documents(spark, monkeypatch, limit):
    monkeypatch.setattr(R, "BROADCAST_BYTES", limit)
    texts = [t for t in CASES + NONE + LONG + LONG_NONE + UNSEEN if t]
    docs = list(enumerate(texts)) + [(1000 + i, t) for i, t in enumerate(texts)] + [(0, t) for t in LONG]
    expected = {}
    for doc, text in docs:
        expected.setdefault(doc, set()).update(R.kinds_of(text))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r.doc_id: set(r.kinds) for r in R.residue(df).collect()} == {d: k for d, k in expected.items() if k}
