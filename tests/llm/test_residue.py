import json

import pytest

from seqjoin.llm.notebook_cells import split_cells
from seqjoin.llm.notices import classify
from seqjoin.llm.residue import masked, messages_of_line, residue, scan_text
from seqjoin.llm.slots import is_filler


def notebook(*cells, style="json"):
    """One text of (kind, content) cells in one of the renderings."""
    if style == "json":
        out = []
        for kind, body in cells:
            if kind == "output":
                out[-1]["outputs"].append({"output_type": "stream", "text": body})
            else:
                out.append({"cell_type": "code" if kind == "code" else "markdown", "source": body.split("\n"), "outputs": []})
        return json.dumps({"cells": out})
    if style == "tags":
        return "\n\n".join(f'<cell kind="{k}">\n{b}\n</cell>' for k, b in cells)
    if style == "percent":
        heads = {"text": ("# %% [markdown]", "# "), "code": ("# %% In[1]", ""), "output": ("# Out[1]", "#> ")}
        return "\n\n".join(heads[k][0] + "\n" + "\n".join(heads[k][1] + x for x in b.split("\n")) for k, b in cells)
    if style == "session":
        return "\n\n".join({"code": "In [1]: ", "output": "Out[1]: ", "text": ""}[k] + b for k, b in cells)
    return "\n\n".join(b if k == "text" else f"```{'python' * (k == 'code')}\n{b}\n```" for k, b in cells)


STYLES = ["json", "tags", "percent", "session", "fences"]
PROSE = ("text", "# Results\n\nWe read the table and keep 12 rows.")
CODE = ("code", "x = '{{ name }}'\nprint('Please enable JavaScript to view this page.')\nlorem = 'Lorem ipsum dolor sit amet'")


def kinds(text):
    own, messages = scan_text(text)
    return {own, *(classify(m) for m, alone in messages.items() if alone)} - {None}


@pytest.mark.parametrize("style", STYLES)
def test_cells_come_back(style):
    cells = [PROSE, CODE, ("output", "3.5"), ("text", "Done.")]
    got = split_cells(notebook(*cells, style=style))
    assert [(k, b.strip()) for k, b in got] == [(k, b.strip()) for k, b in cells]
    assert kinds(notebook(*cells, style=style)) == set()


@pytest.mark.parametrize("style", STYLES)
@pytest.mark.parametrize(
    "kind,line",
    [
        ("slot", "Author: {{ author_name }}"), ("slot", "Made for <%= Team %> by [YOUR NAME]"), ("slot", "Last change: XX/XX/20XX"),
        ("slot", "Welcome to <your project here>!"), ("slot", "By %AUTHOR%, see ${link}"), ("slot", "Autor: [[hier Namen eintragen]]"),
        ("filler", "Lorem ipsum dolor sit amet, consectetur elit."), ("filler", "Text. Text. Sample text. Text."), ("slot", "Autor: [nombre del proyecto]"), ("slot", "Author: [LINK TO DATA]"), ("slot", "We met. <br> Welcome to <<author>>!"), ("filler", "Mustertext. Noch mehr Text. Mustertext. Mustertext."),
        ("filler", "word\nsome words\nsome words\nsome words"), ("filler", "asdf jkjk qwer sdfgsdfg hjkl"),
        ("instruction", "Replace this paragraph with a description of your data."), ("instruction", "Votre introduction viendra ici."),
        ("error_page", "502 Bad Gateway"), ("error_page", "Access denied. You do not have permission to open this file."), ("error_page", "Der Dienst ist wegen Wartung nicht erreichbar."),
        ("scripts_required", "Please enable JavaScript to view this notebook."), ("scripts_required", "JavaScript est désactivé dans votre navigateur."),
    ],
)
def test_residue_is_found_in_every_rendering(style, kind, line):
    assert kinds(notebook(PROSE, ("text", line), CODE, style=style)) == {kind}
    assert kinds(line) == {kind}


@pytest.mark.parametrize("style", STYLES)
@pytest.mark.parametrize(
    "line",
    [
        "Use `{{ value }}` where the report should show it.", 'We skip pages that only say "Please enable JavaScript to view this notebook."',
        'When the site answered "Bad gateway" we waited and tried again.', "Typesetters set 'lorem ipsum' to judge a font; we use real words.",
        "$$ y = \\frac{{a_0}}{{b}} + {x}^{2} $$", "The field <site> is a number; [brackets] mark optional parts.", "TODO: rerun with k=31 next week.",
        "| site | rate |\n|---|---|\n| 4 | 404 |", "The widget needs scripts to be on in the browser, so a picture is saved.", "See [the guide](https://x.example) and [1], [2].",
    ],
)
def test_talk_about_it_is_no_case(style, line):
    assert kinds(notebook(PROSE, ("text", line), CODE, style=style)) == set()


def test_outputs_tracebacks_and_answers():
    trace = "Traceback (most recent call last)\nCell In[1]\n\nHTTPError: 404 Not Found\nService unavailable."
    assert kinds(notebook(CODE, ("output", trace))) == set()
    assert kinds(notebook(CODE, ("output", "<html><body><h1>Error 503</h1></body></html>"))) == {"error_page"}
    assert kinds(notebook(CODE, ("output", "Lorem ipsum dolor sit amet."))) == {"filler"}
    assert kinds(notebook(CODE, ("output", "True True True True True True True True True True"))) == set()
    assert kinds('{"status": 500, "message": "Something went wrong.", "request": "ab12"}') == {"error_page"}
    assert kinds('<noscript><div class="warn">You need to allow JavaScript to run this app.</div></noscript>') == {"scripts_required"}
    assert kinds(notebook(CODE, ("output", "\n".join(f"step {i}: loss=0.{i}" for i in range(999))))) == set()


def test_small_parts():
    assert list(messages_of_line(masked("  **Error 404** "))) == [("error <code>", True)] and not list(messages_of_line(masked("12 | 3.5")))
    assert list(messages_of_line("we met at noon. the page was not found.")) == [("we met at noon.", True), ("the page was not found.", True)]
    assert list(messages_of_line("we met in the garden at noon. page not found.")) == [("we met in the garden at noon.", True), ("page not found.", False)]
    assert not is_filler("We read the kiln table and keep nine rows of it.") and is_filler("bla bla bla bla")
    assert split_cells(None) == [] and split_cells("") == [("whole", "")] and split_cells('{"cells": 1') == [("whole", '{"cells": 1')]


def test_residue_over_a_table(spark):
    bad = "Service unavailable."
    rows = [
        (1, bad), (2, bad), (3, None), (4, ""), (5, "Author: {{ name }}\n\n" + bad), (6, "An ordinary note."), (None, bad), (7, "word, " * 200_000 + "{{ name }}"),
        (8, notebook(PROSE, CODE)),
    ]
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], "doc_id long, text string, message string, own string").repartition(3)
    got = {(r.doc_id, r.kind) for r in residue(df).collect()}
    assert got == {(1, "error_page"), (2, "error_page"), (5, "error_page"), (5, "slot"), (None, "error_page"), (7, "slot")}
    assert residue(df.limit(0)).count() == 0


def test_length_hides_nothing():
    words = "".join(f" and {a}{b}" for a in "bdfghklmnp" for b in ("al", "or", "im", "est", "un"))
    assert kinds(f"Service unavailable. The rest of this line is about{words}.") == {"error_page"}
    assert kinds("x" * 20_000 + "{{name}}") == {"slot"}
    long = "Please enable or activate or turn on or switch on or allow JavaScript in this browser and in its settings and on this page to see and view and use and reload this page and its content and its viewer"
    assert kinds(long + ".") == {"scripts_required"}
    assert kinds("Please enable JavaScript\nto view this page.") == {"scripts_required"}
    assert kinds(notebook(CODE, ("output", "\n".join(f"Template {{{{item_{i}}}}}" for i in range(3))))) == {"slot"}


def test_long_words_are_masked_in_messages_only():
    image = "iVBORwKGgo+" * 50
    assert scan_text(f"The picture {image} was not found.")[1] == {"the picture <long> was not found.": True}
    assert scan_text(notebook(CODE, ("output", image)))[1] == {} and scan_text(f"{image}{{{{name}}}}")[0] == "slot"


def test_verdicts_come_from_templates(spark):
    """A name in a message hides what it is; where the name varies, the template shows it."""
    names = ["budgets", "gauges", "harvests", "kilometres", "ledgers", "minutes"]
    line = "The requested file %s of project %s could not be opened by this server."
    rows = [(i, line % (a, b)) for i, (a, b) in enumerate(zip(names, reversed(names)))]
    rows += [(100, "The requested file budgets of project harvests was painted by two pianists at sea.")]
    assert all(kinds(t) == set() for _, t in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.kind) for r in residue(df).collect()} == {(i, "error_page") for i in range(len(names))}
