"""Pages that nest without end, and parts of articles that are named like something else."""

import subprocess
import sys

import pytest

from paperlode.llm.html_text import main_text

PROSE = "This is a long paragraph of an article that says something about a matter and goes on for a while."


@pytest.mark.parametrize("tag", ["<div>", "<div class=ad>", "<div class=related>", "<p><span class='promo'>", "<article class='x sidebar'>", "<table><tr><td>", "<li>"])
def test_depth_costs_no_memory(tag):
    code = (
        "import resource; resource.setrlimit(resource.RLIMIT_AS, (1 << 30, 1 << 30));"
        "from paperlode.llm.html_text import main_text;"
        f"print(main_text({tag!r} * 200_000 + {PROSE!r}))"
    )
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env={"OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1"}, cwd=".")
    assert run.stdout.strip() == PROSE, run.stderr[-500:]


def page(inner, before="", after=""):
    return f"<body>{before}<article><h1>Title</h1><p>{PROSE} {PROSE}</p>{inner}</article>{after}</body>"


def test_a_paper_keeps_its_discussion():
    text = main_text(page(f"<section id='discussion'><h2>Discussion</h2><p>{PROSE}</p></section><section class='related'><h2>Related work</h2><p>{PROSE}</p></section>"))
    assert text.split("\n") == ["Title", f"{PROSE} {PROSE}", "Discussion", PROSE, "Related work", PROSE]


def test_a_market_page_keeps_its_prices():
    text = main_text(f"<body><h1>Market</h1><section class='share-prices'><p>{PROSE} {PROSE}</p><p>Up 3 %</p></section><p>{PROSE}</p></body>")
    assert text.split("\n") == ["Market", f"{PROSE} {PROSE}", "Up 3 %", PROSE]


@pytest.mark.parametrize(
    "other",
    [
        "<div class='share'><a href=a>Facebook</a> <a href=b>Mail</a></div>",
        f"<div class='related'><h3>Related</h3><ul><li><a href=x>{PROSE}</a></li></ul></div>",
        f"<div class='related'><h3><a href=x>A headline of another page</a></h3><p>{PROSE[:70]}</p></div>",
        "<div class='alert'>Your session ends soon.</div>",
        f"<div class='discussion'><div class='author'>Bob</div><p>{PROSE}</p></div>",
        f"<section id='discussion'><p>{PROSE}</p><form><textarea></textarea></form></section>",
        f"<div id='comments'><p>{PROSE}</p></div>",
        f"<div class='notice'><p>{PROSE}</p></div>",
    ],
)
def test_what_also_looks_like_something_else_goes(other):
    want = ["Title", f"{PROSE} {PROSE}"]
    assert main_text(page(other)).split("\n") == want
    assert main_text(page("", before=other)).split("\n") == want
    assert main_text(page("", after=other)).split("\n") == want
