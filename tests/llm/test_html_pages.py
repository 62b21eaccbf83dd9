"""Main text of unmarked pages, and of pages made to be slow."""

import time

import pytest

from ledgerspark.llm.html_text import main_text

LONG = "The river rose in the night, and by morning the lower road was under water from the mill to the bridge."
LATE = "Nobody was hurt, and the road opened again at noon."
MENU = "<div><a href=/>Home</a></div><div><a href=/n>News</a></div><div><a href=/s>Sport</a></div><div><a href=/c>Contact</a></div>"

PAGES = {
    "menu between": (f"<p>{LONG}</p>{MENU}<p>{LATE}</p>", f"{LONG}\nHome\nNews\nSport\nContact\n{LATE}"),
    "menu first": (f"{MENU}<p>{LONG}</p><p>{LATE}</p>", f"{LONG}\n{LATE}"),
    "menu last": (f"<p>{LONG}</p><p>{LATE}</p>{MENU}", f"{LONG}\n{LATE}"),
    "foot": (f"<p>{LONG}</p><div class=foot>Copyright 2020 Mill Press. All rights reserved.</div>", LONG),
    "plain legal": (f"<p>{LONG}</p><div>© 2020 Mill Press</div><div>Privacy policy</div>", LONG),
    "cookie bar": (f"<div>We use cookies to improve your experience. Accept</div><p>{LONG}</p>", LONG),
    "cookies as a topic": (f"<p>{LONG}</p><p>She baked cookies for the firemen.</p>", f"{LONG}\nShe baked cookies for the firemen."),
    "comment list": (f"<p>{LONG}</p><ol class=\"commentlist\"><li>first!</ol>", LONG),
    "short heading": (f"<div><p>{LONG}</p></div><div><h2>The bridge</h2></div><div><p>{LATE}</p></div>", f"{LONG}\nThe bridge\n{LATE}"),
    "only one sentence": (f"{MENU}<p>{LATE}</p>{MENU}", LATE),
    "values that look like names": (f'<div style="overflow:hidden" data-id="footer"><p>{LONG}</p></div>', LONG),
    "unclosed comment": (f"<p>{LONG}</p><!-- {LATE}", LONG),
    "brackets in text": (f"<p>{LONG} 5 <! 6</p><p>a < b</p>", f"{LONG} 5"),
}


@pytest.mark.parametrize("name", PAGES)
def test_unmarked(name):
    page, want = PAGES[name]
    if name == "menu between":  # what lies between two stretches of text stays if it has a size
        assert main_text(page).split("\n")[0] == LONG and main_text(page).split("\n")[-1] == LATE
    elif name == "brackets in text":  # a declaration ends at the next bracket, as in browsers
        assert main_text(page).startswith(want)
    else:
        assert main_text(page) == want


def test_comment_list_in_article():
    assert main_text(f"<article><p>{LONG}</p><ol class='commentlist'><li>first!</li></ol></article>") == LONG


HOSTILE = {
    "spaces in a tag": "<p" + " " * 200_000 + "=>x",
    "declarations": "<!" * 100_000,
    "declarations, one end": "<!" * 100_000 + ">x",
    "digits": "<p>&#" + "9" * 200_000 + ";x",
    "zeros": "<p>&#" + "0" * 200_000 + "65;",
    "quotes": "<a \"'" * 50_000,
    "open quotes": "<p a=b\" c=\"d " * 16_000 + ">",
    "comments": "<!--" * 50_000,
    "equals": "<p" + "=" * 200_000 + ">x",
    "names": "<p " + "a " * 100_000 + ">x",
    "scripts": "<script" * 28_000,
    "elements": "<div>" * 40_000,
    "items": "<ul>" + "<li>" * 50_000,
    "cookies": "<p>" + "cookie " * 28_000,
    "words": "<p>" + "word " * 40_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_of_hostile_pages(name):
    start = time.process_time()
    main_text(HOSTILE[name])
    assert time.process_time() - start < 1


def test_references():
    assert main_text("<p>&#0000000065; &#65; &amp; &#99999999; &#x41;") == "A A & � A"
