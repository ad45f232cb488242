"""Every page is compared with the page of the nearest URL, whatever it marks; markup checks the result."""

import random
from pathlib import Path
from urllib.parse import urlsplit

from cardamom.llm import htmltext


def test_marked_pages_are_differenced_too(spark):
    page = "<nav>Menu {0}</nav><article><p>Read more</p><p>Story {0} of its own, told at length</p><p>The end</p></article><footer>Imprint</footer>"
    rows = [(i, f"https://h.example/a/{i}", page.format(i)) for i in range(4)] + [(9, None, page.format(9))]
    got = {r["page_id"]: r for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(r["text"] == f"Read more\nStory {i} of its own, told at length\nThe end" and r["decided_by"] == "markup" for i, r in got.items())
    # two lines of each article are on the nearest page; without an URL there is none
    assert [got[i]["n_shared"] for i in (0, 1, 2, 3, 9)] == [2, 2, 2, 2, None]


def test_texts_are_neither_stored_nor_moved_twice(spark, monkeypatch):
    """Pairing needs hashes of lines alone, so the tables that it makes are small beside the pages, and equal pages get equal results."""
    pick, sizes = random.Random(3), {}
    kept = htmltext.stored

    def watched(df, name):
        made = kept(df, name)
        sizes[name] = sum(Path(urlsplit(f).path).stat().st_size for f in made.inputFiles())
        return made

    monkeypatch.setattr(htmltext, "stored", watched)
    stories = ["".join(pick.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(8000)).split() for _ in range(60)]
    rows = [(i, f"https://h.example/a/{i}", f"<div>Menu</div><p>{' '.join(s)}</p><div>Imprint</div>") for i, s in enumerate(stories)]
    rows += [(100 + k, *rows[7][1:]) for k in range(40)] + [(200, None, rows[7][2])]
    got = {r["page_id"]: r for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: " ".join(s) for i, s in enumerate(stories)}
    assert {i: r["text"] for i, r in got.items() if i < 60} == want
    assert all(got[100 + k]["text"] == want[7] and got[100 + k]["n_shared"] == 2 for k in range(40))
    assert got[200]["text"] == f"Menu\n{want[7]}\nImprint" and got[200]["n_shared"] is None
    assert sum(sizes.values()) < sum(map(len, want.values())) / 4
