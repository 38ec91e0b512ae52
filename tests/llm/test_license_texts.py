"""License texts that are not among the one-sentence notices."""

from pathlib import Path

from tallyline.llm import license_scan as L

FOLDER = Path(L.__file__).parent / "licenses"


def test_whole_texts_and_headers(spark):
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    mit = (FOLDER / "MIT.txt").read_text().split("\n\n")[-1]
    rows = [(1, "/* Tool.\n * " + gpl + " */ int x;"), (2, "x " * 50 + mit), (3, "a page about the terms of a license and of the version that you can redistribute"), (4, (FOLDER / "GPL-2.0.txt").read_text()), (5, "CC: This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.")]
    got = {}
    for r in L.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert 75 * r.n_template <= 100 * r.n_found <= 100 * r.n_template
        got.setdefault(r.doc_id, {})[r.license] = r.n_found == r.n_template
    assert got[1]["GPL-3.0 header 1"] and any(k.startswith("MIT ") for k in got[2]) and 3 not in got
    whole = [k for k, _ in L.TEMPLATES if k.startswith("GPL-2.0 ") and "header" not in k]
    assert len(whole) > 100 and all(got[4][k] for k in whole)
    assert got[5] == {"CC-BY-SA-4.0 notice 1": True}


def test_windows_cover_texts():
    assert len({k for k, _ in L.TEMPLATES}) == len(L.TEMPLATES)
    words = [str(i) for i in range(95)]
    parts = [w.split() for w in L.windows_of(" ".join(words))]
    assert {x for p in parts for x in p} == set(words) and {len(p) for p in parts} == {L.WORDS} and parts[-1][-1] == "94"
    assert L.windows_of("a b") == ["a b"]
