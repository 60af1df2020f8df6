"""License scans against every window compared with every template."""

import re
from collections import Counter

import pytest

from softcluster.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    """(word, line) of a text."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [(w, i) for i, x in enumerate(low.split("\n")) for w in WORD.findall(x)]


def slow(doc, text, threshold=0.8):
    w = words(text)
    g = [(a[0], b[0]) for a, b in zip(w, w[1:])]
    any_of = [x in VOCABULARY for x in g]
    found = {}
    for a in range(len(g)):
        if any_of[a]:
            for name, own, size in TEMPLATES:
                if g[a] not in own:
                    continue
                seen, shared = Counter(), 0
                for b in range(a, min(len(g), a + int(1.5 * size + 1e-9))):
                    seen[g[b]] += 1
                    shared += seen[g[b]] <= own[g[b]]
                    if g[b] in own and 2 * shared >= threshold * (b - a + 1 + size) - 1e-9:
                        found.setdefault((a, b), []).append((2 * shared / (b - a + 1 + size), shared, name))
    ranked, kept = [], []
    for (a, b), x in found.items():
        dice = max(x)[0]
        tied = [y for y in x if y[0] == dice]
        ranked.append((-dice, -max(y[1] for y in tied), a, b, "|".join(sorted({y[2] for y in tied}))))
    for dice, _, a, b, name in sorted(ranked):
        if all(b + 1 < c or d + 1 < a for c, d, *_ in kept):
            kept.append((a, b, -dice, name))
    return [(doc, a, b - a + 2, w[a][1], w[b + 1][1] - w[a][1] + 1, name, round(dice, 9)) for a, b, dice, name in kept]


def _template(name, text):
    w = [x for x, _ in words(text)]
    return name, Counter(zip(w, w[1:])), len(w) - 1


TEMPLATES = [_template(*t) for t in licenses.TEMPLATES]
VOCABULARY = set().union(*(c for _, c, _ in TEMPLATES))
MIT = licenses.TEMPLATES[14][1]
ODD = [
    (1, None), (2, ""), (3, "\n\n...\n"), (4, "RELEASED under the mit   license"), (5, "x\n" * 30000 + "Released under the MIT License.\n"),
    (6, MIT.replace(". ", ".\n").replace(", ", ",\n") + "\n\nmore"), (7, "word " * 200000 + "\nLicensed under CC BY-NC 4.0."),
    (8, "This work is licensed under the GNU General Public License, version 3.\nno"), (8, "Licensed under the Apache License, Version 2.0"),
    (8, "Licensed under the Apache License, Version 2.0"), (None, "Licensed under CC BY 4.0.\nLicensed under CC BY 4.0."),
    (9, "-\nLicensed under\nthe MPL, Version 2.0.\n-"), (10, "license"), (11, MIT.replace("Software", "Work") + " end of it"),
]


def rows(found):
    return [(r.doc_id, r.first_word, r.n_words, r.first_line, r.n_lines, r.license, round(r.dice, 9)) for r in found.collect()]


def test_matches_every_window(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionAll(
        spark.createDataFrame(ODD, "doc_id long, text string")).selectExpr("*", "1 as first_word").repartition(4)
    got = rows(licenses.scan(docs))
    want = [x for r in docs.collect() for x in slow(r.doc_id, r.text)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {x[5] for x in got} >= {"MIT", "GPL-3.0", "Apache-2.0", "CC-BY-NC-4.0"}
    assert licenses.scan(docs.where("false")).collect() == []
    assert {r.license: r.n_docs for r in licenses.summary(licenses.scan(docs)).collect()}["MIT"] >= 3


PROSE = "a paragraph of other words that goes on and on "
CASES = [
    # wrapped within a paragraph: the version on the second line decides
    (PROSE + "\nThis work is licensed under the GNU General Public\nLicense, version 3. " + PROSE, [("GPL-3.0", 1.0, 1, 2)]),
    (PROSE + "\nThis work is licensed under the GNU General Public\nLicense, version 2. " + PROSE, [("GPL-2.0", 1.0, 1, 2)]),
    ("Some prose here. Licensed under the Apache License, Version 2.0. More prose follows here.", [("Apache-2.0", 1.0, 0, 1)]),
    # no version: both
    ("This work is licensed under the GNU General Public License. " + PROSE, [("GPL-2.0|GPL-3.0", 0.9, 0, 1)]),
    # side by side on one line
    ("Licensed under CC BY 4.0. Licensed under CC BY-SA 4.0. Licensed under CC BY-NC 4.0.",
     [("CC-BY-4.0", 1.0, 0, 1), ("CC-BY-SA-4.0", 1.0, 0, 1), ("CC-BY-NC-4.0", 1.0, 0, 1)]),
    # a grant followed by code without a blank line, words put in
    (MIT.replace("the rights to use", "all of the many rights to freely use") + "\nint main() { return 0; }", [("MIT", None, 0, 1)]),
    ("The public sale was licensed by the city. " * 50, []), ("license", []),
]


def test_wrapped_embedded_and_tied_notices(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string").coalesce(1)
    got = sorted(rows(licenses.scan(docs)))
    for i, (text, want) in enumerate(CASES):
        mine = [x for x in got if x[0] == i]
        assert mine == sorted(slow(i, text))
        assert [(x[5], x[3], x[4]) for x in mine] == [(name, line, n) for name, _, line, n in want]
        assert all(dice is None or abs(x[6] - dice) < 1e-9 for x, (_, dice, _, _) in zip(mine, want))


def test_many_notices_in_one_text(spark):
    text = "Released under the MIT License.\n" * 3000
    found = rows(licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert sorted(x[3] for x in found) == list(range(3000)) and {x[5] for x in found} == {"MIT"}


def test_templates_need_two_words(spark):
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"), (("MIT", "MIT"),))
