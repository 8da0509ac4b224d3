"""License scans: alignment against brute force, every template, and the notices in the documents."""

import random
import re

import pytest
from oracle import FOLDER

from tidelog.llm.license_scan import LEAST, LENGTHS, LOOSE, MARK, NAMES, TEMPLATES, Templates, align, allowed, scan_licenses, words_of


def distance(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        above, row = row, [row[0] + 1]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_alignment():
    rng = random.Random(3)
    for _ in range(300):
        t, b = ([rng.choice("abcd") for _ in range(n)] for n in (rng.randint(1, 6), rng.randint(0, 9)))
        cost, start, end = align(t, b)
        assert cost == distance(t, b[start:end]) == min(distance(t, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_each_template(name):
    found = Templates(TEMPLATES).scan(f"Prose that goes before it. {TEMPLATES[name]}\nAnd prose after it.", re.compile(MARK))
    assert [(f[0], f[1], f[2], f[3]) for f in found] == [(name, 5, len(words_of(TEMPLATES[name])), 0)]


def test_wording_decides():
    known, mark = Templates(TEMPLATES), re.compile(MARK)
    grant = TEMPLATES["MIT:grant"]
    near = known.scan("x " + grant.replace("without restriction", "with no restriction").replace("\n", " "), mark)
    assert [(f[0], f[3]) for f in near] == [("MIT:grant", 2)]
    for text in ("This work is licensed under the GNU General Public License, version 4.", "Licensed under CC BY-NC 3.0.", "I lost my driving licence.", "licensed " * 500, grant[:80]):
        assert known.scan(text, mark) == []
    both = known.scan("Released under the MIT License. " + "word " * 40 + "Licensed under CC BY 4.0.", mark)
    assert [f[0] for f in both] == ["MIT", "CC-BY-4.0"]


@pytest.mark.parametrize("first", sorted(TEMPLATES))
def test_notices_side_by_side(first):
    """Every ordered pair of templates, one behind the other, and a third behind some."""
    known, mark = Templates(TEMPLATES), re.compile(MARK)
    for second in sorted(TEMPLATES):
        for third in ("", "BSD-3-Clause"):
            names = [n for n in (first, second, third) if n]
            found = known.scan("Some prose. " + " ".join(TEMPLATES[n] for n in names) + " More prose.", mark)
            starts = [2 + sum(len(words_of(TEMPLATES[n])) for n in names[:i]) for i in range(len(names))]
            assert [(f[0], f[1], f[2], f[3]) for f in found] == [(n, s, len(words_of(TEMPLATES[n])), 0) for n, s in zip(names, starts, strict=True)], names


def test_small_differences_of_short_notices():
    known, mark = Templates(TEMPLATES), re.compile(MARK)
    found = lambda text: [(f[0], f[3]) for f in known.scan(f"Some prose. {text} More prose.", mark)]
    assert found("Licensed under the Apache License 2.0.") == [("Apache-2.0", 1)]
    assert found("Released under MIT License.") == [("MIT", 1)]
    assert found("Available under the MIT License.") == [("MIT", 1)] or found("Available under the MIT License.") == [("MIT:licensed", 1)]
    for text in ("Licensed under CC BY-XX 4.0.", "Licensed under the BSD 4-Clause License.", "This work is licensed under the GNU Free General License, version 3.", "SPDX-License-Identifier: Other", "The MIT campus needs a license."):
        assert found(text) == [], text


PROSE = [f"w{n}" for n in range(60)] + "the of and to in is that for it as with was on be at by this had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must".split()


def altered(rng, words, differences):
    """The words with so many of them left out, changed or followed by another; names and numbers stay."""
    words = list(words)
    free = [i for i, w in enumerate(words) if w not in NAMES and not any(c.isdigit() for c in w)]
    for i in rng.sample(free, min(differences, len(free))):
        words[i] = rng.choice(["", rng.choice(PROSE), f"{words[i]} {rng.choice(PROSE)}"])
    return " ".join(words).split()


def test_the_share_that_is_asked_for_loses_nothing():
    known, rng = Templates(TEMPLATES), random.Random(8)
    for name, words in known.words.items():
        if len(words) < LOOSE:
            continue
        reach = known.reach[next(k for k, names in enumerate(known.classes) if name in names)]
        for trial in range(12):
            other = known.words[rng.choice(sorted(known.words))] if trial % 3 == 0 else []
            around = [[rng.choice(PROSE) for _ in range(rng.randint(0, reach))] for _ in range(2)]
            block = (around[0] + other)[-reach:] + altered(rng, words, allowed(words)) + (other + around[1])[:reach]
            assert known.saving(" ".join(block).encode(), name) >= (LEAST + 0.1) * known.own[name], (name, trial)


def everywhere(known, words):
    """All templates at all places, without any compression: those with few enough differences, the longest first, of equal ones the one with the fewest differences, and no two that overlap."""
    hits = []
    for name, template in known.words.items():
        spans = [(0, len(words))]
        while spans:
            low, high = spans.pop()
            cost, start, end = align(template, words[low:high])
            if cost <= allowed(template) and known._same_names(template, words[low + start : low + end]):
                hits.append((-sum(len(template) > n for n in LENGTHS), cost, name, low + start, low + end))
                spans += [(low, low + start), (low + end, high)]
    out = []
    for _, cost, name, start, end in sorted(hits):
        if all(end <= a or b <= start for _, a, b, _ in out):
            out.append((name, start, end, cost))
    return sorted((name, cost) for name, _, _, cost in out)


@pytest.mark.parametrize("seed", range(4))
def test_equals_all_templates_at_all_places(seed):
    """Random texts with notices planted in them, as they are or altered, apart or side by side."""
    known, mark, rng = Templates(TEMPLATES), re.compile(MARK), random.Random(seed)
    for _ in range(25):
        text = []
        for _ in range(rng.randint(0, 4)):
            name = rng.choice(sorted(TEMPLATES))
            words = known.words[name]
            text += [rng.choice(PROSE) for _ in range(rng.choice([0, 3, 40, 300]))]
            text += altered(rng, words, rng.choice([0, 0, allowed(words) // 2])) if len(words) >= LOOSE else words
        text += [rng.choice(PROSE) for _ in range(rng.randint(0, 40))]
        found = [(f[0], f[3]) for f in known.scan(" ".join(text), mark)]
        assert sorted(found) == everywhere(known, text), " ".join(text)


def test_compression_decides(monkeypatch):
    """With another ranking, another wording that the differences allow is found."""
    text, mark = "Some prose. Licensed under the MIT License. More prose.", re.compile(MARK)
    assert [f[0] for f in Templates(TEMPLATES).scan(text, mark)] == ["MIT:licensed"]
    monkeypatch.setattr(Templates, "saving", lambda self, raw, name, size=None: 100 * (name == "MIT"))
    assert [(f[0], f[3]) for f in Templates(TEMPLATES).scan(text, mark)] == [("MIT", 1)]


def test_many_notices_in_one_text():
    import time

    known, mark = Templates(TEMPLATES), re.compile(MARK)
    began = time.time()
    found = known.scan("Some more prose here. Released under the MIT License. " * 20_000, mark)
    assert len(found) == 20_000 and {f[0] for f in found} == {"MIT"} and time.time() - began < 60


def test_many_templates_that_save_alike():
    """No template is left out of the alignment, however many rank before it."""
    versions = {f"X-{n}": f"This file may be used under the house license in its edition {n} by anyone who keeps this notice." for n in range(40)}
    known, mark = Templates(versions), re.compile(MARK)
    for n in (0, 7, 23, 39):
        assert [(f[0], f[3]) for f in known.scan(f"Prose. {versions[f'X-{n}']} Prose.", mark)] == [(f"X-{n}", 0)]


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "w " * 200_000 + "RELEASED UNDER THE MIT LICENSE!! " + "w " * 200_000), (None, "Licensed under CC BY 4.0."), (4, "Released under the MIT License."), (4, "Released under the MIT License.")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string")
    got = sorted((str(r["doc_id"]), r["license"], r["wording"], r["first_word"], r["differences"]) for r in scan_licenses(docs).collect())
    assert got == [("3", "MIT", None, 200_000, 0), ("4", "MIT", None, 0, 0), ("4", "MIT", None, 0, 0), ("None", "CC-BY-4.0", None, 0, 0)]
    assert scan_licenses(docs.limit(0)).count() == 0


def test_notices_of_the_documents(spark):
    docs = spark.read.parquet(FOLDER.replace("0.001", "0.01") + "/documents.parquet")
    plain = {n: TEMPLATES[n] for n in ("MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0")}
    expected = sorted((r["doc_id"], n) for r in docs.collect() for line in (r["text"] or "").split("\n") for n, t in plain.items() if line == t)
    assert sorted((r["doc_id"], r["license"]) for r in scan_licenses(docs).collect()) == expected and expected
