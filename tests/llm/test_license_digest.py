import hashlib
import re
from pathlib import Path

import pytest

from quirework.llm import license_digest as L

COMMON = Path("/usr/share/common-licenses")


def statement(line):
    """Whether a lower-cased line states a copyright."""
    line = line.lstrip(" \t/*#;-")
    if line.startswith("©"):
        return True
    if line.startswith("(c)"):
        rest = line[3:].lstrip(" \t")
        return rest[:1] in tuple("0123456789<[{©") or rest.startswith("copyright")
    for word in ("copyright", "copr."):
        if line.startswith(word):
            rest = line[len(word) :].lstrip(" \t:,")
            if rest[:1] in tuple("©0123456789<[{") or rest.startswith("(c)"):
                return True
            return rest[:1].isalpha() and rest != line[len(word) :] and re.match("[a-z]*", rest)[0] not in L.TEXT_WORDS
    return False


def form(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[a-z0-9\u0080-\U0010ffff]+", "\n".join(x for x in low.split("\n") if not statement(x)))
    kept, at = [], 0
    while at < len(words):
        if words[at : at + 3] == ["all", "rights", "reserved"]:
            at += 3
        else:
            kept.append(words[at])
            at += 1
    one = dict(L.SPELLINGS)
    out = []
    for k, w in enumerate(kept):
        pair = f"copyright {w}" if k and kept[k - 1] == "copyright" else ""
        out.append(one[pair].split()[1] if pair in one else one.get(w, w))
    return " ".join(out)


def test_every_known_text_in_other_dress(spark):
    rows, want = [], []
    for name, text in L.KNOWN:
        for dress in (
            text, text.upper(), f"Copyright (c) 2020 Someone\n{text}", text.replace("\n\n", "\r\n \n"),
            text.replace(" license ", " licence ").replace(" License,", " Licence,") + "\nAll rights\nreserved.", " © us\n" + text, f"Copyright: Jane Doe\n# (C) 1999 X\n{text}\nAll Rights Reserved all rights reserved",
            *(re.sub(rf" (?={word})", "\n", text) for word in ("[Cc]opyright", "COPYRIGHT", "[a-z]", "[A-Z]")),
        ):
            rows.append((len(rows), dress, "x"))
            want.append(name)
    rows += [(9000, None, "x"), (9001, "", "x"), (9002, "Copyright 2020 only", "x"), (9003, L.KNOWN[0][1] + " and more", "x"), (9004, "é" * 1000, "x"), (9004, "é" * 1000, "x"), (9005, "licence Licence LICENCES https https copyright holder\ncopyright holder copyright", "x"), (9006, "(c) You must\n(c) 2001 A\ncopyrighted\ncopyright\ncopyright Ünal\ncopyright laws of", "x"), (9007, "licence word " * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license_id string").repartition(3)
    got = L.scan(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    ids = {hashlib.sha256(form(t).encode()).hexdigest(): n for n, t in reversed(L.KNOWN)}
    for i, text, _ in rows:
        h = hashlib.sha256(form(text).encode()).hexdigest()
        assert by[i].n_words == len(form(text).split()) and by[i].canonical_sha256 == h, text
        assert by[i].license_id == ids.get(h)
    assert [by[k].license_id for k in range(len(want))] == want
    assert form(rows[-3][1]) == "license license licenses http http copyright owner copyright owner copyright"
    assert not any(by[k].is_license for k in range(9000, 9008))
    assert L.scan(docs.limit(0)).count() == 0
    none = spark.createDataFrame([(None, None), ("E", "")], "license_id string, text string")
    assert L.scan(docs, none).where("is_license").count() == 0


@pytest.mark.skipif(not COMMON.is_dir(), reason="no licence texts on this machine")
def test_long_licences(spark):
    names = {"Artistic": "Artistic-1.0-Perl", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-3": "LGPL-3.0", "BSD": "BSD-UC"}
    files = [(names.get(f.name, f.name), f.read_text(encoding="utf-8")) for f in sorted(COMMON.iterdir()) if not f.is_symlink()]
    # sentences, not statements of a copyright, may break before the word
    broken = lambda text: "\n".join(x if statement(x.lower()) else re.sub(rf"(?<=\w) (?=copyright ({'|'.join(L.TEXT_WORDS)})\b)", "\n", x) for x in text.split("\n"))
    rows = [(k, dress) for k, (_, text) in enumerate(files) for dress in (text, broken(text), text.upper())]
    assert sum(broken(text) != text for _, text in files) > 8
    got = {(r.doc_id, r.license_id) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    known = dict(L.KNOWN_DIGESTS)
    assert got == {(k, name if name in known else None) for k, (name, _) in enumerate(files)} and len(known) >= 12


def test_no_python_in_the_plan(spark):
    plan = L.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([("a", "b")], "license_id string, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
