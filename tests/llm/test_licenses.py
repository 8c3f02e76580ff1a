import math
import re
import textwrap
from collections import Counter

import pytest
from helpers import clash, empty

from tidemark.llm import licenses

SCHEMA = "doc_id long, path string, text string"


def terms(p):
    out = [re.sub(r"^[.+-]+|[.-]+$", "", t) for t in re.split(r"[^\w.+-]+|_", p.lower())]
    return [t for t in out if t]


def spoken(text, is_file):
    """The passages of a file that are compared, and whether they count for the weights."""
    cue = lambda p: re.search(licenses.CUE, p)
    counted = dict.fromkeys(([text] if is_file else []) + [s for s in re.split(r"(?<=[.!?])\s+|[\r\n]+", text) if cue(s)])
    if not (is_file or cue(text)):
        return []
    every = re.split(r"\n[^\w]*\n", re.sub(r"\r\n?", "\n", text).replace("_", "-"))
    runs, run = [], []
    for p in [*every, ""]:
        if cue(p):
            run.append(p)
        elif run:
            runs.append("\n\n".join(run).strip(" "))
            run = []
    some = [p for p in every if cue(p)]
    joined = dict.fromkeys([*runs, *some, *(s for p in some for s in re.split(r"(?<=[.!?])\s+", p) if cue(s))])
    return [(p, 1) for p in counted] + [(p, 0) for p in joined if p not in counted]


def brute(rows):
    passages = []
    for i, path, text in rows:
        name = (path or "").rsplit("/", 1)[-1]
        is_file = path is not None and bool(re.match(r"(licen[cs]e|copying|notice|unlicense)\b", name, re.I))
        passages += [(i, path, is_file, p, n) for p, n in spoken(text or "", is_file)]
    total = sum(n for *_, n in passages)
    df = Counter(t for *_, p, n in passages if n for t in set(terms(p)))
    vec = lambda p: {t: k * (math.log((1 + total) / (1 + df[t])) + 1) for t, k in Counter(terms(p)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    place = lambda path: path.rsplit("/", 1)[0] if "/" in path else ""
    own, given = {}, {}
    for i, path, is_file, p, _ in passages:
        v, best = vec(p), None
        for k, (name, t) in enumerate(licenses.TEMPLATES):
            w = vec(t)
            if v and (c := round(sum(v[x] * w.get(x, 0) for x in v) / norm(v) / norm(w), 9)) >= licenses.SIMILAR:
                best = max(best or (0,), (c, -k, name))
        if best:
            rank = (best[2] != licenses.LAST, round(best[0] * norm(v), 6), best[2], best[0])
            own[i] = max(own.get(i, rank), rank)
            if is_file:
                given.setdefault(place(path), {}).setdefault(path, []).append(rank)
    out = {}
    for i, path, _ in rows:
        if i in own:
            out[i] = ("own", own[i][2], own[i][3])
            continue
        out[i] = ("none", None, None)
        at = None if path is None else place(path)
        while at is not None:
            if at in given:
                count, top = Counter(), {}
                for ranks in given[at].values():
                    _, _, name, c = max(ranks)
                    count[name] += 1
                    top[name] = max(top.get(name, 0), c)
                _, _, c, name = max((x != licenses.LAST, count[x], top[x], x) for x in count)
                out[i] = ("inherited", name, c)
                break
            at = (at.rsplit("/", 1)[0] if "/" in at else "") if at else None
    return out


def rows():
    return [
        (1, "/a/LICENSE", "Released under the MIT License."),
        (2, "/a/b/c/x.py", "plain text"),
        (3, "/a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0."),
        (4, "/a/b/y.py", None),
        (5, "/a/z.py", "Some words here.\nThis work is licensed under the GNU General Public License, version 3. More."),
        (6, "/q/none.py", "the license of a poet is long and this sentence is far from any template at all"),
        (7, None, "All rights reserved."),
        (8, None, ""),
        (9, "/a/COPYING", "Licensed under CC BY-NC 4.0.\nblah"),
        (10, "/a/b2/w", "x " * 30_000 + "\nReleased under the MIT License."),
        (11, "/a/LICENSE-2", "RELEASED under the mit license"),
        (12, "noslash", "t"),
        (13, "LICENSE", "Licensed under the MIT License."),
        (14, "src/deep/y.py", "t"),
        (15, "/elsewhere/y.py", "t"),
    ]


def test_scan_by_brute_force(spark):
    df = clash(spark.createDataFrame(rows(), SCHEMA))
    got = {r["doc_id"]: (r["origin"], r["license"], r["cosine"]) for r in licenses.scan(df).collect()}
    want = brute(rows())
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][:2] == want[i][:2], i
        assert got[i][2] == pytest.approx(want[i][2], abs=2e-9)
    assert want[2][1] == "Apache-2.0" and want[5][1] == "GPL-3.0-only"
    assert [want[i][:2] for i in (12, 14, 15)] == [("inherited", "MIT")] * 3  # the root covers them


BSD = """ * Copyright (c) 2020, Some One
 * All rights reserved.
 *
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *
 * 1. Keep this.
"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
"""


def test_wrapped_headers(spark):
    texts = [(1, "/b/LICENSE", BSD), (2, "/b/x.c", "text"), (3, "/g/y.py", GPL), (4, "/g/z.py", GPL.replace("\n", "\r\n")), (5, "/p/w", "All rights reserved.")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(texts, SCHEMA)).collect()}
    assert [got[i]["license"] for i in range(1, 6)] == ["BSD-3-Clause", "BSD-3-Clause", "GPL-3.0-or-later", "GPL-3.0-or-later", licenses.LAST]
    assert got[1]["licenses"] == got[2]["licenses"] == ["BSD-3-Clause", licenses.LAST] and got[2]["origin"] == "inherited"


def wrapped(text, start="", width=72):
    return "\n".join(start + line for p in text.split("\n\n") for line in [*textwrap.wrap(p, width), ""])


def test_whole_licenses_and_headers(spark):
    """Whole license files and source headers of each are found, and inherited below."""
    given = "Copyright (c) 2021 Some Body\nAll rights reserved.\n\n"
    apache = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS\n\n   1. Definitions.\n\n      \"Work\" shall mean the work.\n"
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n\n  " + "The terms of this work are many. " * 300
    mpl = "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------\n\n" + "Each word means much. " * 300
    files = {
        "MIT": "MIT License\n\n" + given + wrapped(licenses._MIT), "ISC": given + wrapped(licenses._ISC), "BSD-2-Clause": given + wrapped(licenses._BSD_2 + licenses._BSD_END),
        "BSD-3-Clause": given + wrapped(licenses._BSD_2 + licenses._BSD_3 + licenses._BSD_END), "Apache-2.0": apache, "GPL-3.0-only": gpl, "MPL-2.0": mpl,
    }
    headers = {
        "MIT": licenses._MIT, "ISC": licenses._ISC, "BSD-2-Clause": licenses._BSD_2 + licenses._BSD_END, "BSD-3-Clause": licenses._BSD_2 + licenses._BSD_3 + licenses._BSD_END,
        "Apache-2.0": licenses._APACHE, "GPL-3.0-or-later": licenses._GPL.format(kind="", n=3), "LGPL-3.0-or-later": licenses._GPL.format(kind=" Lesser", n=3), "MPL-2.0": licenses._MPL,
    }
    rows, want = [], {}
    for name, text in files.items():
        rows += [(len(rows), f"f/{name}/LICENSE", text), (len(rows) + 1, f"f/{name}/src/y.c", "code")]
        want[len(rows) - 2], want[len(rows) - 1] = ("own", name), ("inherited", name)
    for name, text in headers.items():
        rows.append((len(rows), f"h/{name}.c", wrapped(given + text, " * ") + "\n\n" + "int x = 0;\n" * 400))
        want[len(rows) - 1] = ("own", name)
    got = {r["doc_id"]: (r["origin"], r["license"]) for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([*rows(), rows()[0], (None, "/a/n", "All rights reserved."), (None, "/a/m", "t")], SCHEMA)
    assert licenses.scan(df).count() == len(rows()) + 3
    assert licenses.scan(empty(df)).count() == 0


def test_native(spark):
    plan = licenses.scan(spark.createDataFrame(rows(), SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
