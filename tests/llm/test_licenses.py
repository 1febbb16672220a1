"""Licences against plain TF-IDF and a walk up the folders."""

import math
import random
import re

from ratelens.llm.licenses import LICENSE_FILE, MARKER, OTHER_IDF, TEMPLATES, THRESHOLD, full_texts, license_scan


def words_of(text):
    return re.findall("[a-z0-9]+", text.lower())


def counts(words):
    return {w: words.count(w) for w in words}


def brute(files):
    vocabulary = {w for t in TEMPLATES.values() for w in words_of(t)}
    df = {w: sum(w in set(words_of(t or "")) for _, t in files) for w in vocabulary}
    idf = {w: math.log((1 + len(files)) / (1 + n)) + 0.1 for w, n in df.items()}
    own = {}
    for path, text in files:
        if path is None or text is None:
            continue
        units = [line for line in text.split("\n") if re.search(MARKER, line)]
        if re.search(LICENSE_FILE, path.split("/")[-1]):
            units.append(text)
        for unit in units:
            v = {w: n * idf.get(w, OTHER_IDF) for w, n in counts(words_of(unit)).items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            for name, t in TEMPLATES.items():
                u = {w: n * idf[w] for w, n in counts(words_of(t)).items()}
                dot = sum(x * u.get(w, 0) for w, x in v.items())
                score = round(dot / norm / math.sqrt(sum(x * x for x in u.values())), 6) if dot else 0
                if score >= THRESHOLD and (path not in own or (-score, name) < own[path]):
                    own[path] = (-score, name)
    folders = {}
    for path, (score, name) in sorted(own.items(), key=lambda x: (x[1][0], x[0])):
        if re.search(LICENSE_FILE, path.split("/")[-1]):
            folders.setdefault(path.rpartition("/")[0], name)
    out = {}
    for path, _ in files:
        at, found = (path or "").rpartition("/")[0], None
        while path is not None and found is None:
            if at in folders:
                found = (at, folders[at])
            elif not at:
                break
            else:
                at = at.rpartition("/")[0]
        mine = own.get(path)
        out[path] = (mine and mine[1], found and found[1], found and found[0], mine[1] if mine else found and found[1])
    return out


def result(df):
    return {r.path: (r.own_license, r.inherited_license, r.inherited_from, r.license) for r in df.collect()}


def case():
    rng = random.Random(1)
    filler = "clip shot frame the is vmaf under rate of version".split()
    files = []
    for d in ["", "a/", "a/b/", "a/b/c/", "x/", "x/y/"]:
        for i in range(6):
            lines = [" ".join(rng.choice(filler) for _ in range(8)) for _ in range(3)]
            if rng.random() < 0.4:
                lines.insert(rng.randrange(4), rng.choice(list(TEMPLATES.values())) + rng.choice([".", "", " and more clip"]))
            files.append((f"{d}f{i}.srt", "\n".join(lines)))
    files += [("LICENSE", TEMPLATES["MIT"]), ("a/b/COPYING.txt", "text\n" + TEMPLATES["GPL-3.0"]), ("x/notice", "nothing"), ("x/README", None)]
    files += [("a/b/LICENSE", TEMPLATES["ISC"]), (None, TEMPLATES["ISC"]), ("x/y/empty", "")]
    return files


def test_equals_brute_force(spark):
    files = case()
    got = result(license_scan(spark.createDataFrame(files, "path string, content string").repartition(4)))
    assert got == brute(files)
    assert got["a/b/c/f0.srt"][2] == "a/b" and got["x/y/f1.srt"][2] == ""


def test_every_template_is_nearest_to_itself(spark):
    files = [(f"{i}.txt", f"some clip\n{t}\nshot") for i, t in enumerate(TEMPLATES.values())] + [(f"n{i}", "a b") for i in range(40)]
    got = result(license_scan(spark.createDataFrame(files, "path string, content string")))
    assert [got[f"{i}.txt"][0] for i in range(len(TEMPLATES))] == list(TEMPLATES)


def test_odd_input(spark):
    rows = [("LICENSE", TEMPLATES["MIT"]), ("d/x", None), ("d/x", None)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "path string, content string, license string, score int")
    got = sorted((r.path, r.license) for r in license_scan(df).collect())
    assert got == [("LICENSE", "MIT"), ("d/x", "MIT"), ("d/x", "MIT")]
    assert license_scan(df.where("false")).count() == 0


MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_real_licence_files_titles_and_tags(spark):
    held = "Copyright (c) 2016-2021, Jo Doe and others. All rights reserved.\n\n"
    want = {"mit/LICENSE": "MIT", "plain/LICENSE": None, "gpl/COPYING": "GPL-3.0"}
    files = [("mit/LICENSE", "The MIT License (MIT)\n\n" + held + MIT_BODY), ("plain/LICENSE", "clip shot frame rate\n" * 50)]
    files += [("gpl/COPYING", "   GNU GENERAL PUBLIC LICENSE\n     Version 3, 29 June 2007\n")]
    for name, text in full_texts().items():  # wrapped and owned in another way
        files.append((f"full/{name}/LICENSE.txt", held + " ".join(text.split())))
        want[f"full/{name}/LICENSE.txt"] = name
    lines = {
        "SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0",
        "# SPDX-License-Identifier: (BSD-2-Clause OR MIT)": "BSD-2-Clause", "SPDX-License-Identifier: Zlib": None,
        "MIT License": "MIT", "Apache License": "Apache-2.0", "Mozilla Public License Version 2.0": "MPL-2.0",
        "BSD 2-Clause License": "BSD-2-Clause", "BSD 3-Clause License": "BSD-3-Clause",
    }
    for i, (line, name) in enumerate(lines.items()):
        files.append((f"src/{i}.c", f"clip\n{line}\nshot"))
        want[f"src/{i}.c"] = name
    files += [(f"n/{i}", "the rate of a clip is under a version") for i in range(300)]
    got = result(license_scan(spark.createDataFrame(files, "path string, content string")))
    assert {path: got[path][0] for path in want} == want
