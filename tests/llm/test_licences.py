import math
import re
from collections import Counter

from lectern.llm import licences as L
from lectern.llm import queries as Q


def brute(files):
    """files: (key, path, text) -> own licence by key and the inherited one."""
    n, df = len(files), Counter()
    for _, _, t in files:
        df.update(set(L.terms(t or "")))
    weight = lambda t: L.idf(n, df[t] if t in vocabulary else 1)
    vocabulary = {t for _, x in L.TEMPLATES for t in L.terms(x)}

    def vector(text):
        v = {t: (1 + math.log(c)) * weight(t) for t, c in Counter(L.terms(text)).items()}
        norm = math.sqrt(sum(w * w for w in v.values())) or 1
        return {t: w / norm for t, w in v.items()}

    templates = [(name, vector(x), L.terms(x)) for name, x in L.TEMPLATES]
    own = {}
    for k, path, text in files:
        name = (path or "").rsplit("/", 1)[-1]
        units = (text or "").split("\n") + ([text or ""] if re.match(L.LICENCE_FILE, name) else [])
        best = None
        for u in units:
            v = vector(u)
            for lic, t, words in templates:
                c = sum(w * t.get(x, 0) for x, w in v.items())
                if c >= L.LEAST and all(x in v for x in words if x.isdigit()) and not any(x in v for x in L.QUALIFIERS if x not in words):
                    best = min(best or (True, 0, 0, "~"), (lic == L.GENERIC, -math.floor(c * 1000 + 0.5), -len(words), lic))
        own[k] = best and (best[1], best[3])
    dirs = {}
    for k, path, _ in files:
        if path is not None and own[k] and re.match(L.LICENCE_FILE, path.rsplit("/", 1)[-1]):
            d = path.rsplit("/", 1)[0] if "/" in path else ""
            dirs[d] = min(dirs.get(d, (0, "~")), own[k])
    out = {}
    for k, path, _ in files:
        got = None
        if own[k] is None and path is not None:
            parts = path.split("/")[:-1]
            for m in range(len(parts), -1, -1):
                d = "/".join(parts[:m])
                if d in dirs:
                    got = (d, dirs[d][1])
                    break
        out[k] = (own[k][1] if own[k] else None, *(got or (None, None)))
    return out


FILES = [
    (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "code\nof nothing"), (3, "a/b/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
    (4, "a/b/COPYING.txt", "This work is licensed under the GNU General\nPublic License, version 3."), (5, "z/q.py", "Nothing at all"), (6, "LICENCE.md", "All rights reserved."), (7, "z/w/e/r.py", None),
    (8, None, "Released under the MIT License."), (9, None, ""), (10, "top.py", "the under this work is version"), (11, "a/b/c/d/e.txt", "License license license text of another kind entirely, long enough to differ\n" * 40),
    (12, "m/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"), (13, "m/n/o.c", "int main"), (14, "a/LICENSE-2", "Licensed under CC BY-NC 4.0."),
]


def test_against_brute_force(spark):
    df = spark.createDataFrame(FILES, "key long, path string, text string").selectExpr("*", "'x' AS licence", "1 AS n")
    got = {r.key: (r.own_licence, r.inherited_from, r.inherited_licence) for r in L.scan_licences(df, key="key").collect()}
    assert got == brute(FILES)
    assert got[2] == (None, "a/b", "GPL-3.0") and got[7] == (None, "", "proprietary")


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(FILES, "key long, path string, text string").select("key", "path", "text")
    plan = L.scan_licences(df, key="key")._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_repeated_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a/x", "All rights reserved."), (1, "a/x", "All rights reserved."), (None, "a/y", "z")], "key long, path string, text string")
    got = L.scan_licences(df, key="key").collect()
    assert sorted([(r.key, r.licence) for r in got], key=repr) == [(1, "proprietary"), (1, "proprietary"), (None, None)]
    # rows that share a key, or have none, keep their own licences
    mixed = [(1, "a/x", "All rights reserved."), (1, "b/x", "Released under the MIT License."), (1, "c/x", "plain"), (None, "d/x", "Licensed under CC BY-NC 4.0."), (None, "e/x", None), (None, None, "plain")]
    got = L.scan_licences(spark.createDataFrame(mixed, "key long, path string, text string"), key="key").collect()
    assert sorted([(r.key, r.path, r.licence) for r in got], key=repr) == sorted([(1, "a/x", "proprietary"), (1, "b/x", "MIT"), (1, "c/x", None), (None, "d/x", "CC-BY-NC-4.0"), (None, "e/x", None), (None, None, None)], key=repr)
    assert L.scan_licences(df.limit(0), key="key").collect() == []


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""


def test_wrapped_headers_and_whole_licence_files(spark):
    comment = lambda mark, text: "\n".join(mark + x for x in text.split("\n")) + "\n\nint main;\n"
    narrow = "\n".join(["/*", *[f" * {' '.join(GPL.split()[k:k + 4])}" for k in range(0, 80, 4)], " */"])
    cases = {
        "MIT": [comment("// ", MIT), comment("dnl ", MIT), "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + MIT, "Copyright (c) 2020 A. Person. " + MIT.replace("\n", " "), "Some words.\r\nReleased under\r\nthe MIT License."],
        "BSD-3-Clause": [comment("# ", BSD), "Copyright (c) 2020, A. Person\nAll rights reserved.\n\n" + BSD, BSD.replace("\n", " ")],
        "GPL-3.0": [comment(" * ", GPL), narrow, "Words of a preamble, and more of them.\n" * 300 + GPL, "# This work is licensed under the GNU\n# General Public License, version 3."],
        # another version or kind is another licence
        "GPL-2.0": [GPL.replace("version 3", "version 2"), "This work is licensed under the GNU General Public License, version 2."],
        "LGPL-3.0": [GPL.replace("GNU General", "GNU Lesser General").replace("program", "library")],
        "LGPL-2.1": ["This library is licensed under the GNU Lesser General Public License, version 2.1."],
        "AGPL-3.0": [GPL.replace("GNU General", "GNU Affero General")],
        "BSD-2-Clause": [BSD[: BSD.index("3. Neither")] + BSD[BSD.index("THIS SOFT") :]],
        "ISC": [ISC, comment("; ", ISC)],
        "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License."],
        "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
        "CC-BY-SA-3.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."],
        # which no template announces
        None: [GPL.replace("version 3", "version 7"), "This work is licensed under a Creative Commons Attribution-ShareAlike 2.0 License.", "the terms of the GNU General Public License as published by others"],
    }
    names = lambda k: ("LICENSE", "x.c") if k else ("x.c",)
    want = {(f"{k}-{j}-{name}", k) for k, texts in cases.items() for j in range(len(texts)) for name in names(k)}
    plain = [(f"plain-{k}", f"p/{k}.txt", f"Common words of number {k} and the use of this and that.") for k in range(200)]
    rows = [(f"{k}-{j}-{name}", f"{k}/{j}/{name}", text) for k, texts in cases.items() for j, text in enumerate(texts) for name in names(k)]
    got = L.scan_licences(spark.createDataFrame(rows + plain, "key string, path string, text string"), key="key").collect()
    assert {(r.key, r.own_licence) for r in got if not r.key.startswith("plain")} == want
    assert all(r.licence is None for r in got if r.key.startswith("plain"))


def test_long_licences_are_licence_files(spark, tmp_path):
    prose = "Words of a report on roads and rivers, which are many.\n" * 30
    texts = {1: MIT, 2: "Nothing to see.", 1001: BSD, 1002: prose, 2001: prose + "Released under the MIT License.", 2002: prose}
    rows = [(k, t, "en", "web", len(t)) for k, t in texts.items()] + [(3001, None, "en", "web", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.path.rsplit("/", 1)[1], r.own_licence, r.inherited_licence) for r in Q.op10_licence_scans(spark, str(tmp_path)).collect()}
    assert got == {
        1: ("LICENSE-1", "MIT", None), 2: ("2.txt", None, "MIT"), 1001: ("LICENSE-1001", "BSD-3-Clause", None), 1002: ("1002.txt", None, "BSD-3-Clause"),
        2001: ("2001.txt", "MIT", None), 2002: ("2002.txt", None, None), 3001: ("3001.txt", None, None),
    }


def test_very_long_text(spark):
    text = "Words of a report on roads and rivers, which are many.\n" * 200_000 + "Released under\nthe MIT License.\n"
    (row,) = L.scan_licences(spark.createDataFrame([(1, "a/x.txt", text)], "key long, path string, text string"), key="key").collect()
    assert len(text) > 10_000_000 and row.licence == "MIT"


NAMED = BSD.replace("the copyright holder nor the names of its", "Google Inc. nor the names of its")
X11 = MIT + "\n\nExcept as contained in this notice, the name of the X Consortium shall not\nbe used in advertising or otherwise to promote the sale, use or other dealings\nin this Software without prior written authorization from the X Consortium."
ZLIB = "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software."
BOOST = "Permission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation covered by\nthis license (the \"Software\") to use, reproduce, display, distribute."


def test_statements_within_lines_and_what_tells_more(spark):
    """Short statements inside lines, named holders, variants, tags and titles."""
    prose = "We meet here every day, and all are welcome. "
    cases = {
        "MIT": [prose + "Released under the MIT License. The tool is old.", "Released under the MIT License. " + prose * 20, "/* Released under the MIT License. */ int x;", prose + "Released under\nthe MIT License.", "MIT License\n\nCopyright (c) 2020 A. Person", "# The MIT License (MIT)\ncode", "// SPDX-License-Identifier: MIT\nint main;", "All rights reserved.\n" + MIT],
        "Apache-2.0": [prose + "Licensed under the Apache License, Version 2.0. " + prose, "# SPDX-License-Identifier: Apache-2.0"],
        "GPL-2.0": ["/* SPDX-License-Identifier: GPL-2.0-only */", "SPDX-License-Identifier: GPL-2.0+\nReleased under the MIT License."],
        "BSD-3-Clause": [NAMED, NAMED.replace("\n", " "), "All rights reserved.\n" + NAMED.replace("Google Inc.", "the University"), "BSD 3-Clause License"],
        "X11": [X11], "Zlib": [ZLIB, "All rights reserved. " + ZLIB.replace("\n", " ")], "BSL-1.0": [BOOST, "Distributed under the Boost Software License, Version 1.0."],
        "proprietary": [prose + "All rights reserved. " + prose],
        None: ["SPDX-License-Identifier: Nobody-1.0", "The MIT people license nothing.", "MIT License holders met."],
    }
    plain = [(f"plain-{k}", f"p/{k}.txt", f"Common words of number {k} and the use of this and that.") for k in range(200)]
    rows = [(f"{k}-{j}", f"{k}/{j}/x.c", text) for k, texts in cases.items() for j, text in enumerate(texts)]
    got = {r.key: r.own_licence for r in L.scan_licences(spark.createDataFrame(rows + plain, "key string, path string, text string"), key="key").collect()}
    assert {k: v for k, v in got.items() if not k.startswith("plain")} == {f"{k}-{j}": k for k, texts in cases.items() for j in range(len(texts))}
    assert all(v is None for k, v in got.items() if k.startswith("plain"))
