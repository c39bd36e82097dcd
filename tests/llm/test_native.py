import re
from collections import Counter

import pytest

from defectlens.llm import license_scan, quality, url_filter

MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
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
SOFTWARE.
"""


def test_licences(table):
    texts = [
        MIT,
        "Some junk | more\nReleased under the MIT License.",
        "Licensed under CC BY-NC 4.0. This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: Apache-2.0",
        "See the GNU General Public License for more details.",
        "The license of this town is old.",
        "",
        None,
        "word " * 200_000 + "\nLicensed under the Apache License, Version 2.0.\n",
    ]
    docs = table([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.row.doc_id: (r.licences, r.n_sentences, r.n_unmatched) for r in license_scan.scan(docs).collect()}
    assert got == {
        0: (["MIT"], 4, 0),
        1: (["MIT"], 1, 0),
        2: (["CC-BY-NC-4.0", "GPL-3.0-only"], 2, 0),
        3: (["Apache-2.0"], 1, 0),
        4: ([], 1, 1),
        5: ([], 0, 0),
        6: ([], 0, 0),
        7: ([], 0, 0),
        8: (["Apache-2.0"], 1, 0),
    }
    assert license_scan.scan(docs.limit(0)).count() == 0


APACHE = """Copyright 2020 Somebody

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""


def test_apache_header(table):
    hashes = "\n".join(f"# {x}".rstrip() for x in APACHE.split("\n"))
    stars = "/*\n" + "\n".join(f" * {x}".rstrip() for x in APACHE.split("\n")) + "\n */\nint x;"
    texts = [APACHE, hashes, stars, APACHE.replace("\n\n    http", "\n    http"), APACHE.replace("2.0\n\nUnless", "2.0\nUnless"), APACHE.replace("\n\n", "\n").replace("Somebody\n", "Somebody\n\n")]
    texts += [t.replace("http:", "https:") for t in texts]
    docs = table(list(enumerate(texts)), "doc_id long, text string")
    got = {r.row.doc_id: (r.licences, r.n_unmatched) for r in license_scan.scan(docs).collect()}
    assert got == {i: (["Apache-2.0"], 0) for i in range(12)}


def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    fit = [(len(h) + len(p), v, len(h), h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[1] if best else "allow"


def test_urls(spark, table):
    rules = [
        ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
        ("b.example.org", "/", "block"), ("example.org", "", "allow"), ("EXAMPLE.org", "/ä", "block"), ("b.example.org", "/", "block"), ("tie.net", "/x", "allow"), ("tie.net", "/x", "block"),
    ]
    hosts = ["org", "example.org", "a.example.org", "b.example.org", "c.b.Example.ORG", "example-x.org", "xexample.org", "example.org.com", "tie.net", "a.tie.net", "net", "", ".org", "org."]
    paths = ["", "/", "/es/1", "/en/12?x=/de/", "/fr/#a", "/de/", "/ä", "/x", "?q=://a.org/", "#x"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "nothing", "://", "a://b://c.org/x", "http://" + "a." * 2000 + "org/" + "x" * 5000]
    urls += ["https://hot.example.org/es/1"] * 500
    pages = table(list(enumerate(urls)), "page_id long, url string")
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.row.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, frame).collect()}
    lower = [(h.lower(), p, v) for h, p, v in rules]
    assert got == {i: brute_url(u, lower) for i, u in enumerate(urls)}
    assert {r.verdict for r in url_filter.judge(pages, frame.limit(0)).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), frame).count() == 0


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


@pytest.fixture
def texts():
    return [
        None, "", " \n\t", "one two three four five", "a b c d e a b c d e", "a " * 50, "x\nx\n\nx \nx", "é ß 中 é ß 中 é ß 中 é ß 中", "a b c d e f g h i j k l m n o p",
        "\x0b\x0c a\u00a0b c", "# * $ % &|<> x", "long word " * 20_000 + "the end of it all",
    ]


def test_quality_measures(table, texts):
    docs = table([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.row.doc_id: tuple(r.m) for r in quality.measure(docs).collect()}
    assert got == {i: brute_quality(t) for i, t in enumerate(texts)}


def test_host_verdicts(table):
    fine = " ".join(f"word{i}" for i in range(30))
    rows = [(i, fine, "good") for i in range(40)] + [(100 + i, "short", "bad") for i in range(60)] + [(200 + i, fine, "bad") for i in range(3)]
    rows += [(300, "short", None), (301, fine, None), (301, fine, None), (302, fine, "new")]
    docs = table(rows, "doc_id long, text string, source string")
    judged = [(r.row.doc_id, r.base_failed, r.kept) for r in quality.judge(docs).collect()]
    assert len(judged) == len(rows)
    kept = {d for d, _, k in judged if k}
    assert kept == {*range(40), 301, 302}
    out = quality.filter_documents(docs)
    assert out.columns == docs.columns and out.count() == 43
    assert quality.judge(docs.limit(0)).count() == 0
