import re

import pytest

from verispark.llm import license_scan, queries
from verispark.llm.license_scan import parse

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    words = words_of(text)
    places = [(k, label) for p, label in PHRASES.items() for k in range(len(words)) if words[k : k + p.count(" ") + 1] == p.split()]
    at = [k for k, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))


def check(got, texts):
    assert sorted((r.doc_id is None, r.doc_id or 0, *map(repr, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))) for r in got) == sorted(
        (k is None, k or 0, *map(repr, brute(t))) for k, t in texts
    )
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(r.labels.split(",")))) and (r.score > 0 or not r.labels)


def test_op11_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.QUERIES["op11_license_scan"](spark, SF).collect()
    check(got, docs)
    assert any(r.n_base for r in got)


TEXTS = [
    None, "", "MIT License", "mit\n\nLICENSE, Apache-License apache license apache license", "submit license", "mit licenses", "CC BY-NC 4.0 cc.by cc by",
    "é mit license", "mité license", "GNU General Public GNU General Public License", "gnu lesser general public license apache license",
    "# SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause\nrest", "KK mit license İ", "mit license " * 30_000,
    "SPDX-License-Identifier: MIT " * 20_000, "SPDX-License-Identifier: " + "(" * 50_000 + "MIT", "SPDX-License-Identifier:" + " MIT OR" * 50_000, "\x00mit\x7flicense\x00",
]


def test_odd_texts(spark, odd_docs):
    rows = [(k, t, "x", 1) for k, t in enumerate(TEXTS)] + [(None, "apache license", "y", 2), (3, TEXTS[3], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, findings string, score int")
    scanned = license_scan.scan(df)
    check(license_scan.digest(scanned, "doc_id").collect(), [r[:2] for r in rows])
    check(license_scan.digest(license_scan.scan(odd_docs), "doc_id").collect(), [(r.doc_id, r.text) for r in odd_docs.collect()])
    by_id = {r.doc_id: r for r in license_scan.digest(scanned, "doc_id").collect()}
    assert by_id[11].labels == "bsd,gpl,mit" and by_id[11].duties == "notice" and by_id[11].score == 0.9
    assert by_id[6].labels == "cc-by,cc-by-nc" and by_id[10].labels == "apache,lgpl" and by_id[4].labels == ""
    assert license_scan.scan(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text, expression, labels, duties",
    [
        ("MIT", "MIT", ["mit"], "notice"),
        ("Apache-2.0 or GPL-2.0-or-later and MIT", "Apache-2.0 OR GPL-2.0-or-later AND MIT", ["apache", "gpl", "mit"], "notice"),
        ("(Apache-2.0 OR MIT) AND GPLv3", "(Apache-2.0 OR MIT) AND GPLv3", ["apache", "gpl", "mit"], "copyleft"),
        ("GPL-2.0-only WITH Classpath-exception-2.0 AND MIT", "GPL-2.0-only WITH Classpath-exception-2.0 AND MIT", ["gpl", "mit"], "weak copyleft"),
        ("LGPL-2.1+ OR MPL-2.0 */ more", "LGPL-2.1+ OR MPL-2.0", ["lgpl", "mpl"], "weak copyleft"),
        ("((MIT) OR CC-BY-NC-4.0", "((MIT) OR CC-BY-NC-4.0)", ["cc-by-nc", "mit"], "notice"),
        ("MIT AND (", "MIT", ["mit"], "notice"),
        ("MIT. And more", "MIT", ["mit"], "notice"),
        ("AGPL-3.0 OR LicenseRef-own\nMIT", "AGPL-3.0 OR LicenseRef-own", ["agpl", "licenseref-own"], "network copyleft"),
        ("MIT MIT", "MIT", ["mit"], "notice"),
        ("MIT) OR GPL-2.0", "MIT", ["mit"], "notice"),
        ("mitten", "mitten", ["mitten"], "unknown"),
    ],
)
def test_expressions(text, expression, labels, duties):
    found = parse(text.encode())
    assert (found.expression, found.labels, license_scan.DUTIES[found.duties]) == (expression, labels, duties)


def test_no_expression():
    assert all(parse(t.encode()) is None for t in ("", "OR MIT", ")", "(", "\nMIT", "*/"))
