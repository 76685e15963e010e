import re
from collections import Counter

from tabulant.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def brute(text):
    words = WORD.findall((text or "").translate(UPPER))
    places = []
    for label, _, phrase, base in licenses.TEMPLATES:
        p = phrase.split()
        places += [(i, label, base) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    base = [x for x in places if x[2]]
    starts = [x[0] for x in base]

    def joined(xs):
        return ",".join(sorted({x[1] for x in xs}))

    return len(words), len(base), min(starts, default=None), max(starts, default=None), joined(base), joined(places)


def test_report_equals_brute_force(sample, rows):
    got = licenses.license_report(licenses.scan_licenses(sample)).collect()
    want = Counter((k, *brute(t)) for k, t, _ in rows)
    assert Counter(tuple(r[:7]) for r in got) == want
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "") for r in got)


def test_every_template_finds_its_own_notice(spark):
    docs = spark.createDataFrame([(i, "x " + t[1].upper() + ", y") for i, t in enumerate(licenses.TEMPLATES)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.license_report(licenses.scan_licenses(docs)).collect()}
    for i, (label, *_) in enumerate(licenses.TEMPLATES):
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 1.0


def test_rare_words_are_the_anchors():
    idf = {"under": 1.0, "the": 0.5, "mit": 6.0, "license": 4.0}
    assert licenses._anchors("under the mit license".split(), idf, 2) == [("mit", 2), ("license", 3)]


def test_coverage_falls_without_the_notice(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT license"), (2, "under the MIT license")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in licenses.license_report(licenses.scan_licenses(docs)).collect()}
    assert got[1] == 1.0 and 0 < got[2] < 1


def test_empty_table(empty):
    assert licenses.license_report(licenses.scan_licenses(empty)).collect() == []
