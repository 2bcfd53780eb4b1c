"""Searching the folded text: the same matches as ignoring case in the text, and few texts to look for."""

from pyspark.sql import functions as F

from regulith.functions import rules, rx
from regulith.operators import scan, sections

TEXTS = (
    "ORIGINAL SIGNATURE İn writing, ın WRITING, Kept; ſhall be ſigned by; Notariſed. 12 DAYS Before; ٣ days after; Fee of $3 ΣΑΣ",
    "Approval of the board and, the Agency; as the officer Deems Necessary; AT LEAST 3 weeks\x85not fewer than 9; by Registered Mail; in‐person in-PERSON",
    "SECTION 1.a-b x\nSEC. 2 y § 3\nArtIcle xiv, CHAPTER 9 ch. 10.2 Part b part 7 \U0001f600 ſection 4 artıcle 5",
    "",
)


def test_folded_text_has_the_same_matches(spark):
    patterns = [r.pattern for r in scan.CATALOG] + list(rules.SECTION_MARKERS)
    both = [F.regexp_count("t", F.lit(rx.fold(p))) for p in patterns] + [F.regexp_count(rx.folded(F.col("t")), F.lit(rx.lowered(p))) for p in patterns]
    for row in spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", F.length(rx.folded(F.col("t"))), *both).collect():
        assert len(row[0]) == row[1] and list(row[2 : 2 + len(patterns)]) == list(row[2 + len(patterns) :])


def test_markers_keep_the_case_of_the_text(spark):
    got = spark.createDataFrame([(TEXTS[2],)], "t string").select(sections.markers(F.col("t")).alias("m"), sections.section_count(F.col("t")).alias("n")).first()
    assert [(TEXTS[2][m.start : m.start + len(m.header)], m.header.endswith(m.id)) for m in got.m] == [(m.header, True) for m in got.m]
    assert [m.id for m in got.m] == ["1.a-b", "2", "3", "xiv", "9", "10.2", "b", "7", "4", "5"] and got.n == 10


def test_needed_texts_and_their_roots():
    assert rx.needed_any(r"(?:at least |up to )\d+ (?:day)s") == ["at least ", "up to "] and rx.needed_any("a(?:long word)?b|c") == [""]
    assert rx.lowered(r"Sec\S\.[A-Z]") == r"(?dU)sec\S\.[a-z]"
    roots = rx.roots(sorted({x for r in scan.CATALOG for x in rx.needed_any(r.pattern)}))
    assert all(root in x for x, root in roots.items()) and len(set(roots.values())) < len(scan.CATALOG) / 2
