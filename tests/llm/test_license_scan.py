import random
import re
import string

from regulith.llm import license_scan
from regulith.llm.license_scan import NOTICES, Notice
from regulith.llm.queries import op11_license_scan

from .helpers import rows, save

SCHEMA = "doc_id long, text string, lang string, source string, spans string, base int"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def apart(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
        last = row
    return last[-1]


def brute(text, notices=NOTICES):
    """n_words, base places as (first word, label), and for each notice the fewest edits of any run of whole words."""
    words, base, best = words_of(text), [], {}
    for n in notices:
        own = n.phrase.split()
        if n.base:
            base += [(i, n.label) for i in range(len(words)) if words[i : i + len(own)] == own]
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                run = " ".join(words[i:j])
                if len(run) > len(n.phrase) + n.edits:
                    break
                if abs(len(run) - len(n.phrase)) <= n.edits and (far := apart(run, n.phrase)) <= n.edits:
                    best[n] = min(best.get(n, far), far)
    score = max((1 - e / len(n.phrase) for n, e in best.items()), default=0.0)
    return (
        len(words), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None),
        ",".join(sorted({x for _, x in base})), ",".join(sorted({n.label for n in best})), round(score, 9),
    )


def damaged(rng, phrase, edits):
    text = list(phrase)
    for _ in range(edits):
        i = rng.randrange(len(text))
        kind = rng.choice("sid")
        text[i : i + (kind != "i")] = [] if kind == "d" else rng.choice(string.ascii_lowercase + " é")
    return "".join(text)


def documents(seed=5, n=150):
    rng, out = random.Random(seed), []
    noise = ["the", "license", "public", "gnu", "mit", "cc", "by", "apache", "été", "of", "General"]
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(4)):
            notice = rng.choice(NOTICES)
            text = damaged(rng, notice.phrase, rng.randrange(notice.edits + 3))
            parts += [*rng.choices(noise, k=rng.randrange(4)), rng.choice([text, text.upper(), text.replace(" ", ",\n-"), text.title()])]
        out.append((i, " ".join(parts), "en", "s", "x", 1))
    return out


EDGES = [None, "", " \n", "MIT LICENSE", "mit license mit license", "xmit license", "cc-by cc by-cc_by", "gnu gnu general public license license", "MIT license", "é mit licensé", "𝒳 apache licence 😀"]


def test_as_brute_force(spark, tmp_path):
    docs = documents() + [(1000 + i, x, None, None, "x", 1) for i, x in enumerate(EDGES)] + [(1, "cc by", "", "", "x", 1), (None, "cc by", "", "", "x", 1)]
    save(spark, tmp_path, "documents", docs, SCHEMA)
    got = op11_license_scan(spark, str(tmp_path))
    names = got.columns
    assert names == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    found = sorted(((*r[:-1], round(r[-1], 9)) for r in map(tuple, got.collect())), key=repr)
    expected = sorted(((d[0], *brute(d[1])) for d in docs), key=repr)
    assert found == expected
    assert any(x[-2] not in ("", x[-3]) for x in expected)


def test_spans_lie_in_the_text_and_differ_as_told(spark):
    docs = spark.createDataFrame(documents(6), SCHEMA)
    n = 0
    for r in license_scan.scan(docs, keep=("doc_id", "text")).collect():
        words = words_of(r.text)
        for s in r.spans:
            run = " ".join(words[s.first_word : s.last_word + 1])
            assert " ".join(words_of(r.text[s.start : s.end])) == run
            assert apart(run, s.phrase) <= s.edits == s.substituted + s.inserted + s.deleted
            n += 1
    assert n > 50


def test_long_texts_and_many_pieces(spark):
    text = "the license of the mit " * 20_000 + "gnu genral public licence " + "cc by " * 10_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = license_scan.report(license_scan.scan(docs)).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == (120_004, 10_000, 100_004, 120_002, "cc-by", "cc-by,gpl")


def test_notices_of_ones_own(spark):
    own = (Notice("own", "a b a", True), Notice("long", "an agreement of our own making"))
    docs = spark.createDataFrame([(1, "a b a b a"), (2, "an agrement of our own makking")], "doc_id long, text string")
    got = license_scan.report(license_scan.scan(docs, notices=own)).collect()
    assert [(r.n_base, r.labels) for r in got] == [(2, "own"), (0, "long")] and got[1].score == 1 - 2 / 30


def test_empty_table(spark, tmp_path):
    save(spark, tmp_path, "documents", [], SCHEMA)
    assert op11_license_scan(spark, str(tmp_path)).collect() == []
