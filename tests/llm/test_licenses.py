"""License scans: phrases against a scanner, notices as planted, edited, cut, shuffled and overlapping."""

import random
import re

import pytest

from candor.llm import licenses
from candor.llm.queries import op12_license_scans

DOCS = "doc_id long, text string, lang string, h long, template int, spans string, votes int"
LOWER = {i: i + 32 for i in range(65, 91)}
FILL = "lorem ipsum dolor sit amet under the license permission version of software and any 2".split()


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def base(text):
    """(label, first word) of each phrase."""
    w = words_of(text)
    return sorted((i, label) for label, p in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


def fill(rng, n):
    return " ".join(rng.choice(FILL) for _ in range(n))


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", 1, 2, "x", 3) for i, t in enumerate(texts)], DOCS).repartition(4)


def notice(label, nth=0):
    return [t for x, t in licenses.NOTICES if x == label][nth]


def edited(rng, text, share):
    """Words replaced, dropped or doubled here and there."""
    out, words = [], text.split()
    for w in words:
        x = rng.random()
        out += [rng.choice(FILL)] if x < share / 3 else [] if x < share * 2 / 3 else [w, w] if x < share else [w]
    return " ".join(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    out = [fill(rng, 30) + " " + rng.choice(["Under THE MIT-License", "apache license, version 2.0", "CC BY-NC 4.0", "under the mit licence", "cc by", "é-cc by nc"]) + "\n" + fill(rng, 20) for _ in range(60)]
    out += [None, "", " .,-", "mit", "under the mit license", "cc by nc cc by nc by nc", "CC BY NC " * 400, "ccby nc", "Ünder the mit license", "underthe mit license", fill(rng, 30_000) + " cc by nc"]
    return out + [out[0]] * 30


def test_phrases_equal_a_scanner(spark, texts):
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i]["n_words"] == len(words_of(t))
        assert [(s["start"], s["label"]) for s in got[i]["spans"] if s["exact"]] == base(t)


def test_query_columns(spark, texts, tmp_path):
    frame(spark, texts).drop("h").write.parquet(str(tmp_path / "documents.parquet"))
    got = op12_license_scans(spark, str(tmp_path)).collect()
    for r in got:
        found = base(texts[r["doc_id"]])
        assert (r["n_base"], r["first_word"], r["last_word"]) == (len(found), found[0][0] if found else None, found[-1][0] if found else None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in found})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] == 1 or not found)


def test_notices_with_edits(spark):
    rng = random.Random(8)
    planted = [(label, k) for label, t in licenses.NOTICES if len(t.split()) > 15 for k in range(12)]
    out = [fill(rng, 50) + " " + edited(rng, notice(label), 0.06) + " " + fill(rng, 50) for label, _ in planted]
    got = {r["doc_id"]: {s["label"] for s in r["spans"]} for r in licenses.scan(frame(spark, out)).collect()}
    right = [got[i] == {label} or got[i] - {"apache-2"} == {label} for i, (label, _) in enumerate(planted)]
    assert sum(right) >= 0.95 * len(right)


def test_the_best_of_similar_licenses(spark):
    out = [notice("gpl-2"), notice("gpl-3"), notice("agpl-3"), notice("cc-by"), notice("cc-by-sa"), notice("cc-by-nc"), notice("gpl-3", 1)]
    got = {r["doc_id"]: r["spans"] for r in licenses.scan(frame(spark, out)).collect()}
    assert [[s["label"] for s in got[i]] for i in range(len(out))] == [["gpl-2"], ["gpl-3"], ["agpl-3"], ["cc-by"], ["cc-by-sa"], ["cc-by-nc"], ["gpl-3"]]
    assert all(s["score"] == 1.0 and (s["start"], s["end"]) == (0, len(words_of(out[i]))) for i in got for s in got[i])


def test_parts_and_shuffled_words_are_no_notices(spark):
    rng = random.Random(3)
    words = [notice(label).split() for label, _ in licenses.NOTICES if len(notice(label).split()) > 15]
    out = [" ".join(w[: len(w) // 2]) for w in words] + [" ".join(rng.sample(w, len(w))) for w in words] + [fill(rng, 400) for _ in range(20)]
    got = licenses.scan(frame(spark, out)).collect()
    assert not [s for r in got for s in r["spans"] if not s["exact"]]


def test_two_notices_in_one_text_and_repeats(spark):
    rng = random.Random(5)
    gap = " " + fill(rng, 15) + " "
    out = [gap.join([notice("mit"), notice("bsd"), notice("mit")])]
    spans = licenses.scan(frame(spark, out)).first()["spans"]
    assert [s["label"] for s in spans] == ["mit", "bsd", "mit"]
    w = words_of(out[0])
    assert all(w[s["start"] : s["end"]] == words_of(notice(s["label"])) for s in spans)


def test_shuffled_joins_and_null_ids(spark, texts, monkeypatch):
    df = frame(spark, texts).selectExpr("if(doc_id % 3 = 0, null, doc_id) AS doc_id", "text")
    one = sorted(map(str, licenses.scan(df).collect()))
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 0)
    assert sorted(map(str, licenses.scan(df).collect())) == one and len(one) == len(texts)


def test_empty_table_and_short_templates(spark):
    assert licenses.scan(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        licenses.templates(phrases=[("x", "two words")])


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 8))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        same, first, last = licenses.aligned(a, b)
        assert same == table[-1][-1] and 0 <= first <= last <= len(b) and (not same or (b[first] in a and b[last - 1] in a))
