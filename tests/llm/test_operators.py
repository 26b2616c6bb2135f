"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import itertools
import json
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from candor.llm import chat, decontamination, language_id, near_duplicates, neighbours, packing, sanitisation, substrings, suffix_arrays, toxicity
from candor.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "the lan gor mi ta zu ke or".split() for b in "a en ir os u".split()]


def docs(spark, texts, langs=None):
    rows = [(i, t, langs[i] if langs else "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


def clashing(df):
    """Columns of names that operators use themselves."""
    return df.withColumns({c: F.lit(1) for c in ("score", "rank", "spans", "sig", "ids", "n", "h", "key", "term", "_text", "_tk", "_v", "base", "actions", "layout", "turns", "fingerprint", "row", "said", "held_out", "node", "component", "id", "label", "t1", "it")})


@pytest.fixture(scope="module")
def mixed_texts():
    rng = random.Random(7)
    passage = prose(rng, 40)
    texts = [prose(rng, 120) for _ in range(12)]
    texts += [texts[0], texts[0], texts[1] + " tail", prose(rng, 30) + " " + passage + " " + prose(rng, 30), passage, "x " + passage + " " + passage]
    texts += [None, "", "  \n\t ", "one", "two words", "a b c", prose(rng, 6000), "ß é " * 60, texts[3].upper(), prose(rng, 19), "z" * 450, "z" * 199, "é" * 150]
    for _ in range(10):
        words = texts[2].split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        texts.append(" ".join(words))
    return texts


# 1 toxicity


def test_toxicity(spark):
    rng = random.Random(3)
    texts, labels = [], []
    for i in range(500):
        bad = i % 4 == 0
        w = [rng.choice(WORDS) for _ in range(40)]
        if bad:
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(40)] = rng.choice(["vilething", "grumbag" + rng.choice(["en", "os", "ir", "ul", "ax"])])
        texts.append(" ".join(w) + ".")
        labels.append((i, 1, int(bad)))
    texts += [None, "", "Grumbagnew, " + prose(rng, 5000)]
    d = docs(spark, texts)
    out = {r["doc_id"]: r for r in toxicity.detect(clashing(d), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(out) == len(texts)
    assert all(out[i]["predicted"] == int(i % 4 == 0) for i in range(500))
    assert out[500]["predicted"] == out[501]["predicted"] == 0 and out[502]["predicted"] == 1
    assert [(s["start"], s["end"]) for s in out[502]["spans"]] == [(0, 10)]
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out)
    for r in out.values():
        assert all(re.match("(?i)vile|grumb", texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["spans"])


def test_toxicity_without_labels(spark):
    d = docs(spark, ["a b", None]).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.detect(d, none).collect()] == [0.0, 0.0]
    assert toxicity.detect(d.limit(0), none).count() == 0


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    m = toxicity.Model(index={"=a": 0, "=b": 1}, emission=np.array([1.5, -0.5, -1.0]), transition=rng.normal(size=(2, 2)), start=rng.normal(size=2))
    n, at, ids = 7, [1, 2, 5], [[0], [0, 1], [1]]
    u = np.full(n, m.emission[-1])
    for t, x in zip(at, ids, strict=True):
        u[t] += sum(m.emission[i] for i in x)
    total, hit = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        p = np.exp(m.start[y[0]] + sum(u[t] * y[t] for t in range(n)) + sum(m.transition[a, b] for a, b in itertools.pairwise(y)))
        total += p
        hit += p * np.array(y)
    assert toxicity.marginals(m, n, at, ids) == pytest.approx((hit / total)[at])


def test_chain_marginals_over_long_gaps():
    """Against forward-backward over every token; a chain that remembers for hundreds of tokens."""
    m = toxicity.Model(index={"=a": 0, "=b": 1}, emission=np.array([3.0, -2.0, 0.0]), transition=np.array([[6.0, 0.0], [0.0, 6.0]]), start=np.array([0.3, -0.2]))
    for n, at, ids in ((1200, [5, 405, 410, 1100], [[0], [1], [0, 1], [0]]), (900, [0, 899], [[0], [1]])):
        u = np.zeros(n)
        for t, x in zip(at, ids, strict=True):
            u[t] = m.emission[x].sum()
        e, a = np.stack([np.ones(n), np.exp(u)], axis=1), np.exp(m.transition)
        f, b = np.zeros((n, 2)), np.ones((n, 2))
        for t in range(n):
            f[t] = (np.exp(m.start) if t == 0 else f[t - 1] @ a) * e[t]
            f[t] /= f[t].sum()
        for t in range(n - 2, -1, -1):
            b[t] = a @ (e[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        p = f * b / (f * b).sum(axis=1, keepdims=True)
        assert toxicity.marginals(m, n, at, ids) == pytest.approx(p[at, 1], abs=1e-9)


# 2 sanitisation


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(x):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(x)))) % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, rx) in enumerate(PATTERNS.items()):
        for m in re.finditer(rx, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(5)
    pieces = ["a@b.com", "_x@y.z", "a@b", "@", ".", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1111", "5500005555555559", "+49 (30) 123-4567", "+1 555", " ", "-", "x", "é", "  ", "12", "007.0.0.1", "😀", "+", "0" * 14, "79927398713", "\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(400)] + [None, "", "9 " * 3000, "a" * 20000 + "@", "a@b.c_d@e.f", "5 " * 20 + "4111111111111111"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", sanitisation.base_spans(F.coalesce("text", F.lit(""))).alias("s")).collect()
    for r in got:
        assert [(x["start"], x["kind"], x["end"]) for x in r["s"]] == plain_spans(texts[r["i"]]), texts[r["i"]]


def test_disclosing_terms(spark):
    rng = random.Random(2)
    texts = [f"{prose(rng, 8)} Zephyrina {w} bob@mail.org {prose(rng, 8)}" for w in WORDS[:6]] + [f"{prose(rng, 30)} other{i}@mail.org" for i in range(6)]
    texts += [prose(rng, 400) for _ in range(8)] + ["Only zephyrina here", None, ""]
    d = docs(spark, texts)
    found = {r["term"]: r["action"] for r in sanitisation.disclosing(d).collect()}
    assert "zephyrina" in found and not set(found) & set(WORDS)
    wide = sanitisation.sanitised(clashing(d))
    assert wide.dtypes == clashing(d).dtypes and {r["spans"] for r in wide.collect()} == {1}
    out = {r["doc_id"]: r for r in wide.collect()}
    assert "bob@" not in out[0]["text"] and "<EMAIL>" in out[0]["text"] and "Zephyrina" not in out[0]["text"]
    assert out[20]["text"].strip() in ("Only  here", "Only <TERM> here") and out[20]["n_chars"] == len(out[20]["text"])
    assert out[21]["text"] is None and out[22]["text"] == "" and out[12]["text"] == texts[12]
    one = sanitisation.find(clashing(d)).where("row.doc_id = 20").first()
    assert [(s["start"], s["end"], s["kind"]) for s in one["spans"]] == [(5, 14, 4)]
    unnamed = sanitisation.sanitised(d.withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted(str(r["text"]) for r in unnamed.collect()) == sorted(str(r["text"]) for r in out.values())
    assert sanitisation.sanitised(d.limit(0)).count() == 0 and sanitisation.find(d.limit(0)).count() == 0


def plain_terms(texts):
    """Disclosing terms and their bits, by counting in plain loops."""
    near, mentions, used, total = [], Counter(), Counter(), 0
    for t in texts:
        t = t or ""
        words = re.split(r"[^\w]|[\d_]", t.lower())
        used.update(words)
        total += len([x for x in re.split(r"(?:[^\w]|[\d_])+", t)])
        for lo, k, hi in plain_spans(t):
            e = f"{k}:{t[lo:hi].lower()}"
            mentions[e] += 1
            before, after = re.sub(r"^[^\W\d_]+", "", t[max(0, lo - 48) : lo]), re.sub(r"[^\W\d_]+$", "", t[hi : hi + 48])
            around = (before + " | " + after).lower()
            near += [(t, e, around, w) for w in {w for w in re.split(r"(?:[^\w]|[\d_])+", around) if len(w) >= 3}]
    found = {}
    for e, w in {(e, w) for _, e, _, w in near}:
        mine = [(t, a) for t, e2, a, w2 in near if (e2, w2) == (e, w)]
        c, n = len(mine), used[w]
        if len({a for _, a in mine}) >= 3 and c >= 0.5 * n:
            bits = np.log2(c * total / (n * mentions[e]))
            if bits >= 4:
                found[w] = max(found.get(w, 0), bits)
    return found


def test_disclosing_terms_equal_plain_counts(spark):
    rng = random.Random(13)
    people = [("Quinlan", "q@mail.org"), ("Ysolde", "+49 30 1234567"), ("Brannoch", "10.1.2.3"), ("Marrow", "q@mail.org")]
    texts = []
    for i in range(60):
        name, what = people[i % 4]
        texts.append(f"{prose(rng, rng.randint(5, 60))} {name if rng.random() < 0.8 else 'someone'} {rng.choice(WORDS)} {what} {prose(rng, 12)}")
        texts.append(f"{prose(rng, 300)} {'Marrow' if i % 3 == 0 else 'other'} {prose(rng, 9)}")
    texts += [texts[0], None, "", prose(rng, 20000)]
    want = plain_terms(texts)
    got = {r["term"]: (r["action"], r["bits"]) for r in sanitisation.disclosing(docs(spark, texts)).collect()}
    assert len(want) >= 3 and {t: b for t, (_, b) in got.items()} == pytest.approx(want)
    assert all(a == ("remove" if b >= 10 else "generalise") for a, b in got.values())


# 3 and 10 repeats


@pytest.mark.parametrize("shard", [4096, 3, 1])
def test_substrings(spark, mixed_texts, monkeypatch, shard):
    from candor.llm import repeats

    monkeypatch.setattr(repeats, "SHARD", shard)
    seen, want = set(), {}
    for i, t in enumerate(mixed_texts):
        w = re.findall(r"[^ \t-\r]+", t or "")
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(key)
        want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substrings.removed(clashing(docs(spark, mixed_texts))).collect()}
    assert got == want
    assert {r["doc_id"]: r["kept_sha256"] for r in substrings.digests(docs(spark, mixed_texts)).collect()} == {i: hashlib.sha256(x[2].encode()).hexdigest() for i, x in want.items()}


@pytest.mark.parametrize("shard", [4096, 3, 1])
def test_suffix_arrays(spark, mixed_texts, monkeypatch, shard):
    from candor.llm import repeats

    monkeypatch.setattr(repeats, "SHARD", shard)
    raws = [(t or "").encode() for t in mixed_texts]
    count = Counter(b[s : s + 200] for b in raws for s in range(len(b) - 199))
    want = {}
    for i, b in enumerate(raws):
        gone = bytearray(len(b))
        for s in range(len(b) - 199):
            if count[b[s : s + 200]] > 1:
                gone[s : s + 200] = b"\1" * 200
        want[i] = (len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), bytes(x for x, g in zip(b, gone, strict=True) if not g))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_arrays.removed(clashing(docs(spark, mixed_texts))).collect()}
    assert got == want


def test_repeats_of_very_long_words_and_periods(spark):
    """Thue-Morse words, which polynomial hashes modulo 2^64 can't tell apart, and texts of one period."""
    tm = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    other = tm.translate(str.maketrans("ab", "ba"))
    words = " ".join(f"w{i}" for i in range(12))
    d = docs(spark, [f"{words} {tm} {words}", f"{words} {other} {words}", "ab" * 400, "ab" * 150 + "c"])
    assert [r["n_removed"] for r in substrings.digests(d).orderBy("doc_id").collect()] == [0, 0, 0, 0]
    sets = near_duplicates.linked(docs(spark, [tm, other, tm]), 3, 85).orderBy("doc_id").collect()
    assert [r["component_id"] for r in sets] == [0, 1, 0]
    raws = [r["text"].encode() for r in d.orderBy("doc_id").collect()]
    count = Counter(b[s : s + 200] for b in raws for s in range(len(b) - 199))
    gone = [len({x for s in range(len(b) - 199) if count[b[s : s + 200]] > 1 for x in range(s, s + 200)}) for b in raws]
    assert [r["n_removed"] for r in suffix_arrays.digests(d).orderBy("doc_id").collect()] == gone


def test_neighbours_are_compared_symbol_by_symbol():
    rng = np.random.default_rng(3)
    for top, n in ((2, 60), (3, 200), (300, 200)):
        s = np.concatenate([rng.integers(1, top + 1, n), np.zeros(12, np.int64)])
        order = np.array(sorted(range(n), key=lambda i: s[i:].tolist()))
        need = rng.integers(0, 9, n)
        want = [need[i] == need[i + 1] and s[order[i] :][: need[i]].tolist() == s[order[i + 1] :][: need[i]].tolist() for i in range(n - 1)]
        assert suffix_arrays.neighbours_share(s, order, need).tolist() == want
    assert suffix_arrays.neighbours_share(s, order[:1], need[:1]).tolist() == [] and suffix_arrays.neighbours_share(s, order[:0], need[:0]).tolist() == []


def test_suffix_array_order():
    rng = np.random.default_rng(0)
    for _ in range(400):
        s = rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(0, 50)))
        assert suffix_arrays.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_automaton_statistics():
    rng = random.Random(1)
    for _ in range(100):
        refs = [[rng.randrange(3) for _ in range(rng.randint(0, 12))] for _ in range(4)]
        a = substrings.Automaton()
        for r in refs:
            a.add(r)
        x = [rng.randrange(3) for _ in range(12)]
        inside = lambda y: any(y == r[i : i + len(y)] for r in refs for i in range(len(r) - len(y) + 1))
        assert a.statistics(x) == [max(k for k in range(e + 2) if k == 0 or inside(x[e + 1 - k : e + 1])) for e in range(12)]


def test_repeated_rows_are_one_document(spark):
    rng = random.Random(4)
    t = prose(rng, 60)
    d = spark.createDataFrame([(1, t), (1, t), (2, prose(rng, 60)), (None, t[:30]), (3, None)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in substrings.digests(d).collect()) == [("1", 0), ("1", 0), ("2", 0), ("3", 0), ("None", 0)]
    assert {r["n_removed"] for r in suffix_arrays.digests(d).collect()} == {0}
    many = spark.createDataFrame([(None, f"{prose(rng, 3)} {t} {i}") for i in range(4)] + [(7, f"{t[:-20]} {prose(rng, 30)}"), (7, t)], "doc_id long, text string")
    assert sorted(r["n_removed"] > 0 for r in substrings.digests(many).collect()) == [False] + [True] * 5
    assert substrings.digests(d.limit(0)).count() == 0 and suffix_arrays.digests(d.limit(0)).count() == 0


# 4 neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(900, 8)).astype(np.float32)
    v[100:400] = v[7]  # a large group of equal vectors
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(900, None, 0), (901, [0.0] * 8, 0), (902, [float("nan")] * 8, 0), (903, [1.0], 0), (904, [None] * 8, 0), (905, [], 0), (None, v[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, block=64).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    x = v.astype(np.float64)
    hit = 0
    assert set(got) == set(range(0, 900, 20))
    for q, found in got.items():
        s = (x[q] * x).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(900), -s)) if i != q][:20]
        assert len(found) == 20 and all(abs(s[i] - y) < 1e-9 for i, y in found)
        assert found == sorted(found, key=lambda z: (-z[1], z[0]))
        hit += len(set(order) & {i for i, _ in found})
    assert hit / (20 * len(got)) >= 0.9
    few = neighbours.search(df.where("vec_id < 3"), F.lit(True))
    assert few.count() == 6 and neighbours.search(df.limit(0), F.lit(True)).count() == 0


def test_neighbours_of_tables_that_outgrow_the_blocks(spark):
    """Structureless vectors, 98 blocks on each curve: fixed blocks find under nine tenths."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6272, 32))
    x[::3] *= 2  # norms differ
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in neighbours.search(df, F.col("vec_id") % 100 == 0, curves=8, block=64).collect():
        got[r["query_id"]].add(r["vec_id"])
    hit = sum(len(got[q] & set([i for i in np.argsort(-(x @ x[q])) if i != q][:20])) for q in got)
    assert len(got) == 63 and hit / (20 * 63) >= 0.9


@pytest.mark.parametrize("slice_", [32_768, 50])
def test_slices_of_blocks_give_the_same(spark, monkeypatch, slice_):
    monkeypatch.setattr(neighbours, "SLICE", slice_)
    x = np.random.default_rng(3).normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in neighbours.search(df, F.lit(True), k=5).collect()}
    assert got == {(q, j + 1): i for q in range(300) for j, i in enumerate([i for i in np.argsort(-(x @ x[q])) if i != q][:5])}


def test_hilbert_is_a_walk_through_all_cells():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    keys = neighbours.hilbert(cells, 3)
    assert sorted(keys) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


# 5 decontamination


def test_decontamination(spark):
    rng = random.Random(9)
    items = [prose(rng, n) for n in (12, 20, 35, 60)] + ["too short item", None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    near = items[3].split()
    near[30] = "CHANGED"
    half = " ".join(items[2].split()[:12])
    texts = [prose(rng, 50) + " " + items[0] + " " + prose(rng, 50), items[1].upper(), "x " + " ".join(near), half + " " + prose(rng, 60), prose(rng, 200), None, "", "a b", items[0] + " " + items[1], "too short item", items[1] + " " + prose(rng, 4000)]
    out = {r["doc_id"]: r["items"] for r in decontamination.check(clashing(docs(spark, texts)), bench).collect()}
    assert out == {0: [0], 1: [1], 2: [3], 3: [], 4: [], 5: [], 6: [], 7: [], 8: [0, 1], 9: [4], 10: [1]}
    assert sorted(r["doc_id"] for r in decontamination.clean(docs(spark, texts), bench).collect()) == [3, 4, 5, 6, 7]
    odd = spark.createDataFrame([(None, items[0]), (7, items[1]), (7, items[2]), (8, "")], "item_id long, text string")
    unnamed = clashing(docs(spark, texts)).withColumns({"doc_id": F.lit(None).cast("long"), "t1": F.lit(1), "k": F.lit(2)})
    assert sorted(r["n_items"] for r in decontamination.check(unnamed, odd).collect() if r["contaminated"]) == [0, 1, 1, 1]
    kept = decontamination.clean(unnamed, odd)
    assert kept.columns == unnamed.columns and kept.count() == len(texts) - 4
    assert not any(r["contaminated"] for r in decontamination.check(docs(spark, texts), bench.limit(0)).collect())


def test_decontamination_of_reordered_items(spark):
    """Every window counts, wherever it begins: against the weighted similarity of all windows."""
    rng = random.Random(12)
    texts = [" ".join(f"{rng.choice(WORDS)}{rng.randrange(99)}" for _ in range(n)) for n in (60, 80, 44)]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    around = lambda t: f"{prose(rng, 70)} {t} {prose(rng, 70)}"
    halves = [(t.split()[: len(t.split()) // 2], t.split()[len(t.split()) // 2 :]) for t in texts]
    swapped = [around(" ".join([*b, *a])) for a, b in halves]
    put = [around(" ".join([*a, "new", "words", *b])) for a, b in halves]
    d = [*swapped, *put, " ".join([*halves[0][1], *halves[0][0]]), prose(rng, 300), around(" ".join(halves[0][0])), around(" ".join(halves[0][1] + texts[1].split()))]
    cut = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    want = {}
    for i, t in enumerate(d):
        for k, item in enumerate(texts):
            a, w = cut(item.split()), cut(t.split())
            for s in range(max(1, len(w) - len(a) + 1)):
                b = set(w[s : s + len(a)])
                if (j := len(set(a) & b) / len(set(a) | b)) >= 0.8 - 1e-9:
                    want[i, k, s] = j
    got = {(r["doc_id"], r["item_id"], r["start"]): r["similarity"] for r in decontamination.matches(docs(spark, d), bench).collect()}
    assert {x[:2] for x in want} == {(0, 0), (1, 1), (2, 2), (3, 0), (4, 1), (6, 0), (9, 1)}
    assert got == pytest.approx(want)


def test_blocks_find_all_within_the_radius(spark):
    rng = random.Random(0)
    pairs = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), decontamination.RADIUS):
            b ^= 1 << bit
        pairs.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(pairs, "a long, b long")
    shared = F.size(F.array_intersect(decontamination.blocks(F.col("a")), decontamination.blocks(F.col("b"))))
    assert df.where(shared == 0).count() == 0


# 6 near duplicates


def shingle_set(t, k):
    w = [x for x in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(texts, k, percent):
    sets = [shingle_set(t, k) for t in texts]
    label = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((label[i], label[j]))
            label = [x if z == y else z for z in label]
    return sets, label


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, mixed_texts, k, percent, monkeypatch):
    monkeypatch.setattr(near_duplicates, "CHUNK", 4)
    monkeypatch.setattr(near_duplicates, "REPS", (0,))
    sets, label = brute_components(mixed_texts, k, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.linked(clashing(docs(spark, mixed_texts)), k, percent).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, label, strict=True))}
    assert len(set(label)) < len(label) - 5


def test_a_large_group_of_near_copies(spark):
    """Thousands of texts a few words from one another, some of them under the threshold: as brute force says."""
    rng = random.Random(21)
    base = prose(rng, 60).split()
    texts = []
    for _ in range(3000):
        w = list(base)
        for _ in range(rng.choice([1, 1, 2, 2, 3, 4, 6])):
            w[rng.randrange(60)] = rng.choice(WORDS) + str(rng.randrange(9))
        texts.append(" ".join(w))
    sets = [shingle_set(t, 3) for t in texts]
    codes = {g: i for i, g in enumerate(sorted(set().union(*sets)))}
    has = np.zeros((3000, len(codes)), np.float32)
    for i, s in enumerate(sets):
        has[i, [codes[g] for g in s]] = 1
    both = has @ has.T
    n = has.sum(axis=1)
    near = 100 * both >= 85 * (n[:, None] + n - both) - 1e-3
    label = np.arange(3000)
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.linked(docs(spark, texts), 3, 85).collect()}
    assert len(set(label)) > 100 and [got[i] for i in range(3000)] == label.tolist()


def test_pairs_of_near_copies_just_apart(spark, monkeypatch):
    """Texts just under the threshold that share their changes with a few others: pairs do not grow with the square of the group."""
    rng = random.Random(4)
    base = [w + str(i % 7) for i, w in enumerate(prose(rng, 150).split())]
    other = [[f"{w}{j}x" for j in range(3)] for w in base]
    written = []
    staged = near_duplicates.staged

    def counted(df, what):
        out = staged(df, what)
        if what in ("rest", "crossing"):
            written.append(out.count())
        return out

    monkeypatch.setattr(near_duplicates, "staged", counted)
    texts = []
    for i in range(500):
        w = list(base)
        for j in rng.sample(range(150), rng.choice([0, 1, 2]) if i % 2 else rng.choice([5, 6, 7])):
            w[j] = rng.choice(other[j])
        texts.append(" ".join(w))
    _, label = brute_components(texts, 3, 85)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.linked(docs(spark, texts), 3, 85).collect()}
    assert got == dict(enumerate(label)) and len(set(label)) > 100
    assert sum(written) <= 2 * len(texts)


def test_one_of_each(spark):
    rng = random.Random(8)
    a, b = prose(rng, 50), prose(rng, 50)
    d = spark.createDataFrame([(3, a), (5, a), (3, a), (7, b), (None, a), (9, None), (9, None)], "doc_id long, text string")
    kept = sorted((str(r["doc_id"]), r["text"]) for r in near_duplicates.one_of_each(d).collect())
    assert kept == sorted([("3", a), ("7", b), ("None", a), ("9", None)], key=lambda x: (x[0], x[1] or ""))
    assert near_duplicates.one_of_each(d.limit(0)).count() == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys((100, 101, 102), 100)}


# 7 chat


def test_layouts(spark):
    records = [
        ({"prompt": "p", "completion": "c"}, "prompt", [("user", "p"), ("assistant", "c")]),
        ({"completion": None, "prompt": "p", "system": "s"}, "prompt", [("system", "s"), ("user", "p"), ("assistant", "")]),
        ({"instruction": "i", "input": "x", "output": "o"}, "instruction", [("user", "i\n\nx"), ("assistant", "o")]),
        ({"messages": [{"role": "human", "content": "a"}, {"role": "gpt", "content": "b"}]}, "messages", [("user", "a"), ("assistant", "b")]),
        ({"conversations": [{"from": "human", "value": "a"}], "id": 3}, "conversations", [("user", "a")]),
        ({"data": {"messages": [{"role": "user", "content": "q"}]}}, "nested", [("user", "q")]),
        ({"other": 1}, None, None),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, *_) in enumerate(records)] + [(7, "not json"), (8, None)], "i int, record string")
    got = {r["i"]: (r["layout"], r["turns"] and [tuple(t) for t in r["turns"]]) for r in chat.canonical(clashing(df), "record").select("row.i", "layout", "turns").collect()}
    assert got == {**{i: (n, t) for i, (_, n, t) in enumerate(records)}, 7: (None, None), 8: (None, None)}
    assert chat.canonical(clashing(df).limit(0), "record").count() == 0


def test_round_trip(spark):
    rng = random.Random(6)
    pieces = ["<|im_end|>", "<|im_start|>", "\n", "\\", "|", "<", "\\|", "<\\|", "assistant", "é😀", "<|nl|>", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "sys<|tem", "a\nb", None]), rng.choice([None, "".join(rng.choice(pieces) for _ in range(6))])) for c in range(60) for t in (2, 0, 1, 1, None)]
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in range(60):
        mine = sorted((r for r in rows if r[0] == c), key=key)
        assert [tuple(t) for t in out[c]["turns"]] == [(r[2] or "", r[3] or "") for r in mine]
        assert out[c]["loss_texts"] == [r[3] or "" for r in mine if r[2] == "assistant"]
        assert out[c]["formatted"].count(chat.START) == len(mine)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_turns(none)).count() == 0
    long = "<|im_end|>x" * 40_000
    one = chat.read_back(chat.format_turns(clashing(spark.createDataFrame([(None, 1, "assistant", long)], "conv_id long, turn long, role string, text string")))).first()
    assert one["loss_texts"] == [long] and one["turns"][0]["text"] == long


# 8 packing


def test_encoder_equals_the_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    e = packing.Encoder(path)
    rng = random.Random(1)
    pieces = [*"abcde XYZ \n\t.,!?<>|1234é̀üßñΣσİıﬁǺ中अ²½😀-_\x00\x1c\xa0\x85", "'s", "'ll", "the", "running", "<|endoftext|>", "n't"]
    for _ in range(3000):
        s = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert e.ids(s).tolist() == e.tokenizer.encode(s, add_special_tokens=False).ids, s


def test_packing(spark, mixed_texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    e = packing.Encoder(path)
    window = 256
    want = {i: [*e.ids(t or "").tolist(), 1] for i, t in enumerate(mixed_texts)}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(clashing(docs(spark, mixed_texts)), path, window).collect():
        assert r["ids"] == want[r["doc_id"]][r["start"] : r["start"] + r["length"]] and r["doc_tokens"] == len(want[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(array("I", r["ids"]).tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, ids in want.items():
        at = 0
        for start, n in sorted(pieces[i]):
            assert start == at and n > 0
            at += n
        assert at == len(ids)
    sizes = []
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        sizes.append(at)
    assert max(sizes) <= window and sum(x < window for x in sizes) <= 1
    assert packing.pack(docs(spark, mixed_texts).limit(0), path, window).count() == 0


def test_neighbours_of_a_seed_come_first():
    texts = [np.array(x) for x in ([1, 2, 3, 4], [9, 9, 9, 8], [1, 2, 3, 5], [7, 7, 6, 6])]
    windows = packing.fill(texts, 8)
    assert [p[0] for p in windows[0]] == [0, 2] and sum(n for w in windows for *_, n in w) == 16


# 9 language identification


def test_language_identification(spark):
    rng = random.Random(2)
    kinds = {"xx": "arr obo uku tat".split(), "yy": "gli shre ewe nnd".split(), "zz": "жук мир дом лес".split()}
    texts, langs = [], []
    for i in range(240):
        lang = ["xx", "yy", "zz"][i % 3]
        texts.append(" ".join("".join(rng.choice(kinds[lang]) for _ in range(2)) for _ in range(rng.randint(5, 40))))
        langs.append(None if i % 17 == 0 else lang)
    texts += [None, "", "123 !?", "arrobo " * 9000]
    langs += ["xx", "xx", "yy", "xx"]
    out = {r["doc_id"]: r for r in language_id.identify(clashing(docs(spark, texts, langs))).collect()}
    assert len(out) == 244 and all(out[i]["lang_pred"] == ["xx", "yy", "zz"][i % 3] for i in range(240))
    assert [out[i]["lang_pred"] for i in range(240, 244)] == ["und", "und", "und", "xx"] and out[240]["score"] == 0
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    kept = language_id.accepted(docs(spark, texts, langs))
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ") and kept.count() == 241
    foreign = docs(spark, [*texts, "λόγος ἦν πρὸς τὸν θεόν"], [*langs, None])
    wide = language_id.accepted(clashing(foreign))
    assert wide.columns == clashing(foreign).columns and wide.count() == 241
    unnamed = language_id.identify(docs(spark, texts, langs).withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted(r["lang_pred"] for r in unnamed.collect()) == sorted(r["lang_pred"] for r in out.values())
    assert {r["lang_pred"] for r in language_id.identify(docs(spark, texts[:3], [None] * 3)).collect()} == {"und"}
    assert language_id.identify(docs(spark, texts, langs).limit(0)).count() == 0


def test_table_of_dots_equals_the_vectors():
    grams = np.array([5, 700, 90_000, 400_000])
    counts = np.array([[3, 0, 2, 1], [0, 4, 1, 0]])
    dots = language_id.prototypes(counts, grams)
    v = language_id.trigram_vectors(grams)
    share = counts / counts.sum(axis=1, keepdims=True)
    p = (share - share.mean(axis=0)) @ v
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    assert dots[grams] == pytest.approx(v @ p.T, abs=1e-3)
