"""The pipeline's language stage keeps texts of the learnt languages, short, long and repetitive ones too, and rejects others."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from candor.llm import language_id
from candor.llm.common import held_out

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01/documents.parquet"
FOREIGN = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Jokainen on oikeutettu kaikkiin tässä julistuksessa esitettyihin oikeuksiin ja vapauksiin ilman minkäänlaista rotuun, väriin, sukupuoleen, kieleen tai uskontoon perustuvaa erotusta.",
    "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek. Mindenki, bármely megkülönböztetésre való tekintet nélkül, hivatkozhat a jelen nyilatkozatban kinyilvánított összes jogokra és szabadságokra.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek posiada wszystkie prawa i wolności zawarte w niniejszej deklaracji bez względu na różnice rasy, koloru, płci, języka i wyznania.",
]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(SF).select("doc_id", "text", "lang", "source", "n_chars")


def kept_of(spark, corpus, texts):
    """Which of the texts, put among the corpus, stay."""
    more = spark.createDataFrame([(10_000_000 + i, t, None, "x", len(t or "")) for i, t in enumerate(texts)], DOCS)
    out = language_id.accepted(corpus.unionByName(more)).where("doc_id >= 10000000").select("doc_id").collect()
    return {r["doc_id"] - 10_000_000 for r in out}


def test_random_letters_and_other_languages_go(spark, corpus):
    rng = random.Random(1)
    letters = ["abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz"]
    salad = [" ".join("".join(rng.choice(letters[i % 2]) for _ in range(rng.randint(2, 9))) for _ in range(rng.choice([40, 60, 200]))) for i in range(200)]
    assert kept_of(spark, corpus, [*salad, *FOREIGN, "", None, "123 456"]) == set()


def test_what_stays(spark, corpus):
    """Held-out texts, all but one in 500; single words, repeated words and capitals of the languages."""
    n = corpus.where("text is not null").where(held_out(4, 2)).count()
    kept = language_id.accepted(corpus).where(held_out(4, 2)).count()
    assert kept >= n - n // 500 - corpus.where(held_out(4, 2)).where(~F.col("text").rlike(r"\p{L}")).count()
    words = [r["text"] for r in corpus.where("lang = 'en' and n_chars > 200").limit(20).collect()]
    texts = [w.split()[0] for w in words] + ["and " * 3000, "The The The " * 500] + [" ".join(w.split()[:8]) for w in words] + [w.upper() for w in words] + [w * 30 for w in words]
    assert kept_of(spark, corpus, texts) == set(range(len(texts)))


def test_the_effective_number_of_trigrams():
    counts = np.ones((2, 3))
    typical = language_id.Typical(counts, np.array([1 * 6400 + 2 * 80 + 3, 2 * 6400 + 3 * 80 + 4, 3 * 6400 + 4 * 80 + 5]))
    n, means = typical.means(["abcde", "abc" * 4, None, ""])
    grams, owner, _ = language_id.trigrams(["abcde", "abc" * 4, "", ""])
    for i in range(2):
        own = grams[owner == i]
        c = np.unique(own, return_counts=True)[1]
        assert n[i] == pytest.approx(c.sum() ** 2 / (c**2).sum())
        assert means[i] == pytest.approx(typical.dots[own].mean(axis=0), abs=1e-4)
    assert n[2] == n[3] == 0


def test_predictions_equal_explicit_vectors(spark, corpus):
    """Each text's bundled vector and the prototypes' are made in full, and compared by cosine."""
    docs = corpus.where("doc_id < 120")
    train = docs.where(~held_out(4, 2)).where("text is not null and lang is not null").collect()
    langs = sorted({r["lang"] for r in train})
    bundle = lambda t: language_id.trigram_vectors(language_id.trigrams([t])[0]).sum(axis=0).astype(float)
    shares = []
    for lang in langs:
        grams = np.concatenate([language_id.trigrams([r["text"]])[0] for r in train if r["lang"] == lang])
        shares.append(np.bincount(grams, minlength=language_id.CUBE) / len(grams))
    shares = np.array(shares) - np.mean(shares, axis=0)
    known = np.flatnonzero(np.abs(shares).sum(axis=0))
    vectors = language_id.trigram_vectors(known)
    prototypes = shares[:, known] @ vectors
    prototypes /= np.linalg.norm(prototypes, axis=1, keepdims=True)
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    for r in docs.collect():
        if r["text"] and any(c.isalpha() for c in r["text"]):
            v = bundle(r["text"])
            grams = language_id.trigrams([r["text"]])[0]
            seen = np.isin(grams, known)
            v = language_id.trigram_vectors(grams[seen]).sum(axis=0).astype(float) if seen.any() else v
            cos = prototypes @ v
            best = np.sort(cos)
            assert got[r["doc_id"]]["lang_pred"] == langs[int(cos.argmax())] or best[-1] - best[-2] < 1e-3 * abs(best[-1])
        else:
            assert got[r["doc_id"]]["lang_pred"] == "und"
