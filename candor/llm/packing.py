"""Packing documents into token windows, with neighbours found by BM25.

Each text is turned into token ids, with an end id after them. Whole windows of a document stand alone; what is left of it
(less than a window) is packed. How many left-overs have each term, and their mean length, are counted over the whole corpus.
Left-overs are range-partitioned by a lexical key (their two rarest terms by the vocabulary's order, in which terms that were merged
late come last; then a hash of doc_id, so that equal keys split) and cut into shards of SHARD documents. Each shard has an
inverted index with BM25 weights by the corpus's counts: the next unused left-over is the seed, the index returns its unused
neighbours by the seed's most telling terms, and they fill the seed's window, best first, as they fit; the best one that doesn't fit
is cut so that the window is full, and its rest goes back to the shard. Only a shard's last window can be short.

Ids are written in 16 bits where the vocabulary allows.

Cases: null and empty texts are the end id alone; every row is packed, also rows that repeat a doc_id; a null doc_id stays
null; ties in score go to the earlier left-over; an empty table gives no pieces; other columns are left aside.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm.common import small_batches, staged

WINDOW = 2048
END_ID = 1
#: Documents of one index, and terms of a query.
SHARD, TERMS = 2048, 32
K1, B = 1.2, 0.75
# How the vocabulary's pre-tokenizer splits, as its file has it and as it is matched here.
_SPLIT_SPEC = r"[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
# End of fixed values.
#: What ends words, in ASCII, and the characters above ASCII that are letters of one byte in Latin-1.
STOPS, DIGITS, SPACES = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", "0123456789", "\t\n\x0b\x0c\r "
PLAIN = bytes([*range(9, 14), *range(32, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])


def _marked(text: str) -> str | None:
    """text with a zero byte after each word, by plain replacements; null if it has runs of stops, apostrophes, or characters
    other than letters of Western Europe, digits, stops and white space, for which the pattern is needed. Doubled marks
    mean nothing."""
    if "'" in text:
        return None
    try:
        if text.encode("latin-1").translate(None, PLAIN):
            return None
    except UnicodeEncodeError:
        return None
    for c in STOPS:
        text = text.replace(c, f"\0{c}\0")
    if "\0\0" in text:
        return None
    for c in DIGITS:
        text = text.replace(c, f"\0{c}\0")
    for c in SPACES:
        text = text.replace(c, "\0")
    return text + "\0"


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Token ids of texts, as the tokenizer's file defines them. Byte-pair vocabularies with word ends are run on
    tiktoken's merges, several times as fast: the end of a word is written as a zero byte, whose joins with the byte before it rank
    first. Other kinds, and texts with a zero byte, go through the tokenizer itself; both give the same ids."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = self._merges(spec["model"]) if spec["model"].get("end_of_word_suffix") == "</w>" and _SPLIT_SPEC in str(spec.get("pre_tokenizer")) else None

    def _merges(self, model: dict):
        import tiktoken

        letters = _byte_letters()
        raw = lambda t: bytes(letters[c] for c in t.removesuffix("</w>")) + b"\0" * t.endswith("</w>")
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        order = [*letters, *(c + "</w>" for c in letters if letters[c]), *merged]
        ranks: dict[bytes, int] = {}
        self.id_of = np.zeros(len(order) + 1, self.kind)
        for t in order:
            if ranks.setdefault(raw(t), len(ranks)) == len(ranks) - 1:
                self.id_of[len(ranks) - 1] = model["vocab"][t]
        return tiktoken.Encoding("packing", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.merges is None or "\0" in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)
        if text.isascii():
            text = text.lower()
        else:
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
        marked = _marked(text)
        if marked is None:
            marked = "".join([w + "\0" for w in WORDS.findall(text)])
        return self.id_of[self.merges.encode_to_numpy(marked)]


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _rarest(ids: np.ndarray) -> int:
    """The two last terms in the vocabulary's order, as one number."""
    last = int(ids.max())
    rest = ids[ids < last]
    return last << 32 | (int(rest.max()) if len(rest) else last)


def document_counts(rows: DataFrame, kind: np.dtype) -> tuple[np.ndarray, int, float]:
    """Of the left-overs: how many have each term (by id), their number, and their mean length. What reaches the driver is a row
    per term of the vocabulary."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)
        docs = units = 0
        for batch in batches:
            texts = [np.frombuffer(x.as_buffer(), kind) for x in batch.column("rest")]
            if texts:
                owner = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
                terms = np.unique(np.concatenate(texts).astype(np.int64) * len(texts) + owner) // len(texts)
                counts = np.bincount(terms, minlength=len(held))
                counts[: len(held)] += held
                held, docs, units = counts, docs + len(texts), units + len(owner)
        found = np.flatnonzero(held)
        terms, counts = np.concatenate([[-1, -2], found]), np.concatenate([[docs, units], held[found]])
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(counts, pa.int64())], ["term", "n"])

    got = rows.select("rest").mapInArrow(go, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = {r["term"]: r["n"] for r in got}
    docs, units = n.pop(-1, 0), n.pop(-2, 0)
    df = np.zeros(max(n, default=-1) + 1, np.int64)
    df[list(n)] = list(n.values())
    return df, docs, units / max(docs, 1)


def encoded(docs: DataFrame, path: str, window: int, with_ids: bool) -> DataFrame:
    """doc_id, doc_tokens, key, full (checksums of the whole windows), head (their ids, if wanted), rest (ids)."""
    small_batches(docs.sparkSession)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            sizes, keys, full, head, rest = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                ids = np.append(enc.ids(text or ""), np.array([END_ID], enc.kind))
                whole = len(ids) // window * window
                left = ids[whole:]
                sizes.append(len(ids))
                full.append([crc(ids[i : i + window]) for i in range(0, whole, window)])
                head.append(ids[:whole].tobytes() if with_ids else None)
                rest.append(left.tobytes())
                keys.append(_rarest(left) if len(left) else 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(head, pa.binary()), pa.array(rest, pa.binary())], ["doc_id", "doc_tokens", "key", "full", "head", "rest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(go, "doc_id long, doc_tokens long, key long, full array<long>, head binary, rest binary")


class Index:
    """BM25 inverted index of a shard's left-overs. known: document counts by term, number of documents and mean length, of the
    corpus; those of the shard if none are given."""

    def __init__(self, texts: list[np.ndarray], known: tuple[np.ndarray, int, float] | None = None) -> None:
        n = len(texts)
        sizes = np.array([len(t) for t in texts])
        doc = np.repeat(np.arange(n), sizes)
        pair, tf = np.unique(np.concatenate(texts).astype(np.int64) * n + doc, return_counts=True) if n else (np.zeros(0, np.int64),) * 2
        term, self.docs = pair // max(n, 1), pair % max(n, 1)
        terms, start = np.unique(term, return_index=True)
        self.start = np.append(start, len(term))
        here = np.diff(self.start)
        df, total, mean = (known[0][terms], known[1], known[2]) if known else (here, n, sizes.mean() if n else 1)
        idf = np.log1p((total - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * sizes / max(mean, 1)) if n else sizes
        self.weights = np.repeat(idf, here) * tf * (K1 + 1) / (tf + norm[self.docs])
        # each document's most telling terms that others of the shard have too
        at = np.repeat(np.arange(len(here)), here)
        shared = np.flatnonzero(here[at] > 1)
        order = shared[np.lexsort((-idf[at[shared]], self.docs[shared]))]
        self.query_start = np.searchsorted(self.docs[order], np.arange(n + 1))
        self.query_terms = at[order]
        self.n = n

    def neighbours(self, i: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share telling terms with document i, best first."""
        lo = self.query_start[i]
        terms = self.query_terms[lo : min(self.query_start[i + 1], lo + TERMS)]
        if not len(terms):
            return np.zeros(0, np.int64)
        at = np.concatenate([np.arange(x, y) for x, y in zip(self.start[terms].tolist(), self.start[terms + 1].tolist(), strict=True)])
        score = np.bincount(self.docs[at], self.weights[at], self.n)
        score[used] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def fill(texts: list[np.ndarray], window: int, known: tuple[np.ndarray, int, float] | None = None) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (text number, begin, length)."""
    index = Index(texts, known)
    begin = np.zeros(len(texts), np.int64)
    left = np.array([len(t) for t in texts], np.int64)
    used = left == 0
    windows, seed = [], 0
    while True:
        while seed < len(texts) and used[seed]:
            seed += 1
        if seed == len(texts):
            return windows
        pieces, room = [(seed, int(begin[seed]), int(left[seed]))], window - int(left[seed])
        used[seed] = True
        if room:
            near = index.neighbours(seed, used)
            sizes = left[near]
            best = int(near[np.argmax(sizes > room)]) if (sizes > room).any() else -1
            at = 0
            while room:
                fits = np.flatnonzero(sizes[at:] <= room)
                if not len(fits):
                    break
                at += int(fits[0]) + 1
                c = int(near[at - 1])
                pieces.append((c, int(begin[c]), int(left[c])))
                used[c] = True
                room -= int(left[c])
            nxt, cut = seed + 1, best
            while room:  # neighbours that fit are spent: cut the best, else take the next ones in the lexical order
                if cut < 0:
                    while nxt < len(texts) and used[nxt]:
                        nxt += 1
                    if nxt == len(texts):
                        break
                    cut = nxt
                size = min(room, int(left[cut]))
                pieces.append((cut, int(begin[cut]), size))
                begin[cut] += size
                left[cut] -= size
                used[cut] = left[cut] == 0
                room -= size
                cut = -1
        windows.append(pieces)


def _pieces(rows: list[tuple], ids: list[np.ndarray] | None) -> pa.RecordBatch:
    columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(7)]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if ids is not None:
        sizes = np.array([0, *map(len, ids)], np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names)


def pack(docs: DataFrame, path: str, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, start (ids of the document before it), length, ids_crc32, doc_tokens, sequence_id,
    offset (in the sequence), and ids if wanted. path: the tokenizer's file, at the same place on all executors."""
    rows = staged(encoded(docs, path, window, with_ids), "encoded")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoder(path).kind
        number = 1 << 62 | TaskContext.get().partitionId() << 33
        for batch in batches:
            made, ids = [], []
            for r in batch.to_pylist():
                head = np.frombuffer(r["head"] or b"", kind)
                for k, c in enumerate(r["full"]):
                    made.append((r["doc_id"], k * window, window, c, r["doc_tokens"], number, 0))
                    ids.append(head[k * window : (k + 1) * window])
                    number += 1
            yield _pieces(made, ids if with_ids else None)

    rests = rows.where("octet_length(rest) > 0").select("doc_id", "doc_tokens", "key", "rest")
    known = document_counts(rests, encoder(path).kind)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoder(path).kind
        number = TaskContext.get().partitionId() << 33
        held: list[dict] = []

        def out(shard: list[dict]) -> pa.RecordBatch:
            nonlocal number
            made, cut = [], []
            texts = [np.frombuffer(r["rest"], kind) for r in shard]
            for pieces in fill(texts, window, known):
                offset = 0
                for i, lo, n in pieces:
                    cut.append(texts[i][lo : lo + n])
                    size = shard[i]["doc_tokens"]
                    made.append((shard[i]["doc_id"], size - len(texts[i]) + lo, n, crc(cut[-1]), size, number, offset))
                    offset += n
                number += 1
            return _pieces(made, cut if with_ids else None)

        for batch in batches:
            held += batch.to_pylist()
            if len(held) >= SHARD:
                yield out(held)
                held = []
        if held:
            yield out(held)

    parts = rows.count() // (2 * SHARD) + 1
    spread = F.xxhash64("doc_id")
    rests = rests.repartitionByRange(parts, "key", spread, "doc_id").sortWithinPartitions("key", spread, "doc_id")
    return rows.where("size(full) > 0").select("doc_id", "doc_tokens", "full", "head").mapInArrow(whole, schema).unionByName(rests.mapInArrow(shared, schema))
