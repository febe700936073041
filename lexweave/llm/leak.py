"""Evaluation passages inside training documents.

Method: the questions and answers of the test items form a BM25 inverted index (terms are character 5-grams of the
letters and digits, 12-grams for items in Latin script). Every document is a query by all its passages at once,
since the pieces of an item may lie far apart: its distinct terms, wherever they stand. Impacts are divided by the field's
score against itself, so a score is the idf-weighted share of a field found in the document, whatever its length.
Block-max WAND over a batch of documents: postings lie in blocks of fields with their highest impact per term. A document
whose highest impacts stay under the threshold is left at once; then the block maxima of its terms are added up, and
only the postings of blocks whose sum reaches the threshold are read. All fields above the threshold are
retrieved; then it is verified how many characters of question and answer stand in the document.

Scale: one pass over the documents, no shuffle of texts, whatever the number of items. The index takes space in
proportion to the characters of the items (about 50 bytes each); more than MAX_INDEX_CHARS of them are cut into several
indexes, each broadcast with that bound, and a task holds one of them at a time.

Null or blank texts hold nothing; null questions or answers are no field; repeated documents and items count each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.grams import gram_hashes, gram_owner, letters_only, slices

MAX_INDEX_CHARS = 2_000_000
#: Characters of documents for which a task goes through all indexes.
TURN = 16_000_000
K1, B = 1.2, 0.75
TERM = {False: 5, True: 12}
CHECK = {False: 12, True: 18}
BLOCK = 16
#: Share of a field's weight a document must hold to be verified.
RETRIEVE = 0.15
#: Share of the characters of a question or answer a document must hold, in runs of CHECK characters: half, less what a
#: few changed characters cost.
HELD = 0.45


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first[i] ... first[i] + size[i] - 1 for all i."""
    return np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)


class ItemIndex:
    """BM25 postings with normalised impacts and block maxima; field 2i is question i, field 2i + 1 answer i."""

    def __init__(self, rows: list[tuple[int, str | None, str | None]]):
        self.item = np.array([r[0] for r in rows], dtype=np.int64)
        chars, starts = letters_only([t or "" for r in rows for t in r[1:3]])
        n, lengths = len(starts) - 1, np.diff(starts)
        self.fields, self.size, self.blocks = n, lengths, max(1, math.ceil(n / BLOCK))
        wide = np.bincount(np.repeat(np.arange(n), lengths), chars >= 0x2E80, n)
        self.latin = wide * 2 < lengths
        term, field, tf = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.checks: list[np.ndarray] = []
        for i in range(n):
            own = chars[starts[i] : starts[i + 1]]
            u, c = np.unique(gram_hashes(own, TERM[bool(self.latin[i])]), return_counts=True)
            term.append(u)
            field.append(np.full(len(u), i))
            tf.append(c)
            self.checks.append(gram_hashes(own, CHECK[bool(self.latin[i])]))
        term, field, tf = (np.concatenate(x) for x in (term, field, tf))
        self.vocabulary, at, df = np.unique(term, return_inverse=True, return_counts=True)
        live = max(1, int((lengths > 0).sum()))
        idf = np.log(1 + (live - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(1.0, lengths.sum() / live))
        impact = idf[at] * tf * (K1 + 1) / (tf + norm[field])
        impact = impact / np.maximum(np.bincount(field, impact, n)[field], 1e-12)
        order = np.lexsort((field, at))
        at, field, impact = at[order], field[order], impact[order]
        self.posting_field, self.posting_impact = field.astype(np.int32), impact.astype(np.float32)
        # One entry for every term and block that meet: where its postings lie and their highest impact.
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (field[1:] // BLOCK != field[:-1] // BLOCK)]) if len(at) else np.zeros(0, np.int64)
        self.entry_first = np.r_[new, len(at)]
        self.entry_block = (field[new] // BLOCK).astype(np.int32)
        self.entry_max = np.maximum.reduceat(impact, new).astype(np.float32) if len(new) else np.zeros(0, np.float32)
        self.first = np.searchsorted(at[new], np.arange(len(self.vocabulary) + 1))
        self.highest = np.maximum.reduceat(self.entry_max, self.first[:-1]) if len(new) else np.zeros(0, np.float32)
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        self.read = 0

    def terms_in(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose hash is a term, and which."""
        if not len(self.vocabulary):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.filter[(hashes >> np.uint64(44)).astype(np.int64)])
        t = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
        same = self.vocabulary[t] == hashes[at]
        return at[same], t[same]

    def retrieve(self, doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, field) pairs whose score reaches the threshold; (document, term) pairs are distinct."""
        none = np.zeros(0, dtype=np.int64)
        if not len(term):
            return none, none
        keep = np.bincount(doc, self.highest[term])[doc] >= RETRIEVE
        doc, term = doc[keep], term[keep]
        count = self.first[term + 1] - self.first[term]
        entry, doc = _ranges(self.first[term], count), np.repeat(doc, count)
        if not len(entry):
            return none, none
        key, inv = np.unique(doc * self.blocks + self.entry_block[entry], return_inverse=True)
        open_ = (np.bincount(inv, self.entry_max[entry]) >= RETRIEVE)[inv]
        entry, doc = entry[open_], doc[open_]
        count = self.entry_first[entry + 1] - self.entry_first[entry]
        post, doc = _ranges(self.entry_first[entry], count), np.repeat(doc, count)
        self.read += len(post)
        key, inv = np.unique(doc * self.fields + self.posting_field[post], return_inverse=True)
        good = key[np.bincount(inv, self.posting_impact[post], len(key)) >= RETRIEVE]
        return good // self.fields, good % self.fields

    def held(self, field: int, grams: np.ndarray) -> float:
        """Share of a field's characters that stand in runs of CHECK characters among the sorted grams of a document."""
        need, n = self.checks[field], CHECK[bool(self.latin[field])]
        if not len(need) or not len(grams):
            return 0.0
        at = np.minimum(np.searchsorted(grams, need), len(grams) - 1)
        hit = np.flatnonzero(grams[at] == need)
        size = int(self.size[field])
        mark = np.bincount(hit, minlength=size + 1)[: size + 1] - np.bincount(hit + n, minlength=size + 1)[: size + 1]
        return float((np.cumsum(mark)[:size] > 0).mean())

    def match(self, texts: list[str]) -> list[tuple[int, int, float, float]]:
        """(text, item, share of the question, share of the answer) for every text that holds enough of either."""
        chars, starts = letters_only(texts)
        found: set[tuple[int, int]] = set()
        for latin in {bool(x) for x in self.latin[self.size > 0]}:
            h = gram_hashes(chars, TERM[latin])
            at, term = self.terms_in(h)
            owner = np.searchsorted(starts, at, side="right") - 1
            whole = at + TERM[latin] <= starts[owner + 1]
            pairs = np.unique(owner[whole] * max(1, len(self.vocabulary)) + term[whole])
            d, f = self.retrieve(pairs // max(1, len(self.vocabulary)), pairs % max(1, len(self.vocabulary)))
            found.update(zip(d.tolist(), (f // 2).tolist()))
        out, last, grams = [], -1, {}
        for d, i in sorted(found):
            if d != last:
                last, grams = d, {}
            share = [0.0, 0.0]
            for side in (0, 1):
                latin = bool(self.latin[2 * i + side])
                if latin not in grams:
                    grams[latin] = np.sort(gram_hashes(chars[starts[d] : starts[d + 1]], CHECK[latin]))
                share[side] = self.held(2 * i + side, grams[latin])
            if max(share) >= HELD:
                out.append((d, i, *share))
        return out


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, question_share, answer_share): every document and item of which it holds at least half."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("bigint"), "question", "answer").where("coalesce(question, '') <> '' or coalesce(answer, '') <> ''")
    chars = items.agg(F.sum(F.length(F.concat(F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit("")))))).first()[0] or 0
    number = max(1, math.ceil(chars / MAX_INDEX_CHARS))
    shared = []
    for b in range(number):
        part = items if number == 1 else items.where(F.pmod(F.xxhash64("item_id", "question", "answer"), F.lit(number)) == b)
        shared.append(spark.sparkContext.broadcast(ItemIndex(sorted(map(tuple, part.collect()), key=lambda r: (r[0], str(r))))))

    def matched(ids: list[int], texts: list[str]) -> Iterator[pa.RecordBatch]:
        for index in shared:
            # With several indexes none stays in memory after its turn.
            ix = index.value if number == 1 else index.load_from_path(index._path)
            for x, y in slices([len(t) for t in texts], 1_000_000):
                got = ix.match(texts[x:y])
                if got:
                    d, i, q, a = map(np.array, zip(*got))
                    yield pa.RecordBatch.from_arrays([pa.array([ids[x + k] for k in d], pa.int64()), pa.array(ix.item[i]), pa.array(q, pa.float64()), pa.array(a, pa.float64())], names=["doc_id", "item_id", "question_share", "answer_share"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            ids, texts = ids + batch.column(0).to_pylist(), texts + batch.column(1).to_pylist()
            size += pa.compute.sum(pa.compute.utf8_length(batch.column(1))).as_py() or 0
            if number == 1 or size >= TURN:
                yield from matched(ids, texts)
                ids, texts, size = [], [], 0
        yield from matched(ids, texts)

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("_t")).where(F.length("_t") > 0)
    return docs.mapInArrow(run, "doc_id bigint, item_id bigint, question_share double, answer_share double")
