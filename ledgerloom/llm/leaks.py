"""Evaluation texts that leaked into a corpus: latent semantic retrieval, then checks of the common sequence and the answer.

1. **Scan** (once over the corpus, in Arrow batches): with only letters and digits kept, case and width folded, every
   document gives the places of the terms of the evaluation items.  A term is a run of ``q`` characters: 8, or 4 for items mostly
   in Han characters, and never more than half of an item, so that items of any length can be found.  Terms of no item
   have a zero in every item's row; they count in the lengths of passages only.
2. **Matrix**: one row per passage of ``WINDOW`` characters, every ``STRIDE``, of every document: which terms it holds, weighted by
   inverse document frequency over all documents, in ``FEATURES`` hashed columns.  No passage is left out beforehand.
3. **Randomised SVD**: a random sketch of the matrix's Gram matrix is summed over partitions, and its eigenvectors and singular values follow from the
   sketch (one-pass Nystrom form).  The items are rows too, with ``ITEM_WEIGHT`` times the weight of all passages; the fewest leading directions that keep
   ``ENERGY`` of every item's squared length stay.
4. **Search**: the cosine of every passage with every item in the latent space.  The cutoff is set per item from the definition of a leak:
   ``MARGIN`` times the least cosine that a passage can have which holds its part of half the item, ``NEAR`` at most (so that reworded long items pass), less what the truncation may hide.
5. **Check** of the candidates: the longest common unbroken stretch, read off diagonals of term places; half of the item's characters or more is a
   ``copy``.  For others, the longest common subsequence of terms near the passage: one that covers ``REWORDED`` of the item's characters
   together with the item's answer in the document, or ``RESTATED`` without it, is a ``paraphrase``.

The corpus is never shuffled or joined: after the scan each document is at most one row of places per block of items.  Items are read in slices of ``SLICE``
(each slice is a scan of its own) and searched in blocks of ``BLOCK``; a slice's vocabulary, the directions (``FEATURES`` x rank) and the
frequencies of its terms go through the driver.

Defined results: null or empty texts match nothing; items without a letter or digit match nothing; null ids are
left out; repeated items with one id give one row; repeated documents are different documents.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch

#: Parameters.
Q, Q_HAN, WINDOW, STRIDE = 8, 4, 128, 64
FEATURES, EXTRA, ENERGY, ITEM_WEIGHT, MARGIN, NEAR = 4096, 64, 1 - 1e-4, 1000.0, 0.6, 0.15
REWORDED, RESTATED = 0.5, 0.8
BLOCK, SLICE, SEED = 256, 20_000, 20240917
CHUNK, ENTRIES = 1_000_000, 16_384
_A = np.uint64(0x9E3779B97F4A7C15)

def fold_table() -> np.ndarray:
    """Code point -> folded code point; 0 for what is neither letter nor digit."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for cp in range(0x33480):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        if not c.isalnum() and unicodedata.category(c)[0] not in "LN":
            continue
        wide = unicodedata.normalize("NFKC", c)
        c = wide if len(wide) == 1 else c
        low = c.lower()
        table[cp] = ord(low if len(low) == 1 else c)
    return table


def folded(text: str, table: np.ndarray) -> np.ndarray:
    codes = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    return codes[codes > 0]


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Mixed 64-bit hashes of all q-grams of a code sequence."""
    if len(codes) < q:
        return np.zeros(0, dtype=np.uint64)
    h, have, base = codes.astype(np.uint64), 1, int(_A)
    while have * 2 <= q:
        h = h[:-have] * np.uint64(base) + h[have:]
        have, base = have * 2, base * base % (1 << 64)
    for k in range(have, q):
        h = h[: len(codes) - k] * _A + codes[k:]
    h ^= h >> np.uint64(31)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def gram_size(codes: np.ndarray) -> int:
    """Length of an item's terms: never more than half of it, so that half of it holds a term."""
    han = ((codes >= 0x3400) & (codes <= 0x9FFF)) | ((codes >= 0xF900) & (codes <= 0xFAFF)) | (codes >= 0x20000)
    return min(Q_HAN if han.mean() > 0.5 else Q, (len(codes) + 1) // 2)


class Items:
    """Vocabulary of one block of evaluation items with terms of one length."""

    def __init__(self, rows: list, q: int):
        self.q = q
        self.ids, self.codes, self.answers = ([r[k] for r in rows] for k in range(3))
        hashes = [gram_hashes(c, q) for c in self.codes]
        self.vocabulary = np.unique(np.concatenate(hashes))
        self.grams = [np.searchsorted(self.vocabulary, h) for h in hashes]
        self.size = np.array([len(c) for c in self.codes])
        self.half = (self.size + 1) // 2
        self.answered = np.array([len(a) > 0 for a in self.answers])
        spots = np.array([(g, i, p) for i, grams in enumerate(self.grams) for p, g in enumerate(grams)], dtype=np.int64).reshape(-1, 3)
        spots = spots[np.argsort(spots[:, 0], kind="stable")]
        self.spots = spots[:, 1:]
        self.first = np.searchsorted(spots[:, 0], np.arange(len(self.vocabulary) + 1))
        self.bitmap = np.zeros(1 << 20, dtype=bool)
        self.bitmap[self.vocabulary >> np.uint64(44)] = True
        mixed = self.vocabulary * np.uint64(0x94D049BB133111EB)
        self.feature = ((mixed >> np.uint64(20)) % np.uint64(FEATURES)).astype(np.int64)
        self.sign = np.where(mixed >> np.uint64(63), 1.0, -1.0)

    def spots_of(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``spots`` of all grams, one after the other, and how many each has."""
        count = self.first[grams + 1] - self.first[grams]
        start = np.cumsum(count) - count
        return np.repeat(self.first[grams] - start, count) + np.arange(count.sum()), count

    def least_cosine(self, weight: np.ndarray, top: float) -> np.ndarray:
        """Per item the least cosine of a passage that holds its part of half the item.

        A stretch of up to ``WINDOW - STRIDE + 1`` characters lies in one passage whole; a longer one fills at least as much of some
        passage, and one of ``WINDOW + STRIDE - 1`` or more fills a passage.
        """
        out = np.zeros(len(self.ids))
        for i, grams in enumerate(self.grams):
            held = WINDOW if self.half[i] >= WINDOW + STRIDE - 1 else min(self.half[i], WINDOW - STRIDE + 1)
            m = max(1, held - self.q + 1)
            square = weight[grams] ** 2
            whole = square[np.unique(grams, return_index=True)[1]].sum()
            again = np.ones(len(grams), dtype=bool)
            again[np.unique(grams, return_index=True)[1]] = False
            square[again] = 0  # a term counts once; where one run misses its first place, the sum is only smaller
            least = np.convolve(square, np.ones(m), mode="valid").min() if len(square) >= m else square.sum()
            others = max(0, WINDOW - self.q + 1 - m) * top * top
            out[i] = least / np.sqrt(whole * (least + others)) if least > 0 else 0.0
        return out


def _chunks(texts: list):
    """(first document, folded codes, bounds) of runs of documents of about ``CHUNK`` characters."""
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size < CHUNK):
            size += len(texts[end])
            end += 1
        yield start, texts[start:end]
        start = end


HITS = pa.schema([("block", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int32()), ("at", pa.list_(pa.int32())), ("gram", pa.list_(pa.int32())), ("answered", pa.list_(pa.int32()))])


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, pa.int32()))


def _scan(blocks, table):
    """Batches of (doc_id, text) -> per block of items one row of places per document that holds a term, and one row
    (null, documents, frequencies, terms, ...) per batch."""

    def places(it, codes, bounds):
        hashes = gram_hashes(codes, it.q)
        near = np.flatnonzero(it.bitmap[hashes >> np.uint64(44)])
        term = np.minimum(np.searchsorted(it.vocabulary, hashes[near]), len(it.vocabulary) - 1)
        near, term = (x[it.vocabulary[term] == hashes[near]] for x in (near, term))
        doc = np.searchsorted(bounds, near, side="right") - 1
        inside = near + it.q <= bounds[doc + 1]
        return near[inside], term[inside], doc[inside]

    def answers(it, codes, bounds, once, count):
        """(document, item) where the answer stands in a document with enough terms of the item for any paraphrase of it."""
        doc, term = once // len(it.vocabulary), once % len(it.vocabulary)
        which, times = it.spots_of(term)
        score = np.bincount(np.repeat(doc, times) * len(it.ids) + it.spots[which, 0], minlength=count * len(it.ids)).reshape(count, -1)
        enough = score >= np.maximum(1, np.ceil(REWORDED * it.size / it.q))
        found = {}
        for d, i in np.argwhere(enough & it.answered):
            whole = found.setdefault(d, (codes[bounds[d] : bounds[d + 1]].tobytes(), []))
            if _aligned(whole[0], it.answers[i]):
                whole[1].append(i)
        return {d: kept for d, (_, kept) in found.items()}

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            frequency = [np.zeros(len(it.vocabulary), dtype=np.int64) for it in blocks.value]
            for start, parts in _chunks(texts):
                codes = table.value[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
                keep = codes > 0
                ends = np.cumsum([len(p) for p in parts])
                bounds = np.concatenate([[0], np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[ends]])
                codes = codes[keep]
                for b, it in enumerate(blocks.value):
                    near, term, doc = places(it, codes, bounds)
                    if not len(near):
                        continue
                    once = np.unique(doc * len(it.vocabulary) + term)
                    frequency[b] += np.bincount(once % len(it.vocabulary), minlength=len(it.vocabulary))
                    told = answers(it, codes, bounds, once, len(parts))
                    docs, counts = np.unique(doc, return_counts=True)
                    answered = [told.get(d, []) for d in docs.tolist()]
                    columns = [
                        pa.array(np.full(len(docs), b), pa.int32()),
                        pa.array(ids[start + docs], pa.int64()),
                        pa.array(bounds[docs + 1] - bounds[docs], pa.int32()),
                        _lists(near - bounds[doc], counts),
                        _lists(term, counts),
                        _lists(np.array([i for a in answered for i in a], dtype=np.int32), np.array([len(a) for a in answered])),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, schema=HITS)
            for b, seen in enumerate(frequency):
                known = np.flatnonzero(seen)
                columns = [pa.array([b], pa.int32()), pa.array([None], pa.int64()), pa.array([len(texts)], pa.int32()), _lists(seen[known], np.array([len(known)])), _lists(known, np.array([len(known)])), _lists(np.zeros(0, dtype=np.int32), np.array([0]))]
                yield pa.RecordBatch.from_arrays(columns, schema=HITS)

    return run


def _aligned(whole: bytes, part: bytes) -> bool:
    at = whole.find(part)
    while at >= 0 and at % 4:
        at = whole.find(part, at + 1)
    return at >= 0


class Passages:
    """The passages of a batch of documents that hold a term, in the order of the documents.

    ``doc``, ``start``, ``norm``: document, first character and length per passage.  Passages with the same terms are one ``pattern``, so that boilerplate
    is projected once a batch; ``term``, ``row``: one entry per term of a pattern; ``count``: passages per pattern.
    A place belongs to the windows that hold its whole term: those that start in its own stride or one stride before.
    """

    def __init__(self, n: np.ndarray, at: np.ndarray, gram: np.ndarray, count: np.ndarray, q: int, weight: np.ndarray, top: float):
        doc = np.repeat(np.arange(len(n)), count)
        last = np.maximum(0, -(-np.maximum(0, n - WINDOW) // STRIDE)).astype(np.int64)
        base = np.cumsum(last + 1) - last - 1
        own = at // STRIDE
        early = (own >= 1) & (at - (own - 1) * STRIDE <= WINDOW - q)
        window, owner, term = np.concatenate([own, own[early] - 1]), np.concatenate([doc, doc[early]]), np.concatenate([gram, gram[early]]).astype(np.int64)
        inside = window <= last[owner]
        window, owner, term = window[inside], owner[inside], term[inside]
        pair = np.unique((base[owner] + window) * len(weight) + term)
        term, window_id = pair % len(weight), pair // len(weight)
        known, first, row = np.unique(window_id, return_index=True, return_inverse=True)
        self.doc = np.searchsorted(base, known, side="right") - 1
        self.start = (known - base[self.doc]) * STRIDE
        places = np.bincount(np.searchsorted(known, base[owner] + window), minlength=len(known))
        spots = np.minimum(WINDOW, n[self.doc] - self.start) - q + 1
        own_weight = np.bincount(row, weights=weight[term] ** 2, minlength=len(known))
        self.norm = np.sqrt(own_weight + np.maximum(0, spots - places) * top * top).astype(np.float32)
        # the sum of a mixed 64-bit word per term names a set of terms
        word = (term + 1).astype(np.uint64) * _A
        word = (word ^ (word >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mark = np.add.reduceat(word ^ (word >> np.uint64(32)), first) if len(first) else word
        _, chosen, self.pattern, self.count = np.unique(mark, return_index=True, return_inverse=True, return_counts=True)
        kept = np.zeros(len(known), dtype=bool)
        kept[chosen] = True
        place = np.full(len(known), -1)
        place[chosen] = np.arange(len(chosen))
        mine = kept[row]
        order = np.argsort(place[row[mine]], kind="stable")
        self.term, self.row = term[mine][order], place[row[mine]][order]
        self.by_pattern = np.argsort(self.pattern, kind="stable")
        self.least = np.minimum.reduceat(self.norm[self.by_pattern], np.cumsum(self.count) - self.count) if len(known) else self.norm

    def of(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All passages of the patterns, one after the other, and how many each has."""
        count = self.count[patterns]
        start = np.cumsum(count) - count
        return self.by_pattern[np.repeat((np.cumsum(self.count) - self.count)[patterns] - start, count) + np.arange(count.sum())], count

    def coordinates(self, basis: np.ndarray, value: np.ndarray, feature: np.ndarray):
        """Chunks (first pattern, last + 1, entries, their coordinates in the basis)."""
        starts = np.searchsorted(self.row, np.arange(len(self.count) + 1))
        first = 0
        while first < len(self.count):
            end = max(first + 1, int(np.searchsorted(starts, starts[first] + ENTRIES, side="right")) - 1)
            part = slice(starts[first], starts[end])
            term = self.term[part]
            rows = value[term, None] * basis[feature[term]]
            yield first, end, part, np.add.reduceat(rows, starts[first:end] - starts[first], axis=0)
            first = end


def _opened(batch: pa.RecordBatch):
    """(doc ids, sizes, places, terms, terms per document, answered items per document) of a batch of hits."""
    at, gram = batch.column("at"), batch.column("gram")
    count = np.diff(at.offsets.to_numpy())
    return batch.column("doc_id").to_numpy(), batch.column("n").to_numpy().astype(np.int64), at.flatten().to_numpy().astype(np.int64), gram.flatten().to_numpy(), count, batch.column("answered")


def _sum_rows(df: DataFrame, function, tasks: int, rank: int) -> np.ndarray:
    """Sum over all rows of ``function``'s (feature, part, vector); at most ``FEATURES`` vectors leave each step.

    Partial sums are added in a tree: tasks of a level take at most 64 parts of their features.
    """

    def add(batches):
        total, seen, bucket = np.zeros((FEATURES, rank), dtype=np.float32), np.zeros(FEATURES, dtype=bool), {}
        for batch in batches:
            for k, part, v in zip(batch["feature"], batch["part"], batch["v"], strict=True):
                b = part // 64
                if b not in bucket:
                    bucket[b] = (np.zeros_like(total), np.zeros_like(seen))
                bucket[b][0][k] += np.frombuffer(v, dtype=np.float32)
                bucket[b][1][k] = True
        for b, (sums, rows) in bucket.items():
            yield _vectors(sums, rows, b)

    parts = df.mapInArrow(function, "feature int, part int, v binary")
    while True:
        buckets = max(1, -(-tasks // 64))
        parts = parts.repartition(buckets, F.floor(F.col("part") / 64)).mapInPandas(add, "feature int, part int, v binary")
        tasks = buckets
        if tasks == 1:
            break
    out = np.zeros((FEATURES, rank))
    rows = parts.select("feature", "v").toPandas()
    for k, v in zip(rows["feature"], rows["v"], strict=True):
        out[k] += np.frombuffer(v, dtype=np.float32)
    return out


def _vectors(sums: np.ndarray, rows: np.ndarray, part: int) -> pd.DataFrame:
    kept = np.flatnonzero(rows)
    return pd.DataFrame({"feature": kept.astype(np.int32), "part": np.full(len(kept), part, dtype=np.int32), "v": [sums[k].tobytes() for k in kept]})


def directions(sketch: np.ndarray, omega: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular vectors and values of a matrix from ``sketch`` = (its Gram matrix) x ``omega``, by the stabilised Nystrom form."""
    shift = np.sqrt(len(omega)) * np.finfo(float).eps * max(1e-30, np.linalg.norm(sketch))
    moved = sketch + shift * omega
    core = omega.T @ moved
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > max(1e-12 * value.max(), 0)
    root = moved @ (vector[:, good] / np.sqrt(value[good]))
    left, singular, _ = np.linalg.svd(root, full_matrices=False)
    return left, np.sqrt(np.maximum(0, singular**2 - shift))


def search(documents: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """``(doc_id, item_id, kind, stretch, common, item_chars, cosine, answered)``: one row per leak, ``kind`` copy or paraphrase."""
    one = items.filter(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.max(F.struct("text", "answer")).alias("i")).select("item_id", "i.text", "i.answer")
    table, spark = fold_table(), documents.sparkSession
    fold = spark.sparkContext.broadcast(table)
    out, held = None, []
    for row in one.orderBy("item_id").toLocalIterator():
        codes = folded(row.text or "", table)
        if len(codes):
            held.append((row.item_id, codes, folded(row.answer or "", table).tobytes()))
        if len(held) == SLICE:
            out, held = _joined(out, _search_slice(documents, held, fold, scratch)), []
    if held or out is None:
        out = _joined(out, _search_slice(documents, held, fold, scratch))
    return out


def _joined(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


FOUND = "doc_id bigint, item_id bigint, kind string, stretch int, common int, item_chars int, cosine double, answered boolean"


def _search_slice(documents: DataFrame, held: list, fold, scratch: Scratch) -> DataFrame:
    spark = documents.sparkSession
    by_size: dict[int, list] = {}
    for row in held:
        by_size.setdefault(gram_size(row[1]), []).append(row)
    blocks = [Items(rows[k : k + BLOCK], q) for q, rows in sorted(by_size.items()) for k in range(0, len(rows), BLOCK)]
    if not blocks:
        return spark.createDataFrame([], FOUND)
    shared = spark.sparkContext.broadcast(blocks)
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull())
    hits = source.mapInArrow(_scan(shared, fold), "block int, doc_id bigint, n int, at array<int>, gram array<int>, answered array<int>")
    hits = scratch.cut(hits)
    totals = hits.filter(F.col("doc_id").isNull())
    corpus = totals.filter("block = 0").agg(F.sum("n")).first()[0] or 0
    counts = totals.select("block", F.explode(F.arrays_zip("at", "gram")).alias("p")).groupBy("block", "p.gram").agg(F.sum("p.at").alias("count")).toPandas()  # terms of the items only
    out = None
    for b in range(len(blocks)):
        seen = counts[counts["block"] == b]
        frequency = np.zeros(len(blocks[b].vocabulary))
        frequency[seen["gram"].to_numpy(dtype=np.int64)] = seen["count"].to_numpy()
        mine = hits.filter((F.col("block") == b) & F.col("doc_id").isNotNull()).drop("block")
        out = _joined(out, _search_block(mine, shared, b, frequency, corpus))
    return out


def _search_block(hits: DataFrame, shared, b: int, frequency: np.ndarray, corpus: int) -> DataFrame:
    spark, block = hits.sparkSession, shared.value[b]
    top = float(np.log(corpus + 1) + 1)
    # the floor lets a passage that is copied into a large part of the corpus keep its weight
    weight = np.maximum(np.log((corpus + 1) / (frequency + 1)) + 1, top / 2)
    value, feature = (weight * block.sign).astype(np.float32), block.feature
    rank = min(FEATURES // 2, len(block.ids) + EXTRA)
    terms = spark.sparkContext.broadcast((weight, value, feature))

    rows = np.zeros((len(block.ids), FEATURES))
    for i, grams in enumerate(block.grams):
        distinct = np.unique(grams)
        np.add.at(rows[i], feature[distinct], value[distinct])
    length = np.array([np.sqrt((weight[np.unique(g)] ** 2).sum()) for g in block.grams])

    def passages(batches):
        w, v, f = terms.value
        for batch in batches:
            if batch.num_rows:
                opened = _opened(batch)
                found = Passages(*opened[1:5], shared.value[b].q, w, top)
                if len(found.norm):
                    yield opened, found, v, f

    def sketch_of(omega):
        def run(batches):
            from pyspark import TaskContext

            total = np.zeros((FEATURES, omega.value.shape[1]), dtype=np.float32)
            touched = np.zeros(FEATURES, dtype=bool)
            for _, found, v, f in passages(batches):
                for first, _, part, coordinates in found.coordinates(omega.value, v, f):
                    term = found.term[part]
                    order = np.argsort(f[term], kind="stable")
                    row = found.row[part][order]
                    sent = (v[term[order]] * found.count[row])[:, None].astype(np.float32) * coordinates[row - first]
                    sorted_features = f[term[order]]
                    cuts = np.flatnonzero(np.concatenate([[True], np.diff(sorted_features) != 0]))
                    total[sorted_features[cuts]] += np.add.reduceat(sent, cuts, axis=0)
                    touched[sorted_features[cuts]] = True
            yield pa.RecordBatch.from_pandas(_vectors(total, touched, TaskContext.get().partitionId()), schema=pa.schema([("feature", pa.int32()), ("part", pa.int32()), ("v", pa.binary())]), preserve_index=False)

        return run

    rng = np.random.default_rng(SEED)
    omega = np.linalg.qr(rng.standard_normal((FEATURES, rank)))[0]
    sent = spark.sparkContext.broadcast(omega.astype(np.float32))
    tasks = max(1, hits.rdd.getNumPartitions())
    sketch = _sum_rows(hits, sketch_of(sent), tasks, rank)
    of_items = rows.T @ (rows @ omega)
    sketch += max(1.0, ITEM_WEIGHT * np.linalg.norm(sketch) / max(1e-9, np.linalg.norm(of_items))) * of_items
    vectors, _ = directions(sketch, omega)
    latent = rows @ vectors
    kept = np.cumsum(latent**2, axis=1) / np.maximum(1e-30, (rows**2).sum(axis=1))[:, None]
    enough = (kept >= ENERGY).all(axis=0)
    width = int(np.argmax(enough)) + 1 if enough.any() else latent.shape[1]
    hidden = np.sqrt(np.maximum(0, 1 - kept[:, width - 1]))
    cutoff = np.maximum(0.0, np.minimum(NEAR, MARGIN * block.least_cosine(weight, top)) - hidden)
    space = spark.sparkContext.broadcast((np.ascontiguousarray(vectors[:, :width]).astype(np.float32), (latent[:, :width] / length[:, None]).astype(np.float32), cutoff.astype(np.float32)))

    def check(batches):
        basis, wanted, least = space.value
        it = shared.value[b]
        floor, reach = float(least.min()), float(np.sqrt((wanted**2).sum(axis=1)).max())
        for opened, found, v, f in passages(batches):
            near = []
            for first, end, _, coordinates in found.coordinates(basis, v, f):
                norm = found.least[first:end]
                # a pattern whose whole latent part is too short reaches no item
                live = np.flatnonzero(np.sqrt((coordinates**2).sum(axis=1)) * reach >= floor * norm)
                if len(live):
                    product = coordinates[live] @ wanted.T
                    p, i = np.nonzero((product >= least * norm[live, None]) & (product > 0))
                    passage, count = found.of(live[p] + first)
                    item, cosine = np.repeat(i, count), np.repeat(product[p, i], count) / found.norm[passage]
                    good = cosine >= least[item]
                    near.append((passage[good], item[good], cosine[good]))
            yield _checked(it, opened, found, near)

    return hits.mapInArrow(check, FOUND)


def _checked(it: Items, opened, found: Passages, near: list) -> pa.RecordBatch:
    """Candidates (passage, item, cosine) of a batch -> its leaks."""
    ids, _, at, gram, count, answered = opened
    out = []
    if near:
        passage, item, cosine = (np.concatenate(x) for x in zip(*near, strict=True))
        doc = found.doc[passage]
        order = np.lexsort((-cosine, item, doc))
        passage, item, cosine, doc = passage[order], item[order], cosine[order], doc[order]
        best = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(item) != 0)]))
        # neither a stretch nor a subsequence covers more of an item than all its terms in the document together
        cover = np.zeros(len(doc), dtype=np.int64)
        cover[best] = _covered(it, doc[best], item[best], at, gram, count)
        best = best[cover[best] >= REWORDED * it.size[item[best]]]
        ends = np.cumsum(count)
        for d, rows in _runs(doc[best], best):
            span = slice(ends[d] - count[d], ends[d])
            places, terms = at[span], gram[span]
            stretch = _longest(places, terms, it)
            told = set(answered[d].as_py() or [])
            for r in rows:
                i = int(item[r])
                n, longest = int(it.size[i]), stretch.get(i, 0)
                kind, common = "copy", longest
                if longest < it.half[i]:
                    least, start = (REWORDED if i in told else RESTATED) * n, found.start[passage[r]]
                    if cover[r] < least:
                        continue
                    common = _common(places, terms, it, i, start - n, start + WINDOW + n)
                    if common < least:
                        continue
                    kind = "paraphrase"
                out.append((int(ids[d]), it.ids[i], kind, longest, common, n, float(cosine[r]), i in told))
    columns = list(zip(*out, strict=True)) if out else [[]] * 8
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.bool_()]
    names = ["doc_id", "item_id", "kind", "stretch", "common", "item_chars", "cosine", "answered"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _covered(it: Items, docs: np.ndarray, items: np.ndarray, at: np.ndarray, gram: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Characters of each (document, item) pair's item that its terms anywhere in the document cover; pairs come in order."""
    wanted = np.zeros(len(count), dtype=bool)
    wanted[docs] = True
    mine = np.repeat(wanted, count)
    doc = np.repeat(np.arange(len(count)), count)[mine]
    once = np.unique(doc * len(it.vocabulary) + gram[mine])
    which, times = it.spots_of(once % len(it.vocabulary))
    reach = int(it.size.max()) + it.q
    pair = np.repeat(once // len(it.vocabulary), times) * len(it.ids) + it.spots[which, 0]
    spot = np.sort(pair * reach + it.spots[which, 1])
    pair = spot // reach
    step = np.full(len(spot), it.q)
    step[:-1] = np.where(pair[1:] == pair[:-1], np.minimum(it.q, np.diff(spot)), it.q)
    known, first = np.unique(pair, return_index=True)
    return np.add.reduceat(step, first)[np.searchsorted(known, docs * len(it.ids) + items)]


def _runs(keys: np.ndarray, rows: np.ndarray):
    cuts = np.flatnonzero(np.diff(keys)) + 1
    for k, r in zip(np.split(keys, cuts), np.split(rows, cuts), strict=True):
        if len(k):
            yield int(k[0]), r


def _longest(at: np.ndarray, gram: np.ndarray, it: Items) -> dict[int, int]:
    """Longest common unbroken stretch with each item: runs of places on one diagonal."""
    which, count = it.spots_of(gram)
    place = np.repeat(at, count)
    item, offset = it.spots[which, 0], it.spots[which, 1]
    order = np.lexsort((place, place - offset, item))
    item, diagonal, place = item[order], (place - offset)[order], place[order]
    new = np.ones(len(item), dtype=bool)
    new[1:] = (np.diff(item) != 0) | (np.diff(diagonal) != 0) | (np.diff(place) != 1)
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(item))) + it.q - 1
    out: dict[int, int] = {}
    for i, n in zip(item[starts].tolist(), lengths.tolist(), strict=True):
        if n > out.get(i, 0):
            out[i] = n
    return out


def _common(at: np.ndarray, gram: np.ndarray, it: Items, i: int, first: int, end: int) -> int:
    """Characters of the item that the longest common subsequence of terms covers, in the document's places from ``first`` to ``end``.

    Pairs of equal terms in order of (place, falling offset); the longest rising run of offsets, by patience piles with back links.
    """
    near = (at >= first) & (at < end)
    at, gram = at[near], gram[near]
    which, count = it.spots_of(gram)
    mine = it.spots[which, 0] == i
    place, offset = np.repeat(at, count)[mine], it.spots[which, 1][mine]
    order = np.lexsort((-offset, place))
    piles, last, back = [], [], []
    values = offset[order].tolist()
    for k, v in enumerate(values):
        p = bisect_left(piles, v)
        if p == len(piles):
            piles.append(v)
            last.append(k)
        else:
            piles[p], last[p] = v, k
        back.append(last[p - 1] if p else -1)
    covered, k = set(), last[-1] if last else -1
    while k >= 0:
        covered.update(range(values[k], values[k] + it.q))
        k = back[k]
    return len(covered)
