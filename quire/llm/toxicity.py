"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are at most PER_CLASS labelled documents of each class, chosen by a hash of doc_id (a documented bound; a document
labelled twice is toxic if one label says so, and of several texts of one id the one of the least hash serves). All lower-cased
words of all examples are terms; none is dropped. A term's weight in a text is (1 + ln times) * ln(documents / documents
with the term), counted over all documents, times sqrt(1 + X), X being what the chi-square of the term and the label in the
sample (corrected for continuity) exceeds CHANCE by: association stresses a term, and one without any has plain TF-IDF. Words
of no example are outside the space.

The index holds, for each term, postings in blocks of BLOCK examples and each block's greatest weight, as sorted arrays in the
shared folder that workers map into memory. Terms of one in COMMON examples or more are full columns instead: their part of
the cosines is a product of matrices for some documents at a time, and adds its greatest value of a block to the bound. A
document's blocks are visited by falling upper bound until no block can hold one of the NEIGHBOURS nearest, so the cosine
ranking is exact. The vote is the mean label of the neighbours weighted by cosine. A
logistic curve turns votes into scores; it is fitted on the examples, each voted on by the others and classes weighted by
their share of all labels. A document without neighbours gets the toxic share among such examples (of all labels, if there
are none).

Defined cases: null and empty texts have no term; very long texts are one vector like others; without any label of class 1 or
0 all scores are the share of class 1 (0 if there are no labels); repeated rows are scored alike; neighbours of equal cosine
(to 12 digits) are taken by their place in the index; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._core import U64, SortedStore, bucket_bits, build_store, cuts, join_arrays, merge_by_bucket, open_array, pick, rewrite_rows, save_array, settled, sliced
from .suffixes import ragged

PER_CLASS, NEIGHBOURS, BLOCK, COMMON = 2000, 15, 32, 16
#: Chi-square that a term without association exceeds once in twenty.
CHANCE = 3.84
#: Weight of the pull to 0 of the curve.
PULL = 1e-2
MB_EACH = 64.0
#: What is between words, which are runs of letters, numerals and low lines.
BETWEEN = r"[^\p{L}\p{N}_]+"
#: Rows whose words are looked up together, and documents of one product of matrices.
ROWS, TOGETHER = 500, 250


def tallies(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Hashes of the distinct words of some texts; for each text its words as places among them, and their numbers."""
    lower = pc.utf8_lower(pc.fill_null(column.cast(pa.string()), ""))
    split = pc.split_pattern_regex(lower, pattern=BETWEEN)
    flat = pc.dictionary_encode(split.flatten().cast(pa.binary()))
    distinct = flat.dictionary.to_pylist()
    words = np.repeat(np.arange(len(split)), np.diff(split.offsets.to_numpy())) * max(len(distinct), 1) + flat.indices.to_numpy(zero_copy_only=False)
    if b"" in distinct:  # before the first and after the last word
        words = words[words % len(distinct) != distinct.index(b"")]
    words, times = np.unique(words, return_counts=True)
    row, code = np.divmod(words, max(len(distinct), 1))
    at = np.searchsorted(row, np.arange(len(split) + 1)).tolist()
    parts = [slice(x, y) for x, y in zip(at, at[1:], strict=False)]
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), U64, len(distinct)), [code[x] for x in parts], [times[x] for x in parts]


def association(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """Chi-square with Yates' correction, beyond CHANCE, of terms in so many clean and toxic examples."""
    n = n_clean + n_toxic
    gap = np.maximum(np.abs(clean * float(n_toxic) - toxic * float(n_clean)) - n / 2, 0.0)
    held = (clean + toxic).astype(np.float64)
    return np.maximum(n * gap * gap / np.maximum(held * (n - held) * n_clean * n_toxic, 1.0) - CHANCE, 0.0)


@dataclass(frozen=True)
class Space:
    """Terms (hashes, sorted) with their weights `w`."""

    terms: SortedStore

    def vectors(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each text the places of its terms, in order, and their weights as a unit vector."""
        hashes, which, times = tallies(column)
        place = self.terms.index(hashes)
        weight = self.terms.field("w", place, np.float64)
        for own, n in zip(which, times, strict=True):
            w = weight[own] * (1.0 + np.log(n))
            keep = np.flatnonzero(w > 0)  # unknown terms, and those in all documents
            t, w = place[own[keep]], w[keep]
            order = np.argsort(t)
            yield t[order], w[order] / np.sqrt((w * w).sum())


def index_arrays(term: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_terms: int, n_docs: int) -> dict[str, np.ndarray]:
    """Postings of terms 0 .. n_terms - 1 by term and block: for each term where its blocks begin; for each block its number,
    greatest weight and first posting. Common terms have a number of a column (others: -1) and no postings."""
    order = np.lexsort((doc, term))
    term, doc, weight = term[order], doc[order], weight[order]
    common = np.flatnonzero(np.bincount(term, minlength=n_terms) * COMMON >= max(n_docs, 1))
    column = np.full(n_terms, -1, np.int32)
    column[common] = np.arange(len(common))
    full = column[term] >= 0
    columns = np.zeros((len(common), -(-n_docs // BLOCK) * BLOCK))
    columns[column[term[full]], doc[full]] = weight[full]
    term, doc, weight = term[~full], doc[~full], weight[~full]
    block = doc // BLOCK
    new = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))) if len(doc) else np.empty(0, np.int64)
    return {
        "column": column, "columns": columns, "blocks": np.searchsorted(term[new], np.arange(n_terms + 1)), "block": block[new].astype(np.int32),
        "most": np.maximum.reduceat(weight, new) if len(new) else weight, "first": np.append(new, len(doc)), "doc": doc.astype(np.int32), "weight": weight,
    }


@dataclass(frozen=True)
class BlockMaxIndex:
    """Index arrays in the folder of the terms, by bucket of terms."""

    terms: SortedStore
    n: int

    def _of(self, name: str, bucket: int) -> np.ndarray:
        return open_array(self.terms.uri, f"i{name}.{bucket}")

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each vector the k examples of greatest cosine above 0 and their cosines; `without` names one to leave out for each."""
        offsets = self.terms.offsets
        for low in range(0, len(vectors), TOGETHER):
            part = vectors[low : low + TOGETHER]
            at = [np.searchsorted(t, offsets) for t, _ in part]
            base = np.zeros((len(part), -(-self.n // BLOCK) * BLOCK))
            rare: list[list[tuple]] = [[] for _ in part]
            for b in np.flatnonzero(np.diff(np.array(at), axis=1).any(axis=0)).tolist():
                column, columns = self._of("column", b), self._of("columns", b)
                own = np.zeros((len(part), len(columns)))
                for i, (t, w) in enumerate(part):
                    local, y = t[at[i][b] : at[i][b + 1]] - offsets[b], w[at[i][b] : at[i][b + 1]]
                    c = column[local]
                    full = c >= 0
                    own[i, c[full]] = y[full]
                    rare[i].append((b, local[~full], y[~full]))
                if len(columns):
                    base += own @ columns
            for i in range(len(part)):
                yield self._nearest(base[i], rare[i], k, -1 if without is None else without[low + i])

    def _nearest(self, base: np.ndarray, rare: list[tuple], k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        """base: what common terms give each example; rare: by bucket the other terms and their weights."""
        bound = base.reshape(-1, BLOCK).max(axis=1)
        parts = []  # by bucket: blocks, first postings, sizes, weights of the text
        for b, local, w in rare:
            begin, first = self._of("blocks", b), self._of("first", b)
            low = begin[local]
            count = begin[local + 1] - low
            entry, y = ragged(low, count), np.repeat(w, count)
            block = self._of("block", b)[entry]
            bound = bound + np.bincount(block, y * self._of("most", b)[entry], len(bound))
            low = first[entry]
            parts.append((b, block, low, first[entry + 1] - low, y))
        best_d, best_c = np.empty(0, np.int64), np.empty(0)
        order = np.argsort(-bound, kind="stable")
        for some in (order[:8], order[8:]):  # the second time, what the first leaves possible
            least = best_c[-1] - 1e-9 if len(best_c) == k else 0.0
            some = some[(bound[some] > 0) & (bound[some] >= least)]
            if not len(some):
                break
            visited = np.zeros(len(bound), bool)
            visited[some] = True
            scores = np.where(np.repeat(visited, BLOCK), base, 0.0)
            for b, block, low, size, y in parts:
                mine = visited[block]
                postings = ragged(low[mine], size[mine])
                scores += np.bincount(self._of("doc", b)[postings], np.repeat(y[mine], size[mine]) * self._of("weight", b)[postings], len(scores))
            if without >= 0:
                scores[without] = 0
            hit = np.flatnonzero(scores > max(least, 0.0))
            best_d, best_c = np.append(best_d, hit), np.append(best_c, scores[hit])
            top = np.lexsort((best_d, -np.round(best_c, 12)))[:k]
            best_d, best_c = best_d[top], best_c[top]
        return best_d, best_c


def calibration(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve by Newton's method; a slight pull to 0 keeps separable votes finite."""
    x, b = np.column_stack([np.ones(len(votes)), votes]), np.zeros(2)
    loss = lambda b: (weights * (np.logaddexp(0, x @ b) - labels * (x @ b))).sum() + PULL * (b @ b) / 2
    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ b, -500, 500)))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + PULL * np.eye(2), x.T @ (weights * (labels - p)) - PULL * b)
        while loss(b + step) > loss(b) and np.abs(step).max() > 1e-12:
            step /= 2
        b = b + step
        if np.abs(step).max() < 1e-10:
            break
    return float(b[0]), float(b[1])


@dataclass(frozen=True)
class Model:
    space: Space | None  # none: without labels of both classes
    index: BlockMaxIndex | None
    ids: np.ndarray  # of the examples, by their place in the index
    labels: np.ndarray
    curve: tuple[float, float]
    no_evidence: float
    neighbours: int = NEIGHBOURS

    def votes(self, column: pa.Array, without: list[int] | None = None) -> Iterator[tuple[float, np.ndarray]]:
        """The vote of each text, -1 where there are no neighbours, and the neighbours."""
        for d, c in self.index.nearest(list(self.space.vectors(column)), self.neighbours, without):
            yield (float((c * self.labels[d]).sum() / c.sum()) if len(d) else -1.0), d

    def score(self, column: pa.Array) -> tuple[list[float], list[list[int]]]:
        """Scores, and the ids of the neighbours, the nearest first."""
        if self.space is None:
            return [self.no_evidence] * len(column), [[] for _ in range(len(column))]
        found = list(self.votes(column))
        votes = np.array([v for v, _ in found])
        scores = np.where(votes < 0, self.no_evidence, 1.0 / (1.0 + np.exp(-(self.curve[0] + self.curve[1] * votes))))
        return scores.tolist(), [self.ids[d].tolist() for _, d in found]


def _space(docs: DataFrame, examples: DataFrame, n_clean: int, n_toxic: int) -> Space:
    """The examples' terms, weighted by all documents."""
    bits = bucket_bits(examples, MB_EACH, least=0)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROWS):
            hashes, which, _ = tallies(batch.column(1))
            toxic = np.array(batch.column(2).to_pylist(), bool)
            counts = [np.bincount(np.concatenate([which[i] for i in np.flatnonzero(m)] or [np.empty(0, np.int64)]), minlength=len(hashes)) for m in (~toxic, toxic)]
            order = np.argsort(hashes)
            at = cuts(hashes[order], bits)
            full = np.flatnonzero(np.diff(at))
            parts = [order[at[b] : at[b + 1]] for b in full]
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *[pa.array([v[p].tobytes() for p in parts], pa.binary()) for v in (hashes, *counts)]], names=["bucket", "keys", "clean", "toxic"])

    def merge(rows: list[dict]) -> tuple:
        keys = join_arrays(rows, "keys", U64)
        own, back = np.unique(keys, return_inverse=True)
        return own, {n: np.bincount(back, join_arrays(rows, n, np.int64), len(own)) for n in ("clean", "toxic")}

    terms = build_store(examples.mapInArrow(scatter, "bucket int, keys binary, clean binary, toxic binary"), bits, "terms", merge)
    first = terms.offsets
    n_docs = docs.count()

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(terms), np.int64)
        for batch in sliced(batches, ROWS):
            hashes, which, _ = tallies(batch.column(0))
            place = terms.index(hashes)
            n = np.bincount(np.concatenate(which), minlength=len(hashes))
            held[place[place >= 0]] += n[place >= 0]
        seen = np.flatnonzero(held)
        for low in range(0, len(seen), 1 << 16):
            part = seen[low : low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(held[part])], names=["place", "n"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, n = (batch.column(i).to_numpy() for i in (0, 1))
            order = np.argsort(place)
            at = np.searchsorted(place[order], first)
            full = np.flatnonzero(np.diff(at))
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *[pa.array([v[order[at[b] : at[b + 1]]].tobytes() for b in full], pa.binary()) for v in (place, n)]], names=["bucket", "place", "n"])

    def weigh(bucket: int, rows: list[dict]) -> Iterator[dict]:
        place, n = join_arrays(rows, "place", np.int64) - first[bucket], join_arrays(rows, "n", np.int64)
        held = np.bincount(place, n, terms.sizes[bucket])
        clean, toxic = (open_array(terms.uri, f"{x}.{bucket}") for x in ("clean", "toxic"))
        save_array(terms.uri, f"w.{bucket}", np.log(n_docs / np.maximum(held, 1.0)) * np.sqrt(1.0 + association(clean, toxic, n_clean, n_toxic)))
        yield {"bucket": bucket}

    counted = docs.select("text").mapInArrow(occurrences, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    merge_by_bucket(counted.mapInArrow(deal, "bucket int, place binary, n binary"), bits, weigh, "bucket int").collect()
    return Space(terms)


def _index(examples: DataFrame, space: Space) -> tuple[BlockMaxIndex, np.ndarray, np.ndarray]:
    """The index, and its examples' ids and labels."""
    terms = space.terms
    first = terms.offsets

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROWS):
            lead = [int(t[w.argmax()]) if len(t) else -1 for t, w in space.vectors(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lead, pa.int64())], names=["doc_id", "toxic", "lead"])

    # 2 x PER_CLASS rows at most; alike ones share blocks
    known = sorted(examples.mapInArrow(leads, "doc_id long, toxic int, lead long").collect(), key=lambda r: (r["lead"], r["toxic"], r["doc_id"]))
    ids = np.array([r["doc_id"] for r in known], np.int64)
    by_id = np.argsort(ids)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROWS):
            own = by_id[np.searchsorted(ids[by_id], batch.column(0).to_numpy())]
            found = list(space.vectors(batch.column(1)))
            term, weight = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            doc = np.repeat(own, [len(t) for t, _ in found])
            order = np.argsort(term, kind="stable")
            at = np.searchsorted(term[order], first)
            full = np.flatnonzero(np.diff(at))
            parts = [order[at[b] : at[b + 1]] for b in full]
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *[pa.array([v[p].tobytes() for p in parts], pa.binary()) for v in (term, doc, weight)]], names=["bucket", "term", "doc", "weight"])

    def write(bucket: int, rows: list[dict]) -> Iterator[dict]:
        got = index_arrays(join_arrays(rows, "term", np.int64) - first[bucket], join_arrays(rows, "doc", np.int64), join_arrays(rows, "weight", np.float64), terms.sizes[bucket], len(ids))
        for name, values in got.items():
            save_array(terms.uri, f"i{name}.{bucket}", values)
        yield {"bucket": bucket}

    def bare(bucket: int) -> None:
        for name, values in index_arrays(*(np.empty(0, k) for k in (np.int64, np.int64, np.float64)), terms.sizes[bucket], len(ids)).items():
            save_array(terms.uri, f"i{name}.{bucket}", values)

    written = {r["bucket"] for r in merge_by_bucket(examples.mapInArrow(scatter, "bucket int, term binary, doc binary, weight binary"), terms.bits, write, "bucket int").collect()}
    for b in set(range(1 << terms.bits)) - written:  # all weights there are 0
        bare(b)
    return BlockMaxIndex(terms, len(ids)), ids, np.array([r["toxic"] for r in known], np.float64)


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, neighbours: int = NEIGHBOURS) -> Model:
    """labels(doc_id, toxic) are those to learn from."""
    labels = pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    nothing = np.empty(0, np.int64)
    empty = Model(None, None, nothing, np.empty(0), (0.0, 0.0), share)
    if not sizes.get(0) or not sizes.get(1):
        return empty
    chosen = [labels.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    sample = docs.sparkSession.createDataFrame([tuple(r) for c in chosen for r in c.collect()], "doc_id long, toxic int")  # 2 x per_class rows at most
    docs = pick(docs, "doc_id", "text")
    docs = docs.select(docs.doc_id.cast("long"), docs.text.cast("string"))
    taught = docs.where("text is not null").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))
    examples = settled(taught, "examples")
    taught_sizes = {r["toxic"]: r["n"] for r in examples.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not taught_sizes.get(0) or not taught_sizes.get(1):
        return empty
    space = _space(docs, examples, taught_sizes[0], taught_sizes[1])
    index, ids, y = _index(examples, space)
    model = Model(space, index, ids, y, empty.curve, share, neighbours)
    by_id = np.argsort(ids)

    def by_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROWS):
            own = by_id[np.searchsorted(ids[by_id], batch.column(0).to_numpy())].tolist()
            votes = [v for v, _ in model.votes(batch.column(1), own)]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(votes, pa.float64())], names=["toxic", "vote"])

    voted = examples.repartition(16, "doc_id").mapInArrow(by_others, "toxic int, vote double").collect()  # a row an example
    label = np.array([r["toxic"] for r in voted], np.float64)
    votes = np.array([r["vote"] for r in voted])
    weight = np.where(label == 1, sizes[1] / taught_sizes[1], sizes[0] / taught_sizes[0])
    lone, seen = votes < 0, votes >= 0
    no_evidence = float((weight * label)[lone].sum() / weight[lone].sum()) if lone.any() else share
    curve = calibration(votes[seen], label[seen], weight[seen]) if seen.any() else empty.curve
    return Model(space, index, ids, y, curve, no_evidence, neighbours)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, evidence array<long>: the nearest labelled documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROWS):
            scores, evidence = model.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

    docs = pick(docs, "doc_id", "text")
    return docs.select(docs.doc_id.cast("long"), docs.text.cast("string")).mapInArrow(run, "doc_id long, score double, evidence array<long>")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The documents whose score is below the threshold."""

    def change(batch: pa.RecordBatch, _: int, at_text: int) -> pa.RecordBatch:
        keep = [s < threshold for part in sliced([batch], ROWS) for s in model.score(part.column(at_text))[0]]
        return batch.filter(pa.array(keep, pa.bool_()))

    return rewrite_rows(docs, change)
