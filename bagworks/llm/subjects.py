"""Subject areas of documents: classifier chains decoded by beam search.

1. Runs of cells that occur in several different documents are copied blocks: the hashes of all windows of some cells in a row are
   counted over all documents, whole copies of a document counting once, changed ones too.
2. From labelled documents (at most `train_docs`, the lowest by hash) the subjects' terms are learned: words, column names and
   values that go with one subject wherever they stand, outside copied blocks. Over all documents, those that hold several terms of
   a subject then lend their subjects to the words that keep company with them, so languages and spellings that few labelled
   documents have are known too.
3. A document's features are, for each subject, how many distinct terms of it stand in prose, code, outputs and copied blocks, its
   source and its structure.
4. A chain of logistic classifiers, one a subject, each of which sees the labels before it, gives the probability of a label
   combination; its scale is calibrated on held-out documents. Beam search finds the most probable combination.

Only the model (bounded by `train_docs` and `max_terms`) is sent to the tasks; the copied windows' hashes are sent up to
`copied_rows`, and beyond that joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagworks.llm.arrays import column, lists, slices
from bagworks.llm.cells import WINDOW, cells_of, fingerprint, spans_of, windows, words
from bagworks.operators.skew import salted_join
from bagworks.session import materialize

#: Labelled documents and terms that the model is fitted on; different documents from which on a window is copied.
TRAIN_DOCS, MAX_TERMS, COPIES = 20_000, 20_000, 4
#: Sources that have a feature of their own, the leading ones of the labelled documents; the others share one.
MAX_SOURCES = 200
#: Copied windows whose hashes are sent to every task (8 bytes each).
COPIED_ROWS = 500_000
#: Share of the cells of prose and code, of the longer of two documents, that stand alike in the same place (from the start or the end) of
#: changed copies of one notebook, and the rounds in which they are grouped.
ALIKE, ROUNDS = 0.6, 6
BEAM = 8

_REGIONS = {"m": 0, "c": 1, "o": 2}
_DOC = ["doc_id", "text", "source", "fmt", "cells"]


def clean_source(s: str | None) -> str:
    """One spelling of a source's name: lower case, no outer blanks, '-' as separator."""
    return "-".join((s or "").lower().replace("_", " ").replace("-", " ").split())


_DIGEST = "doc_id bigint, source string, cls bigint, shape array<double>, regions array<int>, prints array<bigint>, wins array<bigint>, words array<string>, word_cell array<int>"


def digest(docs: DataFrame) -> DataFrame:
    """What the operator reads of each document, in one pass over its whole text: source, hash of the text, its cells' numbers by kind
    and its length, its cells' regions, the hashes of its cells of prose and code and of its windows, and every cell's distinct words.
    Empty texts give no row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, texts, sources, forms = (b.column(i).to_pylist() for i in range(4))
            rows = {c: [] for c in ("cls", "shape", "regions", "prints", "wins", "words", "word_cell")}
            for text, fmt, spans in zip(texts, forms, spans_of(b)):
                cells = list(cells_of(text, spans, fmt))
                kinds = [_REGIONS[r] for r, _ in cells]
                met = [(w, i) for i, (_, s) in enumerate(cells) for w in sorted(words(s))]
                rows["cls"].append(fingerprint(text))
                rows["shape"].append([float(kinds.count(k)) for k in range(3)] + [float(len(text))])
                rows["regions"].append(kinds)
                prints = [fingerprint(s) for _, s in cells]
                rows["prints"].append([f for f, (r, _) in zip(prints, cells) if r != "o"])
                rows["wins"].append(windows(prints))
                rows["words"].append([w for w, _ in met])
                rows["word_cell"].append([i for _, i in met])
            types = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32())]
            arrays = [pa.array(ids, pa.int64()), pa.array([clean_source(x) for x in sources], pa.string()), *[pa.array(v, t) for v, t in zip(rows.values(), types)]]
            yield pa.record_batch(arrays, names=["doc_id", "source", *rows])

    return docs.select(*_DOC).where("doc_id is not null and length(text) > 0").mapInArrow(read, _DIGEST)


def _hot(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col).limit(1000).select(col)


def near_copies(held: DataFrame, prints: DataFrame, *, alike: float = ALIKE, rounds: int = ROUNDS) -> DataFrame | None:
    """(cls, rep): the texts that are changed copies of another one, `rep`, which is in no row's cls; None if there are none.

    held: (cls, h) distinct, the windows of each text; prints: (cls, prints), its cells of prose and code in order, so neither outputs
    of another run nor another form tell copies apart. In a round each text is compared cell by cell with the first holder, in an
    order of that round, of each of its windows, and joins the first of those that it resembles; texts that joined one take no further
    part. So a group of any size costs rows in proportion to it, never its pairs.
    """
    known = None
    for r in range(rounds):
        first = materialize(held.groupBy("h").agg(F.min_by("cls", F.xxhash64(F.lit(r), "cls")).alias("to"), F.count(F.lit(1)).alias("n")).where("n > 1"))
        top = first.orderBy(F.desc("n"), "h").limit(1000).select("h")
        met = materialize(salted_join(held, first.select("h", "to"), ["h"], hot=top, salt_on=["cls"]).where("cls <> to").select("cls", "to").distinct())
        both = salted_join(met.join(prints, "cls"), prints.select(F.col("cls").alias("to"), F.col("prints").alias("other")), ["to"], hot=_hot(met, "to"), salt_on=["cls"])
        same = F.expr("size(filter(sequence(0, size(prints) - 1), i -> coalesce(get(prints, i) = get(other, i), false) or coalesce(get(prints, i) = get(other, size(other) - size(prints) + i), false)))")
        both = both.select("cls", "to", same.alias("same"), F.greatest(F.size("prints"), F.size("other")).alias("n")).where((F.col("same") > 0) & (F.col("same") >= F.lit(alike) * F.col("n")))
        best = materialize(both.groupBy("cls").agg(F.min_by("to", F.xxhash64(F.lit(r), "to")).alias("to")))
        if best.isEmpty():
            break
        # a text whose match joins another one itself waits for the next round; the first mover's match never does
        ends = best.select(F.col("cls").alias("to"), F.lit(True).alias("moves"))
        moved = materialize(salted_join(best, ends, ["to"], hot=_hot(best, "to"), how="left", salt_on=["cls"]).where("moves is null").select("cls", "to"))
        new = moved.select("cls", F.col("to").alias("rep"))
        if known is not None:
            old = salted_join(known, moved.select(F.col("cls").alias("rep"), "to"), ["rep"], hot=_hot(known, "rep"), how="left", salt_on=["cls"])
            new = old.select("cls", F.coalesce("to", "rep").alias("rep")).unionByName(new)
        known = materialize(new)
        held = materialize(held.join(moved.select("cls"), "cls", "left_anti"))
    return known


def copied_windows(read: DataFrame, copies: int = COPIES) -> DataFrame:
    """(h, docs): hashes of the windows of cells that at least `copies` different notebooks hold; the copies of one notebook, changed
    or not, count once."""
    # both stages combine on the map side, so a window that a third of all documents hold is counted in parts
    rows = read.select("cls", F.explode("wins").alias("h")).distinct()
    count = lambda df: df.groupBy("h").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= copies)
    found = materialize(count(rows))
    if found.isEmpty():
        return found
    top = found.orderBy(F.desc("docs"), "h").limit(1000).select("h")
    held = materialize(salted_join(rows, found.select("h"), ["h"], hot=top, how="left_semi", salt_on=["cls"]))
    prints = materialize(read.join(held.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.min("prints").alias("prints")))
    known = near_copies(held, prints)
    if known is None:
        return found
    return materialize(count(held.join(known, "cls", "left").select(F.coalesce("rep", "cls").alias("cls"), "h").distinct()))


class Rows:
    """A batch of the digest as flat arrays: for every word its document, region and whether it stands in a copied block."""

    def __init__(self, b: pa.RecordBatch, copied: np.ndarray | None):
        col = lambda c: b.column(b.schema.get_field_index(c))
        self.n = b.num_rows
        self.ids = column(b, "doc_id")
        cell_off, regions = lists(col("regions"))
        win_off, wins = lists(col("wins"))
        word_off, _ = lists(col("word_cell"))
        if copied is None:  # each document brings its copied windows along
            copied = np.unique(col("own_copied").flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        block = np.zeros(len(regions), bool)
        first = np.repeat(cell_off[:-1] - win_off[:-1], np.diff(win_off)) + np.arange(len(wins))
        hit = first[np.isin(wins, copied)]
        for i in range(WINDOW):
            block[hit + i] = True
        self.words = col("words").flatten()
        self.doc = np.repeat(np.arange(self.n), np.diff(word_off))
        cell = cell_off[self.doc] + col("word_cell").flatten().to_numpy(zero_copy_only=False)
        self.region, self.copied = regions[cell], block[cell]
        self.shape = np.array(col("shape").flatten()).reshape(self.n, 4)
        self.source = col("source").to_pylist()

    def counts(self, terms: dict[str, int], k: int) -> np.ndarray:
        """(documents, subjects, 5): distinct terms in own cells, in own prose, code and outputs, and in copied blocks."""
        at = pc.index_in(self.words, value_set=pa.array(list(terms), pa.string())).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        subject = np.array(list(terms.values()), np.int64)
        known = at >= 0
        t, d, r, c = at[known], self.doc[known], self.region[known], self.copied[known]
        slot = np.concatenate([np.where(c, 4, 0), 1 + r[~c]])
        t, d = np.concatenate([t, t[~c]]), np.concatenate([d, d[~c]])
        one = np.unique((d * 5 + slot) * max(len(terms), 1) + t)
        ds, t = one // max(len(terms), 1), one % max(len(terms), 1)
        flat = np.bincount((ds // 5 * k + subject[t]) * 5 + ds % 5, minlength=self.n * k * 5) if len(one) else np.zeros(self.n * k * 5, int)
        return flat.reshape(self.n, k, 5)


@dataclass
class Chain:
    """Classifiers in chain order over shared features."""

    subjects: list[str]
    terms: dict[str, int] = field(default_factory=dict)  # term -> subject number
    sources: list[str] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    order: list[int] = field(default_factory=list)
    scale: float = 1.0

    def source_numbers(self, names: list[str]) -> np.ndarray:
        at = {s: i for i, s in enumerate(self.sources)}
        return np.array([at.get(x, len(at)) for x in names], int)

    # features
    def shared(self, counts: np.ndarray, source: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """counts: (docs, subjects, 5): distinct terms in own cells, then in own prose, code and outputs, then in copied blocks."""
        hot = np.zeros((len(source), len(self.sources) + 1))
        hot[np.arange(len(source)), source] = 1
        return np.hstack([hot, np.log1p(shape)])

    def own(self, counts: np.ndarray, s: int) -> np.ndarray:
        c = counts[:, s, :].astype(float)
        u = c[:, 0]
        rest = np.delete(counts[:, :, 0], s, axis=1)
        top = rest.max(axis=1, initial=0)
        total = counts[:, :, 0].sum(axis=1)
        steps = np.stack([u >= k for k in (1, 2, 3, 4, 6, 9)], axis=1).astype(float)
        return np.hstack([steps, np.log1p(c), (u / np.maximum(total, 1))[:, None], (u >= top)[:, None], np.log1p(top)[:, None]])

    def features(self, counts, shared, s: int, before: np.ndarray) -> np.ndarray:
        return np.hstack([self.own(counts, s), shared, before, np.ones((len(shared), 1))])

    def logits(self, x: np.ndarray, place: int) -> np.ndarray:
        return self.scale * (x @ self.weights[place])

    def decode(self, counts, source, shape, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(docs, subjects) labels of the most probable combination that the beam keeps, and its log probability."""
        n, k = len(source), len(self.subjects)
        shared = self.shared(counts, source, shape)
        labels, score = np.zeros((n, 1, k)), np.zeros((n, 1))
        for place, s in enumerate(self.order):
            width = labels.shape[1]
            z = np.empty((n, width))
            for b in range(width):
                z[:, b] = self.logits(self.features(counts, shared, s, labels[:, b, :]), place)
            yes, no = -np.logaddexp(0, -z), -np.logaddexp(0, z)
            score = np.concatenate([score + no, score + yes], axis=1)
            with_s = labels.copy()
            with_s[:, :, s] = 1
            labels = np.concatenate([labels, with_s], axis=1)
            if labels.shape[1] > beam:
                best = np.argsort(-score, axis=1, kind="stable")[:, :beam]
                score = np.take_along_axis(score, best, axis=1)
                labels = np.take_along_axis(labels, best[:, :, None], axis=1)
        top = score.argmax(axis=1)
        return labels[np.arange(n), top], score[np.arange(n), top]

    # fitting
    def fit(self, counts, source, shape, y: np.ndarray, l2: float = 1.0) -> None:
        """y: (docs, subjects) of 0 and 1. A fifth of the documents is held out to calibrate the scale, then all are used."""
        self.order = sorted(range(len(self.subjects)), key=lambda s: (-y[:, s].sum(), s))
        held = np.arange(len(y)) % 5 == 4
        if held.sum() >= 20 and (~held).sum() >= 20:
            self._fit(counts[~held], source[~held], shape[~held], y[~held], l2)
            x, t = self._teacher(counts[held], source[held], shape[held], y[held])
            grid = np.geomspace(0.25, 4, 25)
            loss = [np.logaddexp(0, np.where(t == 1, -1, 1) * g * x).sum() for g in grid]
            self.scale = float(grid[int(np.argmin(loss))])
        scale, self.scale = self.scale, 1.0
        self._fit(counts, source, shape, y, l2)
        self.scale = scale

    def _fit(self, counts, source, shape, y, l2) -> None:
        shared = self.shared(counts, source, shape)
        # all subjects share how evidence counts; each link departs from that as far as its own documents ask for
        x = np.concatenate([np.hstack([self.own(counts, s), np.ones((len(y), 1))]) for s in self.order])
        pooled = _logistic(x, np.concatenate([y[:, s] for s in self.order]), l2)
        self.weights = []
        for place, s in enumerate(self.order):
            before = np.zeros_like(y)
            before[:, self.order[:place]] = y[:, self.order[:place]]
            x = self.features(counts, shared, s, before)
            prior = np.zeros(x.shape[1])
            prior[: len(pooled) - 1], prior[-1] = pooled[:-1], pooled[-1]
            self.weights.append(_logistic(x, y[:, s], 4 * l2, prior))

    def _teacher(self, counts, source, shape, y):
        shared, x, t = self.shared(counts, source, shape), [], []
        for place, s in enumerate(self.order):
            before = np.zeros_like(y)
            before[:, self.order[:place]] = y[:, self.order[:place]]
            x.append(self.features(counts, shared, s, before) @ self.weights[place])
            t.append(y[:, s])
        return np.concatenate(x), np.concatenate(t)


def _logistic(x: np.ndarray, y: np.ndarray, l2: float, prior: np.ndarray | None = None, steps: int = 40) -> np.ndarray:
    """Logistic regression shrunk to `prior` by damped Newton steps; the last column is the intercept, shrunk only with a prior."""
    mid = np.zeros(x.shape[1]) if prior is None else prior
    w = mid.copy()
    ridge = np.full(x.shape[1], l2)
    if prior is None:
        ridge[-1] = 1e-6
    loss = lambda v: np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ v)).sum() + 0.5 * (ridge * (v - mid) ** 2).sum()
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * (w - mid)
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge + 1e-9)
        step, t = np.linalg.solve(h, g), 1.0
        while t > 1e-4 and (new := loss(w - t * step)) > now:
            t /= 2
        if t <= 1e-4:
            break
        w, gain, now = w - t * step, now - new, new
        if gain < 1e-6:
            break
    return w


def _pure_terms(weights: DataFrame, subjects: list[str], min_docs: int, purity: float, max_terms: int) -> dict[str, int]:
    """term -> subject of (term, subject, w) rows: terms of at least `min_docs` documents of which more than `purity` have the subject."""
    per = weights.groupBy("term", "subject").agg(F.sum("w").alias("w"))
    best = per.groupBy("term").agg(F.sum("w").alias("n"), F.max(F.struct(F.col("w"), F.col("subject"))).alias("b"))
    best = best.where((F.col("n") >= min_docs - 1e-6) & (F.col("b.w") > F.col("n") * purity) & (F.col("b.subject") != ""))
    at = {s: i for i, s in enumerate(subjects)}
    top = best.orderBy(F.desc("n"), "term").limit(max_terms).select("term", "b.subject").collect()
    return {r[0]: at[r[1]] for r in top if r[1] in at}


def _term_weights(read: DataFrame, copied, subjects: list[str], labels_of) -> DataFrame:
    """(term, subject, w): each document gives each of its distinct words outside copied blocks one count, split evenly over its
    subjects, '' where it has none. `labels_of(batch, rows)` gives (documents, subjects) of 0 and 1 and which documents count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = Rows(b, copied())
            y, use = labels_of(b, rows)
            y = np.hstack([y, y.sum(axis=1, keepdims=True) == 0]).astype(float)
            y /= y.sum(axis=1, keepdims=True)
            own = ~rows.copied & use[rows.doc]
            code = pc.dictionary_encode(rows.words.filter(pa.array(own)))
            if not len(code):
                continue
            size = len(code.dictionary)
            one = np.unique(rows.doc[own] * size + code.indices.to_numpy(zero_copy_only=False))
            doc, word = one // size, one % size
            for i, s in enumerate([*subjects, ""]):
                w = np.bincount(word, weights=y[doc, i], minlength=size)
                at = np.flatnonzero(w)
                yield pa.record_batch([code.dictionary.take(pa.array(at)), pa.array([s] * len(at), pa.string()), pa.array(w[at])], names=["term", "subject", "w"])

    return read.mapInArrow(count, "term string, subject string, w double")


def _given(subjects: list[str]):
    def of(b: pa.RecordBatch, rows: Rows):
        given = b.column(b.schema.get_field_index("subjects")).to_pylist()
        return np.array([[s in (g or ()) for s in subjects] for g in given]), np.ones(len(given), bool)

    return of


def _by_company(seed, k: int, company: int):
    """Subjects of which a document holds `company` known terms and half of all that it knows, or twice as many and a quarter;
    documents without any are left out."""

    def of(b: pa.RecordBatch, rows: Rows):
        n = rows.counts(seed.value, k)[:, :, 0]
        total = n.sum(axis=1, keepdims=True)
        y = (n >= company) & (2 * n >= total) | (n >= 2 * company) & (4 * n >= total)
        return y, y.any(axis=1)

    return of


def assign_subjects(docs: DataFrame, labels: DataFrame, subjects: list[str], *, train_docs: int = TRAIN_DOCS, max_terms: int = MAX_TERMS, copies: int = COPIES, min_docs: int = 3, purity: float = 0.5, company: int = 2, rounds: int = 2, copied_rows: int = COPIED_ROWS, exclude: DataFrame | None = None) -> DataFrame:
    """(doc_id, subject, log_prob): the subjects of each document; none give no row. `rounds` 0 learns terms from labelled
    documents only.

    docs: doc_id, text, source, fmt, cells, others are ignored; labels: (doc_id, subject), null for a document about none;
    `subjects` is the fixed list of names. Null or empty texts have no subject. `exclude` (doc_id) keeps labelled documents out of
    the fit, to measure on them. Deterministic for the same rows.
    """
    spark = docs.sparkSession
    subjects = sorted(subjects)
    k = len(subjects)
    read = materialize(digest(docs))
    found = copied_windows(read, copies)
    few = found.limit(copied_rows + 1).count() <= copied_rows

    lab = labels.where("doc_id is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("subjects"))
    if exclude is not None:
        lab = lab.join(exclude.select("doc_id"), "doc_id", "left_anti")
    lab = materialize(lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs))

    if few:
        sent = spark.sparkContext.broadcast(np.sort(column(found.select("h").toArrow(), "h")))
        copied = lambda: sent.value
    else:  # too many to send: each document is given its own by a join
        hot = found.orderBy(F.desc("docs"), "h").limit(1000).select("h")
        met = salted_join(read.select("doc_id", F.explode("wins").alias("h")), found.select("h"), ["h"], hot=hot, salt_on=["doc_id"])
        read = materialize(read.join(met.groupBy("doc_id").agg(F.collect_set("h").alias("own_copied")), "doc_id", "left"))
        copied = lambda: None
    labelled = materialize(read.join(F.broadcast(lab), "doc_id"))  # at most train_docs documents

    model = Chain(subjects)
    model.sources = [r[0] for r in labelled.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(MAX_SOURCES).collect()]
    model.terms = _pure_terms(_term_weights(labelled, copied, subjects, _given(subjects)), subjects, min_docs, purity, max_terms)
    for _ in range(rounds if model.terms else 0):
        seed = spark.sparkContext.broadcast(model.terms)
        more = _pure_terms(_term_weights(read, copied, subjects, _by_company(seed, k, company)), subjects, 2 * min_docs, (1 + purity) / 2, max_terms)
        model.terms = more | model.terms
    known = spark.sparkContext.broadcast(model.terms)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows = Rows(b, copied())
                counts = rows.counts(known.value, k)
                yield pa.record_batch([
                    b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("subjects")),
                    pa.array(counts.reshape(rows.n, -1).tolist(), pa.list_(pa.int32())), pa.array(rows.source, pa.string()), pa.array(rows.shape.tolist(), pa.list_(pa.float64())),
                ], names=["doc_id", "subjects", "counts", "source", "shape"])

    rows = sorted(labelled.mapInArrow(train, "doc_id bigint, subjects array<string>, counts array<int>, source string, shape array<double>").collect(), key=lambda r: r["doc_id"])
    counts = np.array([r["counts"] for r in rows], int).reshape(-1, k, 5)
    seen = counts.sum(axis=(1, 2)) > 0  # a document without any term has no subject and teaches nothing
    if seen.any():
        y = np.array([[float(s in r["subjects"]) for s in subjects] for r in rows])
        model.fit(counts[seen], model.source_numbers([r["source"] for r in rows])[seen], np.array([r["shape"] for r in rows])[seen], y[seen])
    fitted = spark.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = fitted.value
        for b in batches:
            if not m.weights or not b.num_rows:
                continue
            rows = Rows(b, copied())
            counts = rows.counts(m.terms, k)
            some = np.flatnonzero(counts.sum(axis=(1, 2)) > 0)
            for part in np.array_split(some, max(1, -(-len(some) // 2000))):
                if len(part):
                    labels, score = m.decode(counts[part], m.source_numbers([rows.source[i] for i in part]), rows.shape[part])
                    at, s = np.nonzero(labels)
                    yield pa.record_batch([pa.array(rows.ids[part[at]], pa.int64()), pa.array([subjects[j] for j in s], pa.string()), pa.array(score[at])], names=["doc_id", "subject", "log_prob"])

    return read.mapInArrow(label, "doc_id bigint, subject string, log_prob double")
