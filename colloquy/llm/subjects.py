"""Subject areas of documents.

Method: a latent Dirichlet topic model fitted over the whole corpus.  The unit that takes a topic is
the sentence (all its terms share one), documents have Dirichlet proportions over topics, topics
have distributions over hashed terms of a fixed number of buckets.  There are several topics a
subject and some more, so that one subject's topics can divide by language or theme.  They start on
a bounded number of labelled documents and the subjects' scope notes, each using topics set aside for its subjects, and are then
re-estimated from the sums of passes over all documents alone: what a topic is about comes out of
the corpus.  Afterwards each topic's top terms are inspected: it stands for the subject whose
labelled documents hold those terms, or for none if no subject has a clear share of them.

A document gets a subject if that subject's topics are the likely ones of at least ``SENTENCES``
sentences.

Scale: texts are cut into term ids once, in a table in the shared folder that all passes read.  A
pass sends at most BUCKETS rows of sums a task, with a number of tasks set by the cluster and not by
the corpus, and brings BUCKETS x topics numbers to the driver.  Smoothing is a share of a topic's
mass, so that the model is the same for a corpus of any size.  Nulls, empty texts and texts without
letters have no subject; an empty table gives no rows; documents that share a doc_id are read one by
one.  Whole texts are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize

BUCKETS = 1 << 16
#: Topics a subject, and topics beside those.
PARTS, BACKGROUND = 3, 2
SENTENCES = 3
PASSES = 1
#: Most labelled documents (those of least hash) on which the topics start and are inspected.
LABELS = 5_000
#: Dirichlet weight of a topic in a document; of all terms in a topic, as a share of its mass; and
#: share of a topic's prior that is what the topics begun for the same subject have in common.
ALPHA, ETA, COMMON = 0.02, 0.1, 0.2
#: Weight of a topic beside the subjects' at the start, against 1 for all topics of a subject.
REST = 0.1
#: A sentence is of a subject if its topics have this posterior; a topic stands for the subject
#: that has this share of its top terms.
SURE, CLEAR, TOP = 0.5, 0.5, 40

SPLIT = re.compile(r"[。！？!?；;\n\r]+|(?<=[a-zäöüß)%\d])\.(?=\s|$)|[~～](?=\s|$)")
TERM = re.compile(r"[一-鿿]+|[a-zà-ɏ]{2,}")
CODE = re.compile(r"[a-z]?\d[\da-z]*", re.I)
INVISIBLE = re.compile(r"[​-‏⁠﻿­]|[\U000e0000-\U000e007f]")


def _bucket(term: str, known: dict[str, int]) -> int:
    got = known.get(term)
    if got is None:
        h = 2166136261
        for b in term.encode():
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        got = (h ^ h >> 16) & BUCKETS - 1
        if len(known) > 400_000:
            known.clear()
        known[term] = got
    return got


def terms(sentence: str) -> list[str]:
    """Chinese two-character pieces and single words of other letters."""
    out: list[str] = []
    for m in TERM.findall(sentence.lower()):
        if m[0] >= "一":
            out += [m[i : i + 2] for i in range(len(m) - 1)] or [m]
        else:
            out.append(m)
    return out


def sentences(text: str | None) -> list[str]:
    if not text:
        return []
    return [s for s in SPLIT.split(INVISIBLE.sub("", text)) if s and s.strip()]


class Known:
    """Buckets of terms and of sentences seen by a worker, of bounded size."""

    def __init__(self):
        self.terms: dict[str, int] = {}
        self.sentences: dict[str, list[int]] = {}

    def cut(self, text: str | None) -> tuple[list[int], list[int]]:
        """(term buckets, terms of each sentence) of a text; sentences of one term are left out."""
        flat: list[int] = []
        sizes: list[int] = []
        for s in sentences(text):
            # Sentences repeat but for their numbers, so their buckets are kept, too.
            s = CODE.sub(" ", s)
            ids = self.sentences.get(s)
            if ids is None:
                ids = [_bucket(t, self.terms) for t in terms(s)]
                if len(s) <= 80:
                    if len(self.sentences) >= 100_000:
                        self.sentences.clear()
                    self.sentences[s] = ids
            if len(ids) >= 2:
                sizes.append(len(ids))
                flat += ids
        return flat, sizes


class Batch:
    """Sentences of a batch of documents: term buckets, flat, and each sentence's document."""

    def __init__(self, terms: np.ndarray, sizes: np.ndarray, owner: np.ndarray, documents: int):
        self.terms, self.lengths, self.owner, self.documents = terms.astype(np.int64), sizes.astype(np.int64), owner, documents
        self.starts = np.cumsum(self.lengths) - self.lengths

    @staticmethod
    def of(texts: list[str | None], known: Known) -> Batch:
        cut = [known.cut(t) for t in texts]
        join = lambda parts: np.array([x for p in parts for x in p], dtype=np.int64)
        return Batch(join(c[0] for c in cut), join(c[1] for c in cut), np.repeat(np.arange(len(cut)), [len(c[1]) for c in cut]), len(cut))

    @staticmethod
    def read(terms: pa.Array, sizes: pa.Array) -> Batch:
        """From the columns of the table of term ids."""
        count = lambda a: a.value_lengths().to_numpy(zero_copy_only=False)
        flat = lambda a: a.flatten().to_numpy(zero_copy_only=False)
        return Batch(flat(terms), flat(sizes), np.repeat(np.arange(len(sizes)), count(sizes)), len(sizes))

    def infer(self, log_beta: np.ndarray, allowed: np.ndarray | None = None, rounds: int = 4) -> np.ndarray:
        """(sentences, topics): expected topics; ``allowed`` restricts documents to topics."""
        k = log_beta.shape[1]
        if not len(self.starts):
            return np.zeros((0, k))
        like = np.add.reduceat(log_beta[self.terms], self.starts, axis=0).astype(np.float64)
        if allowed is not None:
            like = np.where(allowed[self.owner], like, -1e9)
        theta = np.full((self.documents, k), 1.0 / k)
        resp = np.zeros_like(like)
        first = np.flatnonzero(np.diff(self.owner, prepend=-1))
        for _ in range(rounds):
            resp = like + np.log(theta)[self.owner]
            resp -= resp.max(axis=1, keepdims=True)
            np.exp(resp, out=resp)
            resp /= resp.sum(axis=1, keepdims=True)
            theta = np.full((self.documents, k), ALPHA)
            theta[self.owner[first]] += np.add.reduceat(resp, first, axis=0)
            theta /= theta.sum(axis=1, keepdims=True)
        return resp

    def sums(self, resp: np.ndarray, into: np.ndarray) -> None:
        """Add each sentence's expected topics to the rows of its terms; shares under a thousandth
        are left out of a sentence's sums."""
        k = into.shape[1]
        at, topic = np.nonzero(resp >= 1e-3)
        sizes = self.lengths[at]
        if not len(sizes):
            return
        inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        cell = self.terms[np.repeat(self.starts[at], sizes) + inner] * k + np.repeat(topic, sizes)
        np.add.at(into.reshape(-1), cell, np.repeat(resp[at, topic], sizes).astype(into.dtype))


def log_topics(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of the terms in each topic.  All smoothing is by shares of a topic's mass."""
    mass = np.maximum(counts.sum(axis=0, keepdims=True), 1.0)
    b = counts / mass + ETA / len(counts)
    first = counts.shape[1] - BACKGROUND
    for at in range(0, first, PARTS):
        own = counts[:, at : at + PARTS]
        b[:, at : at + PARTS] += COMMON * (own.sum(axis=1) / max(own.sum(), 1.0))[:, None]
    return np.log(b / b.sum(axis=0, keepdims=True)).astype(np.float32)


def seed(batch: Batch, labels: np.ndarray, rounds: int = 8) -> np.ndarray:
    """(BUCKETS, topics) sums of labelled documents, each restricted to topics of its subjects and the
    background.  labels: (documents, subjects) of bool."""
    areas = labels.shape[1]
    k = areas * PARTS + BACKGROUND
    allowed = np.ones((batch.documents, k), dtype=bool)
    allowed[:, : areas * PARTS] = np.repeat(labels, PARTS, axis=1)
    # Every subject starts alike, divided at random over its topics, so that these part.
    rng = np.random.default_rng(11)
    part = rng.random((len(batch.owner), PARTS)) + 0.01
    part /= part.sum(axis=1, keepdims=True)
    rest = REST * (0.9 + 0.2 * rng.random((len(batch.owner), BACKGROUND)))
    resp = np.concatenate([np.tile(part, (1, areas)), rest], axis=1) * allowed[batch.owner]
    resp /= np.maximum(resp.sum(axis=1, keepdims=True), 1e-12)
    counts = np.zeros((BUCKETS, k), dtype=np.float64)
    batch.sums(resp, counts)
    for i in range(rounds):
        # The last rounds let go of the labels, as some are wrong and some sentences are in passing.
        resp = batch.infer(log_topics(counts), allowed if i < rounds - 2 else None)
        counts[:] = 0
        batch.sums(resp, counts)
    return counts


def inspect(counts: np.ndarray, batch: Batch, labels: np.ndarray) -> list[int | None]:
    """The subject of each topic: that of the labelled documents which hold its top terms.

    A topic's top terms are those of the highest probability times lift over the other topics.
    """
    areas = labels.shape[1]
    owner = np.repeat(batch.owner, batch.lengths)
    held = np.stack([np.bincount(batch.terms, weights=labels[owner, a], minlength=BUCKETS) for a in range(areas)], axis=1)
    seen = np.bincount(batch.terms, minlength=BUCKETS).astype(np.float64)
    log_beta = log_topics(counts).astype(np.float64)
    beta = np.exp(log_beta)
    weight = beta * np.maximum(log_beta - np.log(beta.mean(axis=1, keepdims=True)), 0.0)
    out: list[int | None] = []
    for t in range(counts.shape[1]):
        known = np.where(seen > 0, weight[:, t], 0.0)
        top = np.argsort(-known, kind="stable")[:TOP]
        total = known[top].sum()
        share = (known[top, None] * held[top] / np.maximum(seen[top, None], 1.0)).sum(axis=0) / total if total > 0 else np.zeros(areas)
        best = int(share.argmax()) if areas else 0
        out.append(best if areas and counts[:, t].sum() >= 1 and share[best] >= CLEAR else None)
    return out


def tally(b: Batch, log_beta: np.ndarray, subject: list[int | None], areas: int) -> np.ndarray:
    """(documents, areas): sentences whose likely topics are of each area."""
    of = np.zeros((len(subject), areas))
    for t, a in enumerate(subject):
        if a is not None:
            of[t, a] = 1.0
    mass = b.infer(log_beta) @ of
    got = np.zeros((b.documents, areas), dtype=np.int64)
    if len(mass) and areas:
        best = mass.argmax(axis=1)
        sure = mass[np.arange(len(best)), best] >= SURE
        np.add.at(got, (b.owner[sure], best[sure]), 1)
    return got


def term_ids(documents: DataFrame) -> DataFrame:
    """(doc_id, terms ARRAY<INT>, sizes ARRAY<INT>): texts as term buckets and sentence sizes, in the
    shared folder; texts without a sentence are left out."""

    def work(batches):
        known = Known()
        for b in batches:
            ids, cut = [], []
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = known.cut(text)
                if c[1]:
                    ids.append(d)
                    cut.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([c[0] for c in cut], pa.list_(pa.int32())), pa.array([c[1] for c in cut], pa.list_(pa.int32()))], ["doc_id", "terms", "sizes"])

    return materialize(documents.where("doc_id is not null and text <> ''").select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, terms array<int>, sizes array<int>"))


def labelled(ids: DataFrame, labels: DataFrame, areas: list[str], notes: list[str], most: int = LABELS) -> tuple[Batch, np.ndarray]:
    """Term ids and subjects of at most ``most`` labelled documents, those of least hash, and of the
    notes on each subject, which count as one more document of it."""
    own = labels.where(F.col("area_code").isin(areas) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.array_sort(F.collect_set("area_code")).alias("codes"))  # at most one of each area
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = ids.join(F.broadcast(own), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", F.size("terms"), F.hash("terms")).toArrow()
    codes = [*rows["codes"].to_pylist(), *[[a] for a in areas]]
    truth = np.array([[a in c for a in areas] for c in codes], dtype=bool).reshape(len(codes), len(areas))
    known = Known()
    cut = [known.cut(note) for note in notes]
    column = lambda name, i: pa.concat_arrays([*[c.cast(pa.list_(pa.int32())) for c in rows[name].chunks], pa.array([c[i] for c in cut], pa.list_(pa.int32()))])
    return Batch.read(column("terms", 0), column("sizes", 1)), truth


class Topics:
    """Fitted topics: ``ids`` the table of term ids, ``counts`` (BUCKETS, topics), ``subject`` the area of each topic or None."""

    def __init__(self, documents: DataFrame, labels: DataFrame, areas: dict[str, str], passes: int = PASSES, most: int = LABELS):
        """areas: a note on each area by its code."""
        self.areas = list(areas)
        self.ids = term_ids(documents)
        batch, truth = labelled(self.ids, labels, self.areas, list(areas.values()), most)
        self.counts = seed(batch, truth)
        for _ in range(passes):
            self.counts = self._pass(log_topics(self.counts))
        self.subject = inspect(self.counts, batch, truth)

    def _pass(self, log_beta: np.ndarray) -> np.ndarray:
        k = log_beta.shape[1]
        names = [f"t{i}" for i in range(k)]

        def work(batches):
            total = np.zeros(log_beta.shape, dtype=np.float32)
            for b in batches:
                for at in range(0, b.num_rows, 2000):
                    part = b.slice(at, 2000)
                    x = Batch.read(part.column(0), part.column(1))
                    x.sums(x.infer(log_beta), total)
            rows = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), *[pa.array(total[rows, i]) for i in range(k)]], ["bucket", *names])

        # So many tasks that the cores are busy: the sums sent don't grow with the corpus.
        tasks = 2 * self.ids.sparkSession.sparkContext.defaultParallelism
        sums = self.ids.select("terms", "sizes").coalesce(tasks).mapInArrow(work, "bucket int, " + ", ".join(f"{n} float" for n in names))
        sums = sums.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
        counts = np.zeros(log_beta.shape, dtype=np.float64)
        if len(sums):
            counts[sums["bucket"].to_numpy()] = np.stack([sums[n].to_numpy() for n in names], axis=1)
        return counts

    def assign(self, least: int = SENTENCES) -> DataFrame:
        """(doc_id, area_code, sentences): subjects with at least ``least`` sentences."""
        log_beta, subject, areas = log_topics(self.counts), self.subject, self.areas
        names = np.array(areas, dtype=object)

        def work(batches):
            for b in batches:
                for at in range(0, b.num_rows, 2000):
                    part = b.slice(at, 2000)
                    got = tally(Batch.read(part.column(1), part.column(2)), log_beta, subject, len(areas))
                    d, a = np.nonzero(got >= least)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d)), pa.array(names[a], pa.string()), pa.array(got[d, a].astype(np.int32))], ["doc_id", "area_code", "sentences"])

        return self.ids.mapInArrow(work, "doc_id long, area_code string, sentences int")

    def top_terms(self, documents: DataFrame, most: int = 15) -> DataFrame:
        """(topic, area_code, rank, term, weight): the terms that stand out in each topic, for
        inspection; area_code is null for a topic of no subject."""
        log_beta = log_topics(self.counts).astype(np.float64)
        k = log_beta.shape[1]
        lift = log_beta - np.log(np.exp(log_beta).mean(axis=1, keepdims=True))
        area = np.array([None if a is None else self.areas[a] for a in self.subject], dtype=object)

        def work(batches):
            for b in batches:
                seen: dict[str, int] = {}
                for text in b.column(0).to_pylist():
                    for s in sentences(text):
                        for t in terms(CODE.sub(" ", s)):
                            seen[t] = seen.get(t, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

        words = documents.where("text <> ''").select("text").mapInArrow(work, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))

        def score(batches):
            known: dict[str, int] = {}
            for b in batches:
                word = b.column(0).to_pylist()
                at = np.array([_bucket(t, known) for t in word], dtype=np.int64)
                w = np.exp(log_beta[at]) * lift[at] * np.log1p(b.column(1).to_numpy())[:, None]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(word, dtype=object), k), pa.string()), pa.array(np.tile(np.arange(k, dtype=np.int32), len(word))), pa.array(np.tile(area, len(word)), pa.string()), pa.array(w.ravel())], ["term", "topic", "area_code", "weight"])

        scored = words.mapInArrow(score, "term string, topic int, area_code string, weight double")
        # The best of each salt first, so that no topic's terms meet in one task.
        order = [F.col("weight").desc(), F.col("term")]
        for keys in (["topic", F.pmod(F.xxhash64("term"), F.lit(64))], ["topic"]):
            scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)
        return scored.select("topic", "area_code", "rank", "term", F.round("weight", 6).alias("weight"))


def area_notes(areas_table: DataFrame) -> dict[str, str]:
    """Name and scope note of each area, as far as the table has them."""
    texts = [F.coalesce(F.max(c), F.lit("")) for c in ("area_name", "scope_note") if c in areas_table.columns]
    rows = areas_table.where("area_code is not null").groupBy("area_code").agg(F.concat_ws(". ", *texts).alias("note")).orderBy("area_code").collect()  # the fixed table of areas
    return {r["area_code"]: r["note"] for r in rows}


def subjects(documents: DataFrame, labels: DataFrame, areas_table: DataFrame) -> DataFrame:
    areas = area_notes(areas_table)
    if not areas:
        return documents.select(F.col("doc_id").cast("long"), F.lit("").alias("area_code"), F.lit(0).alias("sentences")).where("false")
    return Topics(documents, labels, areas).assign()
