"""Near-duplicate records: all pairs of at least a given similarity of character pieces.

Method: fast similarity sketching.  Round after round throws every piece of a record into a hashed
bin and keeps the least value of each bin; after the rounds that aim at random, one round for each
bin fills what is left, so every coordinate is filled, and coordinates of two records agree with the
probability of their similarity.  Coordinates are cut into bands; records that agree on a band are
candidates; candidates whose one-bit sketches differ too much are left out (4.5 standard deviations
below the threshold, a chance of 3 in a million); the rest is verified exactly on the texts.

With 42 bands of 6 coordinates a pair of similarity 0.75 is missed with a probability of 0.0003, one
of 0.8 with 10^-6.  Records of equal normalised text are one class, sketched once; pairs are between
class representatives and expanded at the end only where a query's form asks for all pairs.
Classes go by 64-bit numbers through the joins.  Band keys are joined with themselves, so hot keys are
split by the skew handling of the join.  Records with fewer than three characters have no piece and
no partner: equal ones are one class without links.  Nulls count as ''; records without key are left
out; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import components
from ..runtime import materialize

BANDS, ROWS, PIECE = 42, 6, 3
WORDS = 4  # of 64 one-bit coordinates
SIZE = 64 * WORDS
#: Standard deviations by which one-bit sketches may fall short.
SLACK = 4.5


def normalize(question: Column, answer: Column) -> Column:
    """Letters and digits of question and answer in lower case."""
    both = F.concat(F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit("")))
    return F.regexp_replace(F.lower(both), r"[^\p{L}\p{N}]+", "")


def pieces(text: str) -> set[str]:
    return {text[i : i + PIECE] for i in range(len(text) - PIECE + 1)}


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps on purpose."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def codes(text: str) -> np.ndarray:
    """The distinct pieces of a text, three code points packed into 63 bits: exact, not hashed."""
    c = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    return np.unique((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])


def sketches(texts: list[str], size: int = SIZE) -> np.ndarray:
    """(records, size) of uint64: the sketches of texts of at least three characters; size is a power of 2."""
    parts = [codes(t) for t in texts]
    owner = np.repeat(np.arange(len(parts), dtype=np.int64), [len(p) for p in parts])
    element = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(len(parts) * size, empty, dtype=np.uint64)
    for i in range(2 * size):
        h = _mix(element + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        at = owner * size + ((h & np.uint64(size - 1)).astype(np.int64) if i < size else i - size)
        # An earlier round wins, so that only bins still open take part.
        new = np.flatnonzero(out[at] == empty)
        np.minimum.at(out, at[new], (np.uint64(i) << np.uint64(48)) | (_mix(h[new]) >> np.uint64(16)))
        open_ = (out.reshape(-1, size) == empty).any(axis=1)
        if not open_.any():
            break
        still = open_[owner]
        if not still.all():
            owner, element = owner[still], element[still]
    return out.reshape(-1, size)


def _sketch_rows(batches):
    for pdf in batches:
        for at in range(0, len(pdf), 512):
            part = pdf.iloc[at : at + 512]
            s = sketches(list(part["norm"]))
            salt = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            key = np.broadcast_to(salt, (len(part), BANDS)).copy()
            for r in range(ROWS):
                key = _mix(key ^ s[:, r : BANDS * ROWS : ROWS])
            bits = (_mix(s[:, : 64 * WORDS]) & np.uint64(1)).reshape(len(part), WORDS, 64)
            words = (bits << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
            yield pd.DataFrame({"n": part["n"].values, "bands": list(key.view(np.int64)), "bits": list(words.view(np.int64))})


def _verify(least: float):
    def work(batches):
        for pdf in batches:
            keep = []
            for a, b, x, y in zip(pdf["a"], pdf["b"], pdf["norm_a"], pdf["norm_b"]):
                p, q = pieces(x), pieces(y)
                common = len(p & q)
                s = common / (len(p) + len(q) - common)
                if s >= least:
                    keep.append((a, b, s))
            yield pd.DataFrame(keep, columns=["a", "b", "similarity"])

    return work


class NearDuplicates:
    """members (id, n): the class of each record; classes (n, rep, norm); links (a, b, similarity) of
    classes, a < b.  ``rep`` is the least id of a class."""

    def __init__(self, df: DataFrame, key: str, question: Column, answer: Column, least: float = 0.75):
        base = materialize(df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), normalize(question, answer).alias("norm")))
        self.representatives = materialize(base.groupBy("norm").agg(F.min("id").alias("rep")).withColumn("n", F.monotonically_increasing_id()))
        self.members = base.join(self.representatives.select("norm", "n"), "norm").select("id", "n")
        pieced = self.representatives.where(F.length("norm") >= PIECE).select("n", "norm")
        sketch = materialize(pieced.mapInPandas(_sketch_rows, "n bigint, bands array<bigint>, bits array<bigint>"))
        bands = sketch.select("n", F.explode("bands").alias("band"))
        pairs = bands.withColumnRenamed("n", "a").join(bands.withColumnRenamed("n", "b"), "band").where("a < b").select("a", "b").distinct()
        side = lambda s: sketch.select(F.col("n").alias(s), F.col("bits").alias(f"bits_{s}"))
        pairs = pairs.join(side("a"), "a").join(side("b"), "b")
        differ = sum((F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(WORDS)), F.lit(0))
        n, p = 64 * WORDS, (1 - least) / 2
        pairs = pairs.where(differ <= n * p + SLACK * (n * p * (1 - p)) ** 0.5).select("a", "b")
        text = lambda s: pieced.select(F.col("n").alias(s), F.col("norm").alias(f"norm_{s}"))
        pairs = pairs.join(text("a"), "a").join(text("b"), "b")
        self.links = materialize(pairs.mapInPandas(_verify(least), "a bigint, b bigint, similarity double"))

    def record_pairs(self) -> DataFrame:
        """(candidate_a, candidate_b), a < b: all pairs of records, copies included."""
        m = self.members.join(self.representatives.where(F.length("norm") >= PIECE).select("n"), "n", "left_semi")
        x, y = m.select(F.col("id").alias("x"), F.col("n").alias("a")), m.select(F.col("id").alias("y"), F.col("n").alias("b"))
        across = self.links.select("a", "b").join(x, "a").join(y, "b").select("x", "y")
        copies = m.groupBy("n").agg(F.count("*").alias("copies")).where("copies > 1").select("n")
        own = m.join(copies, "n")
        inside = own.select(F.col("id").alias("x"), "n").join(own.select(F.col("id").alias("y"), "n"), "n").where("x < y").select("x", "y")
        return across.unionByName(inside).select(F.least("x", "y").alias("candidate_a"), F.greatest("x", "y").alias("candidate_b"))

    def class_pairs(self) -> DataFrame:
        """(rep_a, rep_b, similarity), rep_a < rep_b: the links of classes by their representatives."""
        name = lambda s: self.representatives.select(F.col("n").alias(s), F.col("rep").alias(f"rep_{s}"))
        d = self.links.join(name("a"), "a").join(name("b"), "b")
        return d.select(F.least("rep_a", "rep_b").alias("rep_a"), F.greatest("rep_a", "rep_b").alias("rep_b"), "similarity")

    def classes(self) -> DataFrame:
        """(id, rep, links, cluster): each record's class of equal text, the number of its class's
        links, and the cluster of classes linked directly or not, named by its least id."""
        links = self.links.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count("*").alias("links"))
        linked = components(self.links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("n"), F.col("root"))
        c = self.representatives.select("n", "rep").join(links, "n", "left").join(linked, "n", "left").withColumn("root", F.coalesce("root", "n"))
        # The name of a cluster is the least id in it.
        names = c.groupBy("root").agg(F.min("rep").alias("cluster"))
        c = c.join(names, "root").select("n", "rep", F.coalesce("links", F.lit(0)).alias("links"), "cluster")
        return self.members.join(c, "n").select("id", "rep", "links", "cluster")
