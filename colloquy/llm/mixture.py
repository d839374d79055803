"""Mix sources to target weights.

Method: hash-threshold histograms.  Every document has a hash; tokens are summed by source and hash
bucket, the bucket in which a source's budget ends is found on the sums, and only that bucket is
refined by the next bits of the hash, until it holds one document.  A document is taken if its hash
is below its source's threshold (or in a further range, if a document too long for the rest had to
be passed over): a filter, no sort.  A level's sums are at most sources x 4096 rows, and the first
level, over all tokens, is summed once for all ranges.  Ranges are added until what is left of the
budget is less than a token, or no later document fits into it.

The size of the mixture is the largest at which every source with documents reaches its share within
its ``max_repeats``, unless a size in tokens is given.  A target without documents can't be reached;
its share falls to the others in proportion, and the report shows it.  Whole copies come first, the
rest by threshold, so no document is used more than one time more often than another of its source.
Null, empty and unlisted sources and documents without tokens take no part; an empty table gives an
empty mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from . import encode

BITS = 12
#: Levels of refinement of the 60 bits of a hash.
LEVELS = 5


class Mixture:
    """plan: one dict a target; documents (doc_id, source, n_tokens, copies) of the mixture."""

    def __init__(self, documents: DataFrame, targets: DataFrame, size: int | None = None, seed: int = 7, path: str = encode.VOCABULARY):
        goal = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most"))
        rows = {r["source"]: r.asDict() for r in goal.collect()}  # the table of targets, a row a source
        wanted = documents.where(F.col("source").isin(list(rows)))
        hashed = encode.counts(wanted, path).withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 4))  # 60 bits
        self.tokens = materialize(hashed)
        total = {r["source"]: r["tokens"] for r in self.tokens.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).collect()}
        there = {s: r for s, r in rows.items() if total.get(s) and (r["most"] or 0) > 0}
        shares = sum(r["share"] for r in there.values())
        largest = min((r["most"] * total[s] * shares / r["share"] for s, r in there.items()), default=0.0)
        self.size = largest if size is None else float(size)
        #: The sources that set the size: at a larger one they would miss their share.
        self.scarce = {s for s, r in there.items() if r["most"] * total[s] * shares / r["share"] <= self.size * (1 + 1e-9)}
        self.plan = []
        for s, r in rows.items():
            want = min(self.size * r["share"] / shares, r["most"] * total[s]) if s in there else 0.0
            copies = int(want / total[s] + 1e-9) if s in there else 0
            self.plan.append({"source": s, "target_share": r["share"], "max_repeats": r["most"], "available": total.get(s, 0), "want": want, "whole": copies, "rest": max(0.0, want - copies * total[s]) if s in there else 0.0})
        for p in self.plan:
            p["ranges"] = []
        self._thresholds()
        spark = documents.sparkSession
        plan = spark.createDataFrame([(p["source"], p["whole"], p["ranges"]) for p in self.plan] or [("", 0, [])], "source string, whole int, ranges array<struct<low:long,high:long>>")
        extra = F.exists("ranges", lambda r: (F.col("h") >= r["low"]) & (F.col("h") < r["high"])).cast("int")
        self.documents = self.tokens.join(F.broadcast(plan), "source").withColumn("copies", F.col("whole") + extra).where("copies > 0").select("doc_id", "source", "n_tokens", "copies")

    def _thresholds(self) -> None:
        """Ranges of hashes for the rest of each budget.

        One walk over the buckets in the order of their hashes: a bucket that fits is taken whole,
        one that doesn't is looked into at the next level, and a single document that doesn't fit is
        passed over.  The walks of all sources go on together, each level's boundary buckets in one
        job; a bucket whose shortest document doesn't fit is passed over whole.
        """
        walks = {p["source"]: _Walk(p["rest"]) for p in self.plan if p["rest"] >= 1}
        first = self._sums({s: [0] for s in walks}, 1)
        for s, w in walks.items():
            w.todo = [(1, *b) for b in reversed(first.get(s, []))]
        while True:
            asked = {s: q for s, w in walks.items() if (q := w.run())}
            if not asked:
                break
            for level in sorted({q[0][0] for q in asked.values()}):
                now = {s: [e[1] for e in q] for s, q in asked.items() if q[0][0] == level}
                sums = self._sums(now, level + 1)
                for s in now:
                    walks[s].open(asked[s], sums.get(s, []))
        for p in self.plan:
            if p["source"] in walks:
                p["ranges"] = walks[p["source"]].ranges

    def _sums(self, asked: dict[str, list[int]], level: int) -> dict[str, list[tuple[int, int, int, int]]]:
        """(bucket, tokens, documents, tokens of the shortest) of a level within the asked buckets."""
        shift, above = 60 - BITS * level, 60 - BITS * (level - 1)
        inside = F.lit(False)
        for s, buckets in asked.items():
            inside = inside | ((F.col("source") == s) & F.shiftright("h", above).isin(buckets))
        rows = self.tokens.where(inside).groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"), F.min("n_tokens").alias("least")).collect()
        by: dict[str, list] = {}
        for r in rows:
            by.setdefault(r["source"], []).append((r["bucket"], r["tokens"], r["n"], r["least"]))
        return {s: sorted(x) for s, x in by.items()}

    def report(self) -> DataFrame:
        """(source, target_share, max_repeats, documents, tokens, actual_share, most_copies, reached,
        sets_size); one row a target; ``reached``: within 1 % of its share of the targets that have
        documents; ``sets_size``: all of its documents are used as often as they may, so that a larger
        mixture would miss its share."""
        spark = self.tokens.sparkSession
        plan = spark.createDataFrame([(p["source"], p["target_share"], p["max_repeats"], float(p["available"])) for p in self.plan] or [], "source string, target_share double, max_repeats int, available double")
        got = self.documents.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
        out = plan.join(got, "source", "left").fillna(0, ["documents", "tokens", "most_copies"])
        sums = out.agg(F.sum("tokens").alias("all"), F.sum(F.when(F.col("available") > 0, F.col("target_share"))).alias("shares"))
        out = out.crossJoin(F.broadcast(sums))  # one row
        actual = F.when(F.col("all") > 0, F.col("tokens") / F.col("all")).otherwise(0.0)
        near = F.abs(actual - F.col("target_share") / F.col("shares")) <= 0.01 * F.col("target_share")
        return out.select("source", "target_share", "max_repeats", "documents", "tokens", actual.alias("actual_share"), "most_copies", (near & (F.col("available") > 0)).alias("reached"), F.col("source").isin(sorted(self.scarce)).alias("sets_size"))


class _Walk:
    """The walk of one source: ``ranges`` of hashes taken, ``left`` of the budget, ``todo`` buckets
    (level, bucket, tokens, documents, tokens of the shortest), the next last.

    Every time it stops it looks into twice as many of the buckets to come, so that the number of
    jobs grows with the logarithm of the buckets that are passed over in part.
    """

    def __init__(self, budget: float):
        self.left, self.ranges, self.todo, self.ahead = budget, [], [], 1

    def open(self, asked: list[tuple], sums: list[tuple[int, int, int, int]]) -> None:
        """Put the buckets of the next level, in order, in the place of the asked ones."""
        level = asked[0][0]
        inner: dict[int, list[tuple]] = {}
        for b in sums:
            inner.setdefault(b[0] >> BITS, []).append((level + 1, *b))
        out = []
        for e in self.todo:
            out += reversed(inner[e[1]]) if e[0] == level and e[1] in inner else [e]
        self.todo = out

    def run(self) -> list[tuple]:
        """Walk on; the buckets to look into, or none at the end."""
        while self.todo and self.left >= 1:
            level, bucket, tokens, n, least = self.todo[-1]
            shift = 60 - BITS * level
            low, high = bucket << shift, (bucket + 1) << shift
            if tokens > self.left and n > 1 and least <= self.left and level < LEVELS:
                may = [e for e in self.todo if e[0] == level and e[2] > self.left and e[3] > 1 and e[4] <= self.left]
                asked, self.ahead = may[-self.ahead :], self.ahead * 2
                return asked
            self.todo.pop()
            if tokens <= self.left:
                self.left -= tokens
                if self.ranges and self.ranges[-1][1] == low:
                    self.ranges[-1] = (self.ranges[-1][0], high)
                else:
                    self.ranges.append((low, high))
        return []
