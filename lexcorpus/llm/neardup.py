"""Groups of records whose texts are largely the same.

Texts with the same words in the same order are one class; a class is compared once. Each class
gets a min-hash signature of its word shingles. Classes agreeing in a whole band of the signature
are candidates. A candidate pair is then verified in sequence: the signatures are compared batch
by batch, and the pair is given up as soon as the posterior probability that its similarity
reaches the threshold falls below ``miss`` (uniform prior, so the posterior after m matches of n
is Beta(m + 1, n - m + 1), whose tail is a binomial sum). Survivors are verified exactly on their
shingle sets.

Scale: band keys are counted by a partial aggregate first; a bucket of two is a pair already, and only
the members of larger ones are shuffled again. Where more than ``BLOCK`` classes share a band (a
phrase common to very many texts), its classes are compared by an exact prefix filter instead: the
shingles of each are ordered from the rarest on, and two sets with similarity t of n shingles share one of
the first n - ceil(t n) + 1. So what is common to all makes no candidates, and no pair at the
threshold is lost by it. A shingle that still is in very many texts is divided into pairs of blocks, so no task holds a
whole bucket. Signatures and shingles are only shuffled for classes that occur in a candidate pair
where those can be broadcast (counted).

Defined cases: null and short texts (fewer than ``min_words`` words) belong to no class; repeated
rows of an id are one record; records without a document are in no pair across documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexcorpus.staging import Stage
from lexcorpus.tables import records

#: Classes of a bucket that are compared in one piece.
BLOCK = 500
#: Pairs or buckets whose ids are broadcast at most.
FEW = 500_000


@dataclass(frozen=True)
class Similar:
    """What counts as largely the same, and how surely it is found."""

    words: int = 5
    threshold: float = 0.8
    min_words: int = 20
    bands: int = 20
    miss: float = 0.001
    batch: int = 16

    @property
    def rows(self) -> int:
        """Rows a band: the most that keep the chance to miss a pair at the threshold below 0.5 %."""
        fits = [r for r in range(1, 9) if (1 - self.threshold**r) ** self.bands <= 0.005]
        if not fits:
            raise ValueError(f"{self.bands} bands are too few for a threshold of {self.threshold}")
        return max(fits)

    @property
    def size(self) -> int:
        """Hashes of a signature."""
        return self.bands * self.rows

    def least_matches(self) -> list[tuple[int, int]]:
        """(n, m): after n hashes a pair with fewer than m matches is given up."""
        t, out = self.threshold, []
        for n in range(self.batch, self.size + 1, self.batch):
            tail, m = 0.0, 0
            while m <= n:
                tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
                if tail >= self.miss:
                    break
                m += 1
            out.append((n, m))
        return out


def word_rows(df: DataFrame, id_col: str, text_col: str, min_words: int, keep: list[str] = ()) -> DataFrame:
    """(id, keep..., words): the lower-case words of each text joined by a space, of texts with enough of them."""
    joined = F.array_join(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")
    # the generator keeps the filter from running the expression a second time
    return df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), *keep, F.explode(F.array(joined)).alias("words")).where(F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) >= min_words - 1)


def _shingles(words, k: int):
    n = F.size(words) - (k - 1)
    return F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])))


def _signer(s: Similar):
    r = np.random.default_rng(7)
    a = r.integers(1, 2**63, s.size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = r.integers(0, 2**63, s.size, dtype=np.uint64)
    schema = pa.schema([("rep", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def keys(h: np.ndarray) -> np.ndarray:
        out = np.empty((h.shape[1], s.bands), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(s.bands):
                k = np.full(h.shape[1], i + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                for row in h[i * s.rows : (i + 1) * s.rows]:
                    k = (k ^ row) * np.uint64(0xD6E8FEB86659FD93)
                    k ^= k >> np.uint64(32)
                out[:, i] = k
        return out.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
            h = np.empty((s.size, batch.num_rows), dtype=np.uint64)
            with np.errstate(over="ignore"):
                for k in range(s.size):
                    x = flat * a[k] + b[k]
                    x ^= x >> np.uint64(29)
                    h[k] = np.minimum.reduceat(x * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(16), starts)
            sig = np.ascontiguousarray(h.T.astype(np.uint16))
            lists_of = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, s.bands, dtype=np.int32)), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sig], pa.binary()), lists_of(keys(h))], schema=schema)

    return run


def _pruner(s: Similar):
    steps = s.least_matches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, s.size) for c in (2, 3)]
            alive, matches, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64), 0
            for n, least in steps:
                matches = matches + (sig[0][alive, done:n] == sig[1][alive, done:n]).sum(axis=1)
                stay = matches >= least
                alive, matches, done = alive[stay], matches[stay], n
                if not len(alive):
                    break
            yield batch.take(pa.array(alive)).select([0, 1])

    return run


def _met(rows: DataFrame, key: str, fits: str = "true") -> DataFrame:
    """(a, b): classes of ``rows`` (rep, n, ``key``) with the same key, n being the rows of the key.

    Keys of more than ``BLOCK`` rows are divided into blocks; each pair of blocks is a group of its own.
    """
    n = F.ceil(F.col("n") / BLOCK)
    blocks = rows.withColumn("own", F.pmod(F.xxhash64("rep"), n)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    blocks = blocks.withColumns({"one": F.least("own", "other"), "two": F.greatest("own", "other")})
    x, y = blocks.alias("x"), blocks.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in (key, "one", "two")]
    return x.join(y, [*same, F.expr("x.rep < y.rep and (x.one = x.two or x.own <> y.own)"), F.expr(fits)]).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))


class NearDuplicates:
    """Classes of ``rows`` (id, doc, words) and the pairs of classes that are largely the same."""

    def __init__(self, rows: DataFrame, similar: Similar):
        self.spark, self.similar = rows.sparkSession, similar
        self.stage = Stage(self.spark, "neardup")
        text = self.stage.write(rows.withColumn("cls", F.md5("words")), "words")
        classes = text.groupBy("cls").agg(F.min("words").alias("words")).withColumn("rep", F.monotonically_increasing_id())
        # the generator makes the words a column: within the lambda the split would run for every shingle
        split = classes.select("rep", "cls", F.explode(F.array(F.split("words", " "))).alias("words"))
        shingled = split.select("rep", "cls", _shingles(F.col("words"), similar.words).alias("shingles"))
        self.classes = self.stage.write(shingled, "classes")  # fixes rep
        self.members = text.select("id", "doc", "cls").join(self.classes.select("cls", "rep"), "cls").select("id", "doc", "rep")

    def pairs(self) -> DataFrame:
        """(a, b, similarity): class pairs at or above the threshold, a < b."""
        s, stage = self.similar, self.stage
        signed = stage.write(self.classes.select("rep", "shingles").mapInArrow(_signer(s), "rep bigint, sig binary, bands array<bigint>"), "signatures")
        bands = signed.select("rep", F.explode("bands").alias("band"))
        buckets = stage.write(bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("a"), F.max("rep").alias("b")).where("n > 1"), "buckets")
        more = buckets.where("n > 2").select("band", "n")
        members = stage.write(bands.join(F.broadcast(more) if more.count() <= FEW else more, "band"), "buckets-of-more")
        met = buckets.where("n = 2").select("a", "b").unionByName(_met(members.where(f"n <= {BLOCK}"), "band"))
        hot = members.where(f"n > {BLOCK}").select("rep")
        if not hot.isEmpty():
            met = met.unionByName(self._by_prefix(hot.distinct()))
        met = stage.write(met.distinct(), "candidates")
        near = self._with(met, signed.select("rep", "sig"), "sig").mapInArrow(_pruner(s), "a bigint, b bigint")
        near = stage.write(near, "survivors")
        both = self._with(near, self.classes.select("rep", "shingles"), "shingles")
        common = F.size(F.array_intersect("a_shingles", "b_shingles"))
        j = (common / (F.size("a_shingles") + F.size("b_shingles") - common)).alias("similarity")
        return stage.write(both.select("a", "b", F.explode(F.array(j)).alias("similarity")).where(F.col("similarity") >= s.threshold), "pairs")

    def _by_prefix(self, some: DataFrame) -> DataFrame:
        """(a, b): all pairs of the classes ``some`` that can reach the threshold, by the rarest shingles of each."""
        t = self.similar.threshold
        sized = self.stage.write(self.classes.join(some, "rep", "left_semi").select("rep", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle")), "hot-shingles")
        often = sized.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"))
        # a window over the shingles of one text
        rarest = Window.partitionBy("rep").orderBy("often", "shingle")
        first = sized.join(often, "shingle").withColumn("at", F.row_number().over(rarest)).where(F.col("at") <= F.col("size") - F.ceil(F.col("size") * t - 1e-9) + 1)
        first = self.stage.write(first.select("rep", "size", "shingle"), "prefixes")
        several = first.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return _met(first.join(several, "shingle"), "shingle", f"least(x.size, y.size) >= greatest(x.size, y.size) * {t} - 1e-9")

    def _with(self, pairs: DataFrame, rows: DataFrame, column: str) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        if pairs.count() <= FEW:  # so at most twice as many ids
            rows = rows.join(F.broadcast(ids), "rep", "left_semi")
        side = lambda x: rows.select(F.col("rep").alias(x), F.col(column).alias(f"{x}_{column}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", f"a_{column}", f"b_{column}")


def pairs_across_documents(found: NearDuplicates) -> DataFrame:
    """(a_id, b_id): records of different documents with the same or largely the same words, a_id < b_id."""
    members = found.stage.write(found.members, "members")
    two = members.groupBy("rep").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    links = found.pairs().select("a", "b").unionByName(two)
    x = members.select(F.col("id").alias("x_id"), F.col("doc").alias("x_doc"), F.col("rep").alias("a"))
    y = members.select(F.col("id").alias("y_id"), F.col("doc").alias("y_doc"), F.col("rep").alias("b"))
    both = links.join(x, "a").join(y, "b").where("x_doc <> y_doc and (a <> b or x_id < y_id)")
    return both.select(F.least("x_id", "y_id").alias("a_id"), F.greatest("x_id", "y_id").alias("b_id")).distinct()


def groups(found: NearDuplicates) -> DataFrame:
    """(id, doc, class_id, group_id, n_links): one row per record; links are those between classes, groups their connected components."""
    links = found.pairs().select("a", "b")
    ends = links.select(F.explode(F.array("a", "b")).alias("rep"))
    degree = ends.groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    label = components(links, found.stage)
    return (
        found.members.join(degree, "rep", "left")
        .join(label, "rep", "left")
        .select("id", "doc", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )


def components(links: DataFrame, stage: Stage) -> DataFrame:
    """(rep, component): the smallest member of each node's connected component, by alternating large and small stars.

    Every round links each node's larger neighbours to its least one, then its smaller ones; the
    number of rounds grows with the logarithm of the component size.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        near = both(e)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        linked = near.join(least, "a")
        if large:
            out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = linked.where("b <= a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    edges = stage.write(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges0")
    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("bigint")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    before, n = mark(edges), 0
    while True:
        n += 1
        edges = stage.write(star(star(edges, True), False), f"edges{n}")
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("rep"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("rep"), F.col("b").alias("component")).distinct())


def provisions(nodes: DataFrame, versions: DataFrame, articles: DataFrame, min_words: int) -> DataFrame:
    """(id, doc, words) of node texts and legacy article texts; documents of the two kinds never coincide."""
    owners = versions.where("id is not null").select(F.col("id").alias("document_version_id"), F.concat(F.lit("d:"), "document_id").alias("doc")).distinct()
    a = word_rows(nodes.where("id is not null"), "id", "text", min_words, ["document_version_id"])
    a = records(a, "id", ["document_version_id", "words"]).join(owners, "document_version_id", "left").select("id", "doc", "words")
    b = word_rows(articles.where("id is not null"), "id", "text", min_words, [F.concat(F.lit("k:"), "document_id").alias("doc")])
    return a.unionByName(records(b, "id", ["doc", "words"]))
