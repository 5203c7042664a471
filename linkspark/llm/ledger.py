"""Duplicates hidden by formatting: an incremental, bucketed ledger of canonical keys with counts and representatives."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from linkspark.runtime import forget, names_in, read_text, remove, shared_path, write_text, written

#: Articles that catalogues move behind a comma ("Quartet, The"), in upper case.
ARTICLES = ["THE", "A", "AN", "DER", "DIE", "DAS", "LE", "LA", "LES", "EL", "LOS", "LAS", "O", "OS", "AS", "IL", "LO", "GLI", "DE", "HET"]

#: Rows of a group that one task pairs with the others at a time; larger groups are salted by their count in the ledger.
PAIR_BLOCK = 500

EDGE = r"^[^\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}]+$"


def canonical_field(value: Column) -> Column:
    """Letters, marks and numbers of ``value`` in upper case, with "B, A" (or "B - A") read as "A B"; "" where none are left."""
    text = F.regexp_replace(F.upper(F.regexp_replace(value, r"\p{Cf}", "")), EDGE, "")
    text = F.regexp_replace(text, r"\s+[-\u2013\u2014]\s+", ",")
    text = F.regexp_replace(text, rf"(?s)^(.*[^,]),[^\p{{L}}\p{{N}}]*({'|'.join(ARTICLES)})$", "$2 $1")
    text = F.regexp_replace(text, r"(?s)^([^,]+),([^,]+)$", "$2 $1")
    return F.regexp_replace(text, r"[^\p{L}\p{N}\p{M}]+", "")


def canonical_key(*fields: Column) -> Column:
    """Key of a record that no formatting changes: the canonical fields in sorted order; null if a field is null or blank."""
    parts = [canonical_field(f) for f in fields]
    whole = parts[0] != ""
    for p in parts[1:]:
        whole = whole & (p != "")
    return F.when(whole, F.array_join(F.array_sort(F.array(*parts)), "\u001f"))


def _composed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for c in b.columns[1:3]:
            b[c] = b[c].map(lambda v: unicodedata.normalize("NFC", v) if isinstance(v, str) else v)
        yield b


def keyed(df: DataFrame, id_col: str, fields: list[str], time_col: str) -> DataFrame:
    """``id, seen, title, artist, key`` of the records that count.

    Records with a null, empty or purely punctuational field have no key and are left out. Letters written with
    combining marks count as their composed forms; only those few records pass through Python. The keys are computed
    once, into a table of the shared folder.
    """
    a, b = fields
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(a).cast("string").alias("title"), F.col(b).cast("string").alias("artist"), F.col(time_col).cast("timestamp_ntz").alias("seen")).where("id is not null and title <> '' and artist <> ''")
    marked = F.col("title").rlike(r"\p{M}") | F.col("artist").rlike(r"\p{M}")
    composed = rows.where(marked).mapInPandas(_composed, rows.schema)
    return written(rows.where(~marked).unionByName(composed).withColumn("key", canonical_key(F.col("title"), F.col("artist"))).where("key is not null"), "keyed")


class Ledger:
    """Counts by canonical key, in hash buckets that are files of their own below one folder.

    A batch is aggregated first, then full-outer-joined with the buckets it touches only; those are written anew and
    the others kept. The manifest (which folder holds each bucket) is a file beside them, written last: a batch counts
    wholly or not at all, and a later session goes on where this one stopped by naming the same ``path``. Buckets
    double when they hold more than ``bucket_keys`` keys on average, so that each stays the work of one task. Folders
    that a batch supersedes are deleted by the next one, when nobody reads them any more. One writer at a time.
    """

    FIELDS = "key string, copies bigint, first struct<seen:timestamp_ntz,id:bigint,title:string,artist:string>"

    def __init__(self, spark: SparkSession, path: str | None = None, least_buckets: int = 16, bucket_keys: int = 1_000_000):
        self.spark, self.bucket_keys = spark, bucket_keys
        self.path = (path or shared_path(spark, "ledger")).rstrip("/")
        known = [n for n in names_in(spark, self.path) if n.startswith("manifest-") and n.endswith(".json")]
        state = json.loads(read_text(spark, f"{self.path}/{known[-1]}")) if known else {"version": 0, "n_buckets": least_buckets, "keys": 0, "buckets": {}, "superseded": []}
        self.version, self.n_buckets, self.keys = state["version"], state["n_buckets"], state["keys"]
        self.manifest: dict[int, str] = {int(b): folder for b, folder in state["buckets"].items()}
        self.superseded: list[str] = state["superseded"]

    def table(self, buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{self.manifest[b]}" for b in sorted(self.manifest) if buckets is None or b in buckets]
        reader = self.spark.read.schema(self.FIELDS)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.FIELDS)

    def apply(self, batch: DataFrame) -> "Ledger":
        """Add the rows of ``keyed``: counts add up, the earliest record (then the least id) stays the representative.

        An empty batch changes nothing. Repeated rows count each.
        """
        fresh = batch.groupBy("key").agg(F.count("*").alias("copies"), F.min(F.struct("seen", "id", "title", "artist")).alias("first"))
        size = Observation()
        fresh = written(fresh.observe(size, F.count("*").alias("keys")), "batch")
        arrived = size.get["keys"]
        if not arrived:
            return self
        n = self.n_buckets
        while self.keys + arrived > n * self.bucket_keys:
            n *= 2
        bucket = F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
        if n != self.n_buckets:  # every key moves to a bucket of the new number
            touched = None
        else:
            touched = [r.bucket for r in fresh.select(bucket.alias("bucket")).distinct().collect()]  # at most n rows
        earlier, later = F.col("o.first"), F.col("n.first")
        known = Observation()
        merged = (
            self.table(touched).alias("o").join(fresh.alias("n"), "key", "full_outer")
            .observe(known, F.count_if(F.col("o.copies").isNull()).alias("new")).select(
                "key",
                (F.coalesce("o.copies", F.lit(0)) + F.coalesce("n.copies", F.lit(0))).alias("copies"),
                F.least(earlier, later).alias("first"),
            )
        )
        folder = f"batch-{self.version + 1:06d}"
        remove(self.spark, f"{self.path}/{folder}")  # left by a batch that did not end
        merged.withColumn("bucket", bucket).repartition(n, "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        written_anew = {int(name.split("=")[1]): f"{folder}/{name}" for name in names_in(self.spark, f"{self.path}/{folder}") if name.startswith("bucket=")}
        kept = {} if touched is None else {b: f for b, f in self.manifest.items() if b not in written_anew}
        old, stale = self.superseded, [f for b, f in self.manifest.items() if b not in kept]
        self.version, self.n_buckets, self.keys = self.version + 1, n, self.keys + known.get["new"]
        self.manifest, self.superseded = kept | written_anew, stale
        state = {"version": self.version, "n_buckets": n, "keys": self.keys, "buckets": self.manifest, "superseded": stale}
        write_text(self.spark, f"{self.path}/manifest-{self.version:09d}.json", json.dumps(state))
        for name in [*old, f"manifest-{self.version - 1:09d}.json"]:
            remove(self.spark, f"{self.path}/{name}")
        forget(fresh)
        return self


def ledger_of(rows: DataFrame, batches: int = 3, path: str | None = None, **options: int) -> Ledger:
    """Ledger of ``keyed`` rows, fed in ``batches`` of rising time as they would have arrived."""
    ledger = Ledger(rows.sparkSession, path, **options)
    at = F.unix_seconds(F.col("seen").cast("timestamp"))
    cuts = rows.select(F.percentile_approx(at, [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    part = F.lit(0)
    for i, cut in enumerate(sorted(set(cuts)), 1):
        part = F.when(at > cut, F.lit(i)).otherwise(part)
    for i in range(len(set(cuts)) + 1):
        ledger.apply(rows.where(F.coalesce(part, F.lit(0)) == i))
    return ledger


def duplicate_pairs(rows: DataFrame, ledger: Ledger) -> DataFrame:
    """``a, b`` with a < b: every two rows of one ledger group; the group's count decides how finely it is salted."""
    groups = ledger.table().where("copies > 1").select("key", F.ceil(F.col("copies") / PAIR_BLOCK).cast("int").alias("salts"))
    members = rows.select("key", "id").join(groups, "key")
    left = members.select("key", F.col("id").alias("a"), F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
    right = members.select("key", F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return left.join(right, ["key", "salt"]).where("a < b").select("a", "b")
