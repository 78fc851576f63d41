"""What the training-data operators share: the shared folder, written tables and the word rule."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset in a local run."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables written below the shared folder, so that lineage is cut and lost executors cost nothing but a re-read."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        df.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def skewed_join(left: DataFrame, right: DataFrame, keys: list[str], n: str = "n", how: str = "left_semi", salts: int = 64, total: int | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``keys``, none of them null. ``right`` has few rows for each key, mostly one, and in ``n`` how
    many rows of ``left`` have the key, at most. ``right`` is a written table, and so is ``left`` unless ``total``, its number of rows, is given.

    Keys that hold a thousandth of the rows of ``left`` or more, so at most a thousand keys, are known to all tasks; rows
    with one of them are dealt out over ``salts`` tasks, to each of which the key's rows of ``right`` go. A task that
    runs again after a lost executor must deal its rows as before: rows of a written table go by their place, which stays the
    same, all others by their values, as a shuffle may bring them in another order.
    """
    least = max(1_000, (left.count() if total is None else total) // 1_000)
    hot, salt = fresh(left, "_hot", "_salt")
    known = F.broadcast(right.filter(F.col(n) >= least).select(*keys, F.lit(True).alias(hot)).distinct())
    place = F.monotonically_increasing_id() if total is None else F.xxhash64(*left.columns)
    dealt = left.join(known, keys, "left").withColumn(salt, F.when(F.col(hot), F.pmod(place, F.lit(salts))).otherwise(0)).drop(hot)
    copies = F.when(F.col(n) >= least, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))).cast("array<bigint>")
    return dealt.join(right.withColumn(salt, F.explode(copies)), [*keys, salt], how).drop(salt)


#: Bits in a value of bitmap_construct_agg.
_BLOCK = 32_768


def maybe_in(df: DataFrame, own: list[str], keys: DataFrame, scratch: Scratch, flag: str, bits: int = 32, most: int = 1 << 28) -> DataFrame:
    """``df`` with a boolean ``flag``: whether its columns ``own`` may be a row of ``keys``, a written table of as many columns of the same types.

    False is certain. True is wrong for about one row in ``bits``, and for more once the keys have no ``most // bits`` bits
    each; so all tasks know a bitmap of 32 MB at most, whatever the keys, and only rows that pass it need to meet them in a shuffle.
    """
    blocks = max(1, min(most, bits * keys.count()) // _BLOCK)
    place, block, marks = fresh(df, "_place", "_block", "_marks")
    at = lambda names: F.pmod(F.xxhash64(*names), F.lit(blocks * _BLOCK))
    bitmap = keys.select(at(keys.columns).alias(place)).groupBy(F.floor(F.col(place) / _BLOCK).alias(block)).agg(F.bitmap_construct_agg(F.col(place) % _BLOCK).alias(marks))
    df = df.withColumn(place, at(own)).withColumn(block, F.floor(F.col(place) / _BLOCK))
    df = df.join(F.broadcast(scratch.write(bitmap, f"bitmap-{flag}")), block, "left")
    byte = F.conv(F.hex(F.substring(marks, F.floor(F.col(place) % _BLOCK / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return df.withColumn(flag, F.coalesce(F.getbit(byte, (F.col(place) % 8).cast("int")) == 1, F.lit(False))).drop(place, block, marks)


def without(docs: DataFrame, own: list[Column], gone: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` whose values of ``own`` are no row of ``gone``, a written table of as many columns of the same types; nulls
    are equal to nulls. Only rows that may go are shuffled, with all their columns; the others stay where they are."""
    flag, *names = fresh(docs, "_maybe", *[f"_{side}_{i}" for side in ("own", "gone") for i in range(len(own))])
    mine, theirs = names[: len(own)], names[len(own) :]
    marked = maybe_in(docs.withColumns(dict(zip(mine, own, strict=True))), mine, gone, scratch, flag)
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(mine, theirs, strict=True)]
    left = marked.filter(F.col(flag)).join(gone.toDF(*theirs), same, "left_anti")
    return marked.filter(~F.col(flag)).unionByName(left).select(*docs.columns)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words: the text's pieces between white space that are not empty (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that the table doesn't have, whatever columns it brings."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
        have.add(name.lower())
    return out
