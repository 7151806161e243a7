"""Mixing sources to target weights, sized in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelake.plans.layout import spread

#: The vocabulary that sizes are counted with; a file of base64 tokens and ranks.
VOCABULARY = os.environ.get("CINELAKE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: how that vocabulary's tokenizer splits a text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def _count(tokenizer, text: str | None) -> int:
    if not text:
        return 0
    return len(tokenizer.encode_ordinary(text.encode("utf-8", "replace").decode("utf-8")))


def tokens(df: DataFrame, id: str, text: str, keep: list[Column], vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` columns with id and tokens, the number of tokens of ``text`` (0 for null and empty ones)."""
    base = df.select(F.col(id).alias("id"), F.col(text).alias("text"), *keep)
    kept = [f for f in base.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(vocabulary)
        for batch in batches:
            count = [_count(tokenizer, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(count, pa.int64())], [*(f.name for f in kept), "tokens"])

    return spread(base).mapInArrow(run, schema)


def source_key(source: Column) -> Column:
    """A source's name without differences of case, outer blanks and hyphens for underscores; blank ones are null."""
    key = F.regexp_replace(F.lower(F.trim(source)), r"[\s\-_]+", "_")
    return F.when(key != "", key)


def rates(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_share, available, rate): how often each document of a source is to be used.

    A source's rate is its share of the total over its available tokens, at most max_repeats. Without ``total`` the
    total is the largest at which every source with tokens reaches its share under its cap; shares of
    sources without tokens fall to the others in proportion. Targets with a null source or share, or a share
    not above 0, ask for nothing; a null cap is 1; several targets of one source add up, with the largest cap.
    """
    t = targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.coalesce(F.col("max_repeats"), F.lit(1)).cast("double").alias("cap"))
    t = t.filter("source is not null and share > 0 and not isnan(share)").groupBy("source").agg(F.sum("share").alias("target_share"), F.max("cap").alias("cap"))
    have = sized.filter("source is not null").groupBy("source").agg(F.sum("tokens").alias("available"))
    both = t.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0).cast("long")))
    whole = both.filter("available > 0 and cap > 0").agg(F.sum("target_share").alias("whole"), F.min(F.col("available") * F.col("cap") / F.col("target_share")).alias("most"))
    both = both.crossJoin(F.broadcast(whole))  # one row
    size = F.lit(float(total)) if total is not None else F.col("most") * F.col("whole")
    rate = F.when((F.col("available") > 0) & (F.col("cap") > 0), F.least(F.col("cap"), size * F.col("target_share") / F.col("whole") / F.col("available"))).otherwise(0.0)
    return both.select("source", "target_share", "available", rate.alias("rate"))


def select(sized: DataFrame, rate: DataFrame, seed: int = 0) -> DataFrame:
    """``sized`` rows with copies >= 1: floor(rate) of each document and one more by chance of the fraction.

    The chance is a hash of the id and ``seed``: the same documents at every run and in every layout. The rates
    are a small table (one row for each source), so documents are not shuffled for them.
    """
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    extra = F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return sized.join(rate.select("source", "rate"), "source").withColumn("copies", (F.floor("rate") + extra).cast("int")).filter("copies > 0").drop("rate")


def report(chosen: DataFrame, rate: DataFrame) -> DataFrame:
    """(source, target_share, available, rate, documents, selected, actual_share) for every source with a target."""
    got = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("selected"))
    all_ = got.agg(F.sum("selected").alias("total"))
    zero = F.lit(0).cast("long")
    out = rate.join(got, "source", "left").crossJoin(F.broadcast(all_))
    share = F.coalesce(F.try_divide(F.coalesce("selected", zero).cast("double"), F.col("total").cast("double")), F.lit(0.0))
    return out.select("source", "target_share", "available", "rate", F.coalesce("documents", zero).alias("documents"), F.coalesce("selected", zero).alias("selected"), share.alias("actual_share"))
