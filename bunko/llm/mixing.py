"""Problem 7: mix documents of several sources to target shares of all tokens.

Tokens (byte_bpe_50k) are added up per source. Each source is to have its target share of all tokens there are; one that
can't fill it is used max_repeats times and falls short, which the report shows (`short`, and the share reached beside
the target). `total_tokens` asks for another total, and `reachable` for the largest at which every share is reached: the
least of max_repeats * tokens / target_share over the sources that have tokens, so that the scarcest source then thins
all others. A source's rate is its share of the total over its tokens. Each document comes out floor(rate) times, plus
once more if the hash of its id and the seed, as a number in [0, 1), is below the rest: the same copies in every run, on
any cluster, and never more than max_repeats.

Documents without tokens (null and empty texts) add nothing and are left out. A source without a row in the targets
(null too) gets rate 0 and is reported with a null target; a target whose source has no tokens is reported with 0
and as short. Of repeated target rows the first by share counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bunko.llm.byte_pairs import counted, vocabulary
from bunko.session import materialize, spread, table

SEED = 20_250


def sizes(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens)."""
    path = path or vocabulary()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return spread(rows).mapInArrow(lambda it: counted(it, path, 2), "doc_id bigint, source string, n_tokens bigint")


def rates(sized: DataFrame, targets: DataFrame, total_tokens: float | None = None, reachable: bool = False) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, tokens, rate, short) of every source in either table."""
    have = sized.groupBy("source").agg(F.count_if(F.col("n_tokens") > 0).alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    want = targets.groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.target_share", "t.max_repeats")
    both = have.join(want, have["source"].eqNullSafe(want["source"]), "full").select(
        F.coalesce(have["source"], want["source"]).alias("source"), "target_share", "max_repeats", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_docs", "tokens"))
    )
    can = F.when((F.col("tokens") > 0) & (F.col("target_share") > 0), F.col("max_repeats") * F.col("tokens") / F.col("target_share"))
    total = both.agg((F.min(can) if reachable else F.sum("tokens").cast("double")).alias("total")) if total_tokens is None else sized.sparkSession.range(1).select(F.lit(float(total_tokens)).alias("total"))
    wanted = F.col("target_share") * F.col("total")
    rate = F.least(wanted / F.nullif("tokens", F.lit(0)), F.col("max_repeats"))
    short = F.coalesce(wanted > F.col("max_repeats") * F.col("tokens") * (1 + 1e-9), F.lit(False))
    return both.crossJoin(total).select(*both.columns, F.round(F.coalesce(rate, F.lit(0.0)), 9).alias("rate"), short.alias("short"))


def mix(sized: DataFrame, rate_of: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, copy, n_tokens), one row per copy; the rates are a row per source, of which targets name few."""
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    rows = sized.where("n_tokens > 0").join(rate_of.where("rate > 0").select("source", "rate"), "source")
    copies = F.floor("rate") + F.when(place < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    rows = rows.withColumn("copies", copies.cast("int")).where("copies > 0")
    return rows.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "n_tokens")


def report(mixed: DataFrame, rate_of: DataFrame) -> DataFrame:
    used = mixed.groupBy("source").agg(F.count("*").alias("copies"), F.sum("n_tokens").alias("mix_tokens"))
    out = rate_of.join(used, "source", "left").select(*rate_of.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("copies", "mix_tokens")))
    total = used.agg(F.sum("mix_tokens").alias("all_tokens"))
    return out.crossJoin(total).withColumn("actual_share", F.coalesce(F.col("mix_tokens") / F.nullif("all_tokens", F.lit(0)), F.lit(0.0))).drop("all_tokens")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sized = materialize(sizes(table(spark, sf_dir, "documents")))
    rate_of = rates(sized, table(spark, sf_dir, "mix_targets"))
    return mix(sized, rate_of), rate_of


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(*_mixed(spark, sf_dir))


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares}
ORACLES: dict[str, str] = {}
