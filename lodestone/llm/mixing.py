"""Mixing sources to target weights by hash-random order, distributed prefix sums and exact cuts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import packed, shared_dir, stored, unpacked

TOKEN = "[^ \\t\\n\\r\\f\\x0B]+"


@dataclass(frozen=True)
class MixParams:
    """``weights`` by source, in any unit; sources that it lacks have ``other``. ``total`` is the token budget, by default all tokens there are.

    The order is cut into ranges by the key's first ``digits`` hex digits, so no task holds a whole source. ``broadcast_sources``
    is the number of sources up to which their table is sent to all tasks.
    """

    weights: dict[str, float] = field(default_factory=dict)
    other: float = 1.0
    total: int | None = None
    seed: str = "mix-1"
    digits: int = 3
    broadcast_sources: int = 100_000


def count_tokens(text):
    """Tokens are runs without ASCII white space; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def _key(params: MixParams, doc_id=None):
    return F.md5(F.concat(F.lit(params.seed + "|"), F.coalesce((F.col("doc_id") if doc_id is None else doc_id).cast("string"), F.lit(""))))


def _placed(docs: DataFrame, params: MixParams) -> DataFrame:
    """Every row that has a budget, with its place in its source's order and the source's whole epochs and rest.

    Prefix sums run over ranges of keys first, of which there are few, and then inside each range.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), count_tokens("text").alias("n_tokens"), _key(params).alias("mix_key"))
    rows = stored(rows.withColumn("_range", F.substring("mix_key", 1, params.digits)), f"{shared_dir(docs.sparkSession)}/keys")
    sums = rows.groupBy("source", "_range").agg(F.sum("n_tokens").alias("_sum"))
    by = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    whole = sums.groupBy("source").agg(F.sum("_sum").alias("_all")).filter("_all > 0")
    weight = F.lit(params.other)
    for name, w in params.weights.items():
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    whole = whole.withColumn("_weight", weight.cast("double"))
    grand = whole.agg(F.sum("_weight").alias("_weights"), F.sum("_all").alias("_total"))
    total = F.col("_total") if params.total is None else F.lit(params.total)
    budget = F.coalesce(F.floor(total * F.col("_weight") / F.nullif(F.col("_weights"), F.lit(0.0))), F.lit(0)).cast("long")
    budgets = whole.crossJoin(F.broadcast(grand)).select(F.col("source").alias("_s"), "_all", budget.alias("_budget"))
    budgets = budgets.select("_s", F.floor(F.col("_budget") / F.col("_all")).cast("long").alias("_epochs"), F.pmod("_budget", "_all").alias("_rest"))
    before = sums.select(F.col("source").alias("_s1"), F.col("_range").alias("_r"), (F.sum("_sum").over(by) - F.col("_sum")).alias("_before"))
    offsets = before.join(budgets, F.col("_s1").eqNullSafe(F.col("_s"))).drop("_s")
    inside = Window.partitionBy("source", "_range").orderBy("mix_key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_to", F.sum("n_tokens").over(inside)).join(offsets, F.col("source").eqNullSafe(F.col("_s1")) & (F.col("_range") == F.col("_r")))
    return placed.withColumn("start_token", F.col("_before") + F.col("_to") - F.col("n_tokens")).drop("_s1", "_r", "_before", "_to", "_range")


def _in_rest():
    return (F.col("start_token") + F.col("n_tokens") <= F.col("_rest")) & (F.col("_rest") > 0)


def mix_sources(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """One row for each time a document is taken: doc_id, source, epoch (from 0), start_token (in its source's order),
    n_tokens, take_tokens (fewer only in the one row where the source's budget ends).

    A source's budget is floor(total * weight / sum of the weights of the sources that have tokens). Its rows are ordered by
    md5(seed|doc_id), then doc_id and n_tokens; whole epochs come first and the last one is cut exactly. Rows without tokens
    are taken as often as their place in the order says and cost nothing. Null sources are one source, null ids are ordered
    as ''. A source without tokens gets no budget and no rows. Repeated rows count each. An empty table gives no rows.
    """
    cut = F.when(~_in_rest() & (F.col("start_token") < F.col("_rest")), F.col("_rest") - F.col("start_token")).otherwise(F.lit(0)).cast("long")
    plan = _placed(docs, params).withColumn("_copies", F.col("_epochs") + _in_rest().cast("long")).withColumn("_cut", cut)
    times = F.col("_copies") + (F.col("_cut") > 0).cast("long")
    out = plan.filter(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    take = F.when((F.col("epoch") == F.col("_copies")) & (F.col("_cut") > 0), F.col("_cut")).otherwise(F.col("n_tokens"))
    return out.select("doc_id", "source", "epoch", "start_token", "n_tokens", take.alias("take_tokens"))


def take_mix(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """``docs`` repeated and cut to the mix of ``mix_sources``, with all its columns. A cut row holds its first tokens, and
    n_chars, if there is such a column, their length. Of rows that tie in the order (equal ids and token counts) as many are
    taken as fit, the next one is cut, and which they are is as they were stored.

    Each source's mix is one place in its order, so the texts meet a table with one row a source and aren't shuffled.
    """
    spark = docs.sparkSession
    where = shared_dir(spark)
    placed = stored(_placed(docs, params), f"{where}/placed")
    first = F.lit(-(1 << 63)).cast("long")
    place = F.struct("mix_key", F.coalesce("doc_id", first).alias("id"), "n_tokens")
    over = F.struct(place.alias("at"), (F.col("start_token") - F.col("_rest")).alias("over"))
    ends = placed.groupBy(F.col("source").alias("_s")).agg(F.first("_epochs").alias("_epochs"), F.min(F.when(~_in_rest(), over)).alias("_end"))
    ends = ends.select("_s", "_epochs", F.col("_end.at").alias("_at"), F.greatest(-F.col("_end.over"), F.lit(0)).alias("_left"))
    same = F.col("source").eqNullSafe(F.col("_s"))
    ties = placed.filter(_in_rest()).withColumn("_own", place).join(ends, same & (F.col("_own") == F.col("_at"))).groupBy(F.col("_s").alias("_s2")).agg(F.count("*").alias("_whole"))
    ends = ends.join(ties, F.col("_s").eqNullSafe(F.col("_s2")), "left").select("_s", "_epochs", "_at", "_left", F.coalesce("_whole", F.lit(0)).alias("_whole"))
    ends = stored(ends, f"{where}/ends")
    small = ends.count() <= params.broadcast_sources
    key = F.struct(_key(params, F.col("row.doc_id")).alias("mix_key"), F.coalesce(F.col("row.doc_id").cast("long"), first).alias("id"))
    at = F.struct("_at.mix_key", "_at.id")
    rows = packed(docs).join(F.broadcast(ends) if small else ends, F.col("row.source").cast("string").eqNullSafe(F.col("_s")))
    own = F.when(key == at, count_tokens("row.text"))
    order = F.when(key < at, -1).when(key > at, 1).when(own < F.col("_at.n_tokens"), -1).when(own > F.col("_at.n_tokens"), 1).otherwise(0)
    rows = rows.withColumn("_order", F.when(F.col("_at").isNull(), 1).otherwise(order))
    # the few rows that tie with the end are numbered, in each partition of their table and then across
    tied = stored(rows.filter("_order = 0").withColumn("_n", F.monotonically_increasing_id()), f"{where}/tied").withColumn("_part", F.shiftright("_n", 33))
    sums = tied.groupBy("_s", "_part").agg(F.count("*").alias("_c"))
    before = sums.select(F.col("_s").alias("_s3"), F.col("_part").alias("_p"), (F.sum("_c").over(Window.partitionBy("_s").orderBy("_part")) - F.col("_c")).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_s", "_part").orderBy("_n")) - 1
    tied = tied.withColumn("_k", number).join(before, F.col("_s").eqNullSafe(F.col("_s3")) & (F.col("_part") == F.col("_p"))).withColumn("_k", F.col("_k") + F.col("_before"))
    none = F.lit(0).cast("long")
    plain = rows.filter("_order <> 0").select("row", (F.col("_epochs") + F.when(F.col("_order") < 0, 1).otherwise(0)).alias("_copies"), none.alias("_cut"))
    at_end = tied.select("row", (F.col("_epochs") + F.when(F.col("_k") < F.col("_whole"), 1).otherwise(0)).alias("_copies"), F.when(F.col("_k") == F.col("_whole"), F.col("_left")).otherwise(none).alias("_cut"))
    joined = plain.unionByName(at_end)
    times = F.col("_copies") + (F.col("_cut") > 0).cast("long")
    taken = joined.filter(times > 0).withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    last = (F.col("_epoch") == F.col("_copies")) & (F.col("_cut") > 0)
    head = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(f"[ \\t\\n\\r\\f\\x0B]*{TOKEN}"), F.lit(0)), F.lit(1), F.col("_cut").cast("int")), "")
    row = F.col("row").withField("text", F.when(last, head).otherwise(F.col("row.text")))
    if "n_chars" in docs.columns:
        length = F.when(last, F.char_length(head)).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
        row = row.withField("n_chars", length)
    return unpacked(taken.select(row.alias("row")), docs)
