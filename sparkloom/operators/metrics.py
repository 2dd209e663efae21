"""Classification metrics and windows over a prediction log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions.draws import digest_number
from sparkloom.operators.ordered import running_sums
from sparkloom.shipping import checkpoint

WINDOW = 300
MOST_LISTED = 5000
#: Classes of a split up to which their bounds are broadcast.
MOST_CLASSES = 100_000


def classification(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """One row: confusion counts, accuracy, precision, recall, f1; a ratio without a denominator is 0."""

    def n(actual: int, said: int) -> Column:
        return F.count_if((F.col(label) == actual) & (F.col(predicted) == said))

    c = df.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("*", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row ``auc`` from ranks, ties counting half; null with one class only. Equal scores are counted
    first, and ranks are running sums over ranges."""
    counted = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    upto = running_sums(counted, [], "s", ["neg"])
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") + F.col("neg") / 2.0))
    sums = upto.agg(wins.alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select(F.try_divide("wins", F.col("p") * F.col("n")).alias("auc"))


def recent(log: DataFrame, n: int = WINDOW) -> DataFrame:
    """The newest ``n`` rows of each run by time, then id. Tasks keep ``n`` rows a run before the shuffle."""
    w = W.partitionBy("run_id").orderBy(F.col("ts").desc(), F.col("id").desc())
    return log.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def rolling_accuracy(log: DataFrame, n: int = 100) -> DataFrame:
    """(run_id, n_labelled, accuracy) over the labelled among each run's newest ``n`` rows."""
    hit = F.when(F.col("actual_label").isNotNull(), (F.col("prediction") == F.col("actual_label")).cast("double"))
    return recent(log, n).groupBy("run_id").agg(F.count("actual_label").alias("n_labelled"), F.avg(hit).alias("accuracy"))


def positive_rate(log: DataFrame) -> DataFrame:
    return log.groupBy("run_id").agg(F.count("*").alias("n"), F.coalesce(F.avg(F.col("prediction").cast("double")), F.lit(0.0)).alias("positive_rate"))


def listing(log: DataFrame, run_id: int, n: int = 100, newest_first: bool = True) -> DataFrame:
    """A capped listing of one run's predictions: at most ``n`` and at most MOST_LISTED rows."""
    order = [F.col("ts").desc(), F.col("id").desc()] if newest_first else [F.col("ts").asc(), F.col("id").asc()]
    return log.where(F.col("run_id") == run_id).orderBy(*order).limit(min(n, MOST_LISTED))


def align(log: DataFrame, columns: list[str]) -> DataFrame:
    """The features map as numeric columns in order: unknown ones dropped, missing and bad ones 0."""
    return log.select("id", *[F.coalesce(F.try_element_at("features", F.lit(c)).try_cast("double"), F.lit(0.0)).alias(c) for c in columns])


def stratified_split(df: DataFrame, label: str, id_col: str, share: float = 0.8, seed: str = "42", bits: int = 16) -> DataFrame:
    """``df`` with ``in_train``: of n rows, n - ceil(n (1 - share)) train, each class by its share.

    Classes get the whole part of theirs, the rest goes to the largest remainders. Within a class the rows
    of the smallest digest of seed and id train, ties by id (rows that repeat an id go where it goes).
    Digests are counted in 2^bits cells, so that only the rows of each class's last cell are ranked. A
    null label is a class of its own; a null id has the largest digest.
    """
    key = F.coalesce(digest_number(F.col(id_col), seed), F.lit((1 << 32) - 1))
    cell = F.shiftright(key, 32 - bits).cast("int")
    # without nulls: joins on it are plain ones; the mark keeps a null apart from any text
    kind = F.coalesce(F.concat(F.lit("1"), F.col(label).cast("string")), F.lit("0"))
    rows = df.select(kind.alias("kind"), key.alias("key"), cell.alias("cell"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"))
    cells = checkpoint(rows.groupBy("kind", "cell").agg(F.count("*").alias("n")))
    kinds = cells.groupBy("kind").agg(F.sum("n").alias("n"))
    n_train = F.col("all") - F.ceil(F.round(F.col("all") * (1 - share), 6)).cast("long")
    part = kinds.crossJoin(F.broadcast(kinds.agg(F.sum("n").alias("all")))).select("kind", "all", n_train.alias("n_train"), (n_train * F.col("n") / F.col("all")).alias("quota"))
    part = checkpoint(part.withColumn("least", F.floor("quota")).withColumn("left", F.round(F.col("quota") - F.col("least"), 9)))
    # what is left over goes to the classes of the largest remainders: those above the one at which it runs out
    by_left = running_sums(part.groupBy((-F.col("left")).alias("o")).agg(F.count("*").alias("n")), [], "o", ["n"])
    rest = part.agg((F.max("n_train") - F.sum("least")).alias("rest"))
    edge = by_left.join(F.broadcast(rest)).where("n_upto >= rest and n_upto - n < rest").select((-F.col("o")).alias("edge"), (F.col("rest") - F.col("n_upto") + F.col("n")).alias("room"))  # one row at most
    at_edge = part.join(F.broadcast(edge), F.col("left") == F.col("edge"))
    tied = at_edge.withColumn("r", F.row_number().over(W.orderBy("kind"))).where("r <= room").select(F.col("kind").alias("tied"))
    above = part.join(F.broadcast(edge)).where("left > edge").select(F.col("kind").alias("tied"))
    more = checkpoint(tied.unionByName(above))
    take = part.join(more, F.col("kind") == F.col("tied"), "left").select("kind", (F.col("least") + F.when(F.col("tied").isNotNull(), 1).otherwise(0)).alias("take"))
    upto = F.sum("n").over(W.partitionBy("kind").orderBy("cell"))
    placed = cells.withColumn("upto", upto).join(take, "kind")
    last = checkpoint(placed.where("upto - n < take and upto >= take").select("kind", "cell", (F.col("take") - F.col("upto") + F.col("n")).alias("room")))
    ranked = rows.join(F.broadcast(last) if last.limit(MOST_CLASSES + 1).count() <= MOST_CLASSES else last, ["kind", "cell"]).withColumn("r", F.row_number().over(W.partitionBy("kind").orderBy("key", "id")))
    bounds = checkpoint(ranked.where("r = room").select(F.col("kind").alias("kind_"), F.struct("key", "id").alias("bound_")))  # a row a class
    mine = F.struct(key.alias("key"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"))
    told = df.withColumns({"mine_": mine, "own_": kind})
    few = F.broadcast(bounds) if bounds.limit(MOST_CLASSES + 1).count() <= MOST_CLASSES else bounds
    joined = told.join(few, F.col("own_") == F.col("kind_"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(F.col("mine_") <= F.col("bound_"), F.lit(False)).alias("in_train"))
