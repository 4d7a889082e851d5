"""Exact, repeatable sampling, splitting and balancing.

Every draw is a cut in one random order, ``md5(seed:id)``. The cut is found on
narrow (class, id) columns: count the keys per slice of the key space, find the
slice that holds the n-th key of each class, rank only that slice. The wide rows
are then chosen by comparing their own key with the cut: they are never sorted
nor shuffled, and the rows left over are the negated comparison.

``id_col`` names one column or several that tell the rows apart, such as ``["item_id", "draw"]`` of an
oversampled table. A cut that would fall between rows of one id fails: their order is not defined.
Rows without a label belong to no class: balancing and sampling per class leave them out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plurivote.functions.keys import bucket_of, hash32, order_key
from plurivote.session import settle, small_side

_WHOLE = "_whole"
_KEY = "_key"

Ids = str | Sequence[str]


def _ids(id_col: Ids) -> list[str]:
    return [id_col] if isinstance(id_col, str) else list(id_col)


def _id(id_col: Ids) -> Column:
    """The id as one value: the column, or a struct of several."""
    names = _ids(id_col)
    return F.col(names[0]) if len(names) == 1 else F.struct(*names)


def _id_literal(id_col: Ids, value) -> Column:
    names = _ids(id_col)
    return F.lit(value) if len(names) == 1 else F.struct(*[F.lit(value[n]).alias(n) for n in names])


def _keyed(df: DataFrame, id_col: Ids, seed, by: Sequence[str]) -> DataFrame:
    """Narrow rows: class columns, id, random key, slice of the key space."""
    classes = [F.col(c) for c in by] or [F.lit(0).alias(_WHOLE)]
    return df.select(*classes, _id(id_col).alias("_id"), order_key(seed, *_ids(id_col)).alias(_KEY)).withColumn(
        "_bucket", bucket_of(F.col(_KEY))
    )


def _slices(keyed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per class and slice, their running total and the rows of the class: at most
    65,536 rows per class."""
    counts = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    own = Window.partitionBy(*by)
    return counts.withColumn("_upto", F.sum("_rows").over(own.orderBy("_bucket"))).withColumn(
        "class_rows", F.sum("_rows").over(own)
    )


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    """Rows per class (null labels left out, as a grouped frame would)."""
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("class_rows"))


def rank_cuts(
    df: DataFrame, id_col: Ids, ranks: dict[str, Column | int], seed=1, by: Sequence[str] = (), least: Column | None = None
) -> DataFrame:
    """For each class the key of its n-th row in random order, one struct column per name.

    ``ranks`` maps an output name to n: a number, or an expression over ``class_rows`` (rows of the class) and, where
    ``least`` is given, ``least_rows`` (the least value of that expression over all classes). A cut of rank 0 is null. Fails
    when a class has fewer rows than asked.
    """
    by = list(by)
    keyed = _keyed(df, id_col, seed, by)
    for c in by:
        keyed = keyed.where(F.col(c).isNotNull())
    groups = by or [_WHOLE]
    slices = _slices(keyed, groups)
    if least is not None:
        slices = settle(slices)
        slices = slices.withColumn("least_rows", slices.select(F.min(least)).scalar())
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("_cut"), (n if isinstance(n, Column) else F.lit(n)).cast("bigint").alias("_n"))
            for name, n in ranks.items()
        ]
    )
    slices = slices.withColumn("_want", F.explode(wanted))
    slices = slices.select(*groups, "_bucket", "_rows", "_upto", "class_rows", "_want.*")
    # The slice that holds each cut, and the last slice of a class that is too small.
    short = F.col("_n") > F.col("class_rows")
    holds = (F.col("_upto") >= F.col("_n")) & (F.col("_upto") - F.col("_rows") < F.col("_n"))
    last = F.col("_upto") == F.col("class_rows")
    at = small_side(
        slices.where(holds | (short & last)).select(
            *groups, "_bucket", "_cut", "_n", "class_rows", (F.col("_n") - F.col("_upto") + F.col("_rows")).alias("_nth")
        ),
        short=True,
    )
    too_small = at.where(short).select(*by, "class_rows", F.col("_n").alias("wanted")).first()
    if too_small is not None:
        raise ValueError(f"cannot take more rows than there are: {too_small.asDict()}")
    if not by and any(not isinstance(n, Column) and n > 0 for n in ranks.values()) and at.first() is None:
        raise ValueError("cannot sample from an empty table")

    inside = keyed.join(at, groups + ["_bucket"])
    order = Window.partitionBy(*groups, "_bucket", "_cut").orderBy(_KEY, "_id")
    # A row that has its id's twin behind it cannot be a cut.
    twin = F.coalesce(F.lead("_id").over(order).eqNullSafe(F.col("_id")) & (F.lead(_KEY).over(order) == F.col(_KEY)), F.lit(False))
    nth = inside.withColumn("_rank", F.row_number().over(order)).withColumn("_twin", twin).where(F.col("_rank") == F.col("_nth"))
    cuts = nth.groupBy(*groups).agg(
        *[F.max(F.when(F.col("_cut") == name, F.struct(_KEY, "_id"))).alias(name) for name in ranks], F.max("_twin").alias("_twin")
    )
    cuts = small_side(cuts, short=True)
    if cuts.where("_twin").first() is not None:
        raise ValueError(f"{_ids(id_col)} repeats at a cut: name the columns that tell the rows apart")
    return cuts.drop("_twin")


def _at_or_before(row_key: Column, cut: Column) -> Column:
    return F.coalesce(row_key <= cut, F.lit(False))


def _with_cuts(df: DataFrame, id_col: Ids, cuts: DataFrame, names: Sequence[str], seed, by: Sequence[str]):
    """Attach the cuts: as literals for one class, else by a join on the class."""
    key = F.struct(order_key(seed, *_ids(id_col)).alias(_KEY), _id(id_col).alias("_id"))
    if by:
        return df.join(cuts, list(by), "left").withColumn("_own", key), {n: F.col(n) for n in names}
    row = cuts.first()
    literals = {}
    for n in names:
        value = row[n] if row is not None else None
        literals[n] = (
            F.struct(F.lit(value[_KEY]).alias(_KEY), _id_literal(id_col, value["_id"]).alias("_id")) if value is not None else F.lit(None)
        )
    return df.withColumn("_own", key), literals


def shuffle_order(df: DataFrame, id_col: Ids, seed=1, by: Sequence[str] = (), name: str = "position") -> DataFrame:
    """Number all rows 0, 1, 2 … in random order (inside each class when ``by`` is given).

    Rows are numbered inside slices of the key space and shifted by the slice's
    offset, so no task sees more than its slice, whatever the class sizes are.
    """
    by = list(by)
    rows = df.withColumn(_KEY, order_key(seed, *_ids(id_col))).withColumn("_bucket", bucket_of(F.col(_KEY)))
    groups = by
    if not by:
        rows, groups = rows.withColumn(_WHOLE, F.lit(0)), [_WHOLE]
    else:
        for c in by:
            rows = rows.where(F.col(c).isNotNull())
    offsets = _slices(_keyed(df, id_col, seed, by), groups).select(
        *groups, "_bucket", (F.col("_upto") - F.col("_rows")).alias("_offset")
    )
    order = Window.partitionBy(*groups, "_bucket").orderBy(_KEY, *_ids(id_col))
    return (
        rows.join(offsets, groups + ["_bucket"])
        .withColumn(name, F.col("_offset") + F.row_number().over(order) - 1)
        .drop(_KEY, "_bucket", "_offset", _WHOLE)
    )


def sample_n(df: DataFrame, id_col: Ids, n: int, seed=1) -> DataFrame:
    """Exactly n random rows without replacement."""
    cuts = rank_cuts(df, id_col, {"cut": n}, seed)
    rows, cut = _with_cuts(df, id_col, cuts, ["cut"], seed, ())
    return rows.where(_at_or_before(F.col("_own"), cut["cut"])).select(*df.columns)


def stratified_sample_n(df: DataFrame, id_col: Ids, label: str, n: int | Column, seed=1) -> DataFrame:
    """Exactly n random rows of every class; fails when a class is smaller."""
    cuts = rank_cuts(df, id_col, {"cut": n}, seed, [label])
    rows, cut = _with_cuts(df, id_col, cuts, ["cut"], seed, [label])
    return rows.where(_at_or_before(F.col("_own"), cut["cut"])).select(*df.columns)


def undersample_balance(df: DataFrame, id_col: Ids, label: str, seed=1) -> DataFrame:
    """Every class cut to the size of the smallest one."""
    cuts = rank_cuts(df, id_col, {"cut": F.col("least_rows")}, seed, [label], F.col("class_rows"))
    rows, cut = _with_cuts(df, id_col, cuts, ["cut"], seed, [label])
    return rows.where(_at_or_before(F.col("_own"), cut["cut"])).select(*df.columns)


def assign_split(
    df: DataFrame,
    id_col: Ids,
    test: int | float,
    validation: int | float,
    seed=1,
    label: str | None = None,
) -> DataFrame:
    """Add ``split``: test rows first in the random order, then validation, the rest train.

    Sizes are row counts, or shares when below 1; with ``label`` they hold per class.
    """
    by = [label] if label else []
    ranks = {"cut_test": _share(test), "cut_validation": _share(test) + _share(validation)}
    cuts = rank_cuts(df, id_col, ranks, seed, by)
    rows, cut = _with_cuts(df, id_col, cuts, list(ranks), seed, by)
    own = F.col("_own")
    split = (
        F.when(_at_or_before(own, cut["cut_test"]), "test")
        .when(_at_or_before(own, cut["cut_validation"]), "validation")
        .otherwise("train")
    )
    return rows.withColumn("split", split).select(*df.columns, "split")


def _share(n: int | float) -> Column:
    """A number of rows, or a share of the class below 1."""
    return F.floor(F.col("class_rows") * F.lit(float(n))) if isinstance(n, float) and n < 1 else F.lit(int(n))


def _split_evenly(df: DataFrame, id_col: Ids, label: str, test: int | float, validation: int | float, train: int | None, seed) -> DataFrame:
    """Test, validation and equally many train rows of every class (``train``, or what the smallest class has left).

    All three parts are stretches of one random order, so one search finds all cuts.
    """
    before = _share(test) + _share(validation)
    left = F.col("class_rows") - before
    wanted = F.when(left > 0, F.col("least_rows") if train is None else F.lit(train)).otherwise(0)
    ranks = {"cut_test": _share(test), "cut_validation": before, "cut_train": before + wanted}
    least = F.when(left > 0, left) if train is None else None
    cuts = rank_cuts(df, id_col, ranks, seed, [label], least)
    rows, cut = _with_cuts(df, id_col, cuts, list(ranks), seed, [label])
    own = F.col("_own")
    names = {"test": "cut_test", "validation": "cut_validation", "train": "cut_train"}
    split = F.coalesce(*[F.when(_at_or_before(own, cut[c]), name) for name, c in names.items()])
    return rows.withColumn("split", split).where("split IS NOT NULL").select(*df.columns, "split")


def oversample_balance(
    df: DataFrame, id_col: Ids, label: str, seed=1, keep_original: bool = False
) -> DataFrame:
    """Bring every class to the size of the largest one by drawing with replacement.

    The largest class stays whole (lowest label on ties) with ``draw`` null. Each
    other class is *replaced* by that many draws, numbered in ``draw``; with
    ``keep_original`` its rows stay (``draw`` null) and only the missing rows are
    drawn. Draw d of a class takes its row number ``hash(seed:label:d) % rows``.
    """
    spark = df.sparkSession
    sizes = small_side(class_sizes(df, label), short=True)
    # The least struct is the class with the most rows, the lowest label among equals.
    top = sizes.agg(
        F.min(F.struct((-F.col("class_rows")).alias("less"), F.col(label).alias("label"))).alias("largest"),
        F.count(F.lit(1)).alias("classes"),
    ).first()
    if top["classes"] == 0:
        return df.withColumn("draw", F.lit(None).cast("bigint"))
    most, largest = -top["largest"]["less"], F.lit(top["largest"]["label"])
    whole = df.where(F.col(label) == largest)
    others = df.where(F.col(label) != largest)
    minority = sizes.where(F.col(label) != largest)

    # One row per draw, made in parallel; each takes the classes that still need it.
    needed = F.lit(most) - F.col("class_rows") if keep_original else F.lit(most)
    wanted = minority.select(F.col(label), "class_rows", needed.cast("bigint").alias("_draws"))
    chunk = 1 << 16
    chunks = (top["classes"] - 1) * (most // chunk + 1)
    tasks = max(1, min(chunks, 4 * spark.sparkContext.defaultParallelism))
    draws = (
        wanted.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_draws") - 1) / chunk))))
        .where(F.col("_draws") > 0)
        .repartition(tasks, "_chunk", label)
        .withColumn(
            "draw",
            F.explode(
                F.sequence(
                    F.col("_chunk") * chunk + 1, F.least(F.col("_draws"), (F.col("_chunk") + 1) * chunk)
                )
            ),
        )
        .select(label, "draw", (hash32(seed, label, "draw") % F.col("class_rows")).alias("_row"))
    )
    # Narrow draws find their id; the wide rows are joined to the drawn ids, and not measured first.
    names = _ids(id_col)
    numbered = shuffle_order(others.select(*dict.fromkeys([*names, label])), id_col, seed, [label], "_row")
    picked = draws.join(numbered, [label, "_row"]).select(*dict.fromkeys([*names, label]), "draw")
    drawn = picked if set(df.columns) <= {*names, label} else others.join(picked, list(dict.fromkeys([*names, label])))
    drawn = drawn.select(*df.columns, "draw")
    kept = whole.unionByName(others) if keep_original else whole
    return kept.withColumn("draw", F.lit(None).cast("bigint")).unionByName(drawn)


def three_way_split(
    df: DataFrame,
    id_col: Ids,
    label: str,
    test: int | float,
    validation: int | float,
    seed=1,
    per_class: bool = False,
    balance: str | int | None = None,
) -> DataFrame:
    """Test, then validation, then the (balanced) train rows, in a ``split`` column.

    ``balance`` applies to train only, after the other two are cut, so no copy can
    leak: ``"under"``, ``"over"``, a number of rows per class, or None. With ``balance``
    or ``per_class`` rows without a label are left out of all three parts.
    """
    if balance is not None or per_class:
        df = df.where(F.col(label).isNotNull())
    if per_class and balance is not None and balance != "over":
        return _split_evenly(df, id_col, label, test, validation, None if balance == "under" else int(balance), seed)
    # The parts are cut on ids and labels; with a narrow table they are computed once for all that follows.
    parts = assign_split(df, id_col, test, validation, seed, label if per_class else None)
    if set(df.columns) <= {*_ids(id_col), label}:
        parts = settle(parts)
    held_out = parts.where(F.col("split") != "train")
    train = parts.where(F.col("split") == "train")
    if balance == "over":
        train = oversample_balance(train, id_col, label, seed)
        held_out = held_out.withColumn("draw", F.lit(None).cast("bigint"))
    elif balance == "under":
        train = undersample_balance(train, id_col, label, seed)
    elif balance is not None:
        train = stratified_sample_n(train, id_col, label, int(balance), seed)
    return held_out.unionByName(train)


def hold_out_labelled(splits: DataFrame, id_col: Ids, label: str, share: float, seed=1) -> DataFrame:
    """For a data set whose given test split has no labels: drop that split's rows, and cut a new
    test part, ``share`` of them, from the labelled train rows. Other splits stay as they are.
    """
    labelled = splits.where(F.col(label).isNotNull())
    train = labelled.where(F.col("split") == "train").drop("split")
    cut = assign_split(train, id_col, share, 0, seed)
    others = labelled.where(~F.col("split").isin("train", "test"))
    given = labelled.where(F.col("split") == "test")
    return cut.unionByName(others).unionByName(given)
