"""Rarity groups, splits and samples, each with a declared order so that a repeated run gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def code_frequency(visits: DataFrame, *columns: str) -> DataFrame:
    """(code, n): occurrences over all rows of one or several array columns; an occurrence counts each time."""
    return visits.select(F.explode(F.concat(*columns)).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def ranked(frequency: DataFrame, key: str = "code", by: str = "n") -> DataFrame:
    """Adds position (from 0, rarest first, ties by key) and total. For dimension tables: codes, not patients."""
    w = Window.orderBy(by, key)
    return frequency.withColumn("position", (F.row_number().over(w) - 1).cast("long")).withColumn("total", F.count("*").over(Window.partitionBy()))


def head_tail(frequency: DataFrame, threshold: float) -> DataFrame:
    """``side``: tail for the ceil(threshold * total) rarest codes, head for the rest."""
    r = ranked(frequency)
    return r.withColumn("side", F.when(F.col("position") < F.ceil(F.col("total") * F.lit(threshold)), "tail").otherwise("head"))


def terciles(frequency: DataFrame) -> DataFrame:
    """``grp`` 0, 1 or 2 by the positions cut at int(k/3 * total)."""
    r = ranked(frequency)
    cut = lambda k: (F.lit(k / 3) * F.col("total")).cast("int")
    return r.withColumn("grp", F.when(F.col("position") < cut(1), 0).when(F.col("position") < cut(2), 1).otherwise(2))


def first_matching_group(rows: DataFrame, key: str, column: str, groups: DataFrame) -> DataFrame:
    """(key, grp): the lowest group that has any code of the array column."""
    return rows.select(key, F.explode(column).alias("code")).join(groups.select("code", "grp"), "code").groupBy(key).agg(F.min("grp").alias("grp"))


def hashed(*parts: Column | str) -> Column:
    """An order that any engine can repeat: md5 of the parts joined by a dash."""
    return F.md5(F.concat_ws("-", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts)))


def hashed_position(rows: DataFrame, key: str, seed: int, group: str | None = None) -> DataFrame:
    """Adds ``position``, a row's place in the hashed order of ``key`` (in its group, if given), and ``total``, the number of rows.

    The order is cut by the first four hex digits: a position is a count of earlier buckets (65,536 numbers a
    group at most) and a number within the bucket, so no task sorts a whole table or group. Rows without a group are one group.
    """
    by = [group] if group else []
    h = rows.withColumn("_h", hashed(key, F.lit(seed))).withColumn("_b", F.substring("_h", 1, 4))
    sizes = h.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    over = Window.partitionBy(*by).orderBy("_b")
    before = sizes.select(*(F.col(c).alias("_g") for c in by), F.col("_b").alias("_c"), (F.sum("_n").over(over) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(*by)).alias("total"))
    inner = h.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key)))
    same = F.col("_b") == F.col("_c")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col("_g"))
    return inner.join(before, same).withColumn("position", F.col("_before") + F.col("_r") - 1).drop("_h", "_b", "_r", "_before", "_c", "_g")


def ordered_position(rows: DataFrame, key: str, group: str | None = None) -> DataFrame:
    """Adds ``position``, a row's place by ``key`` (in its group, if given), and ``total``, the number of rows.

    Rows are dealt into ranges of group and key and written to the shared folder; a position is the number of rows of
    the group in earlier ranges and a number within the range, so no task orders a whole table or group. Equal keys
    may take any order among themselves.
    """
    from .agent import _stored

    by = [group] if group else []
    ranged = _stored(rows.repartitionByRange(*by, key, F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    over = Window.partitionBy(F.lit(0), *by).orderBy("_range")  # a row a range
    before = sizes.select(*(F.col(c).alias("_g") for c in by), F.col("_range").alias("_c"), (F.sum("_n").over(over) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0), *by)).alias("total"))
    same = F.col("_range") == F.col("_c")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col("_g"))
    inner = ranged.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(key)))
    return inner.join(before, same).withColumn("position", F.col("_before") + F.col("_r") - 1).drop("_range", "_r", "_before", "_c", "_g")


def split_keys(keys: DataFrame, key: str, ratios: tuple[float, float], seed: int, train_ratio: float = 1.0) -> DataFrame:
    """``split`` train, val or test: the hashed order cut at int(n * r0) and int(n * (r0 + r1)).

    With a ``train_ratio`` below 1 only int(train keys * train_ratio) stay in train; the others are ``unused``.
    """
    r = hashed_position(keys, key, seed)
    cut = lambda x: (F.col("total") * F.lit(x)).cast("long")
    own = (cut(ratios[0]) * F.lit(train_ratio)).cast("long")
    return r.withColumn("split", F.when(F.col("position") < own, "train").when(F.col("position") < cut(ratios[0]), "unused").when(F.col("position") < cut(ratios[0] + ratios[1]), "val").otherwise("test"))


def row_indexes(rows: DataFrame, group: str, key: str) -> DataFrame:
    """(group, indexes, n, least): the places of each group's rows in the order of ``key`` among all rows, and the fewest that any group has.

    Groups are patients: their rows are few.
    """
    placed = ordered_position(rows.select(group, key), key)
    g = placed.groupBy(group).agg(F.array_sort(F.collect_list("position")).alias("indexes"), F.count("*").alias("n"))
    return g.join(F.broadcast(g.agg(F.min("n").alias("least"))))  # one row


def drop_last(rows: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """Rows in hashed order, in batches of ``size``; the incomplete last batch goes. Adds ``batch``."""
    r = hashed_position(rows, key, seed)
    return r.withColumn("batch", F.floor(F.col("position") / size)).where(F.col("position") < F.floor(F.col("total") / size) * size)


def per_group_sample(rows: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """The first ``n`` rows of each group in hashed order."""
    w = Window.partitionBy(group).orderBy(hashed(key, F.lit(seed)), key)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def join_group_rows(rows: DataFrame, one: DataFrame, group: str, key: str, most: int = 1024) -> DataFrame:
    """Rows with the columns of their group's only row in ``one``; rows whose group is null or not there go.

    A group of more than ``most`` rows is dealt into parts by the hash of ``key``, and its row in ``one`` goes to each part, so
    no task gets a large group whole. Broadcast are the names of such groups: one for ``most`` rows at most.
    """
    large = rows.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(group, F.ceil(F.col("_n") / most).alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(F.broadcast(large), group, "left").withColumn("_part", F.pmod(F.xxhash64(key), parts)).drop("_parts")
    copies = one.join(F.broadcast(large), group, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return dealt.join(copies, [group, "_part"]).drop("_part")


def sample_if_many(rows: DataFrame, group: str, key: str, most: int, n: int, seed: int) -> DataFrame:
    """Groups of fewer than ``most`` rows whole, of larger ones the first ``n`` in hashed order."""
    placed = hashed_position(rows, key, seed, group)
    return placed.where((F.col("total") < most) | (F.col("position") < n)).drop("position", "total")


def smallest_groups(rows: DataFrame, label: str, k: int) -> DataFrame:
    """(label, n): the ``k`` labels of fewest rows, ties by label."""
    return rows.groupBy(label).agg(F.count("*").alias("n")).orderBy("n", label).limit(k)


def bernoulli(key: str, seed: int, p: float) -> Column:
    """True with chance ``p``, from the hash of the key: its first eight hex digits against p * 2**32."""
    return F.conv(F.substring(hashed(key, F.lit(seed)), 1, 8), 16, 10).cast("long") < F.lit(int(p * 2**32))


def balance(rows: DataFrame, label: str, key: str, caps: Column, seed: int = 0) -> DataFrame:
    """Rows of each label up to a cap, in hashed order; caps may use n_label (rows of the label) and n_least (of the rarest one)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n_label"))
    counts = counts.withColumn("n_least", F.min("n_label").over(Window.partitionBy()))
    out = hashed_position(rows, key, seed, label).join(counts, label)
    return out.where(F.col("position") < caps).drop("position", "total", "n_label", "n_least")


def oversample(rows: DataFrame, times: Column) -> DataFrame:
    """Each row ``times`` times; adds ``copy`` from 1."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))


def interleave(parts: list[DataFrame], key: str, until: str = "under", seed: int = 0) -> DataFrame:
    """Rows of several tables in turns by their hashed order.

    ``under`` stops with the shortest table; ``over`` goes on to the longest and starts shorter ones again.
    Adds turn (from 0) and part.
    """
    numbered = [hashed_position(p, key, seed).withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    sizes = numbered[0].agg(F.count("*").alias("n"))
    for n in numbered[1:]:
        sizes = sizes.union(n.agg(F.count("*").alias("n")))
    bounds = F.broadcast(sizes.agg(F.max("n").alias("most"), F.min("n").alias("least")))  # one row
    out = None
    for n in numbered:
        n = n.join(bounds)
        if until == "under":
            n = n.where(F.col("position") < F.col("least")).withColumn("turn", F.col("position"))
        else:
            n = n.withColumn("turn", F.explode(F.sequence(F.col("position"), F.col("most") - 1, F.col("total"))))
        n = n.drop("most", "least", "total", "position")
        out = n if out is None else out.unionByName(n)
    return out


#: Draws that are counted together.
DRAW_BLOCK = 4096


def _draws(spark: SparkSession, n: int, weights: list[float], seed: int) -> DataFrame:
    """turn (from 0 below ``n``), its block, and part: the one in whose share of the weights the hash of turn and seed falls."""
    total, upto, cut = sum(weights), 0.0, []
    for w in weights:
        upto += w
        cut.append(int(upto / total * 2**32))
    at = F.conv(F.substring(hashed("turn", F.lit(seed)), 1, 8), 16, 10).cast("long")
    part = F.lit(len(weights) - 1)
    for i in range(len(weights) - 2, -1, -1):
        part = F.when(at < cut[i], i).otherwise(part)
    return spark.range(n).select(F.col("id").alias("turn")).withColumn("part", part.cast("int")).withColumn("block", F.floor(F.col("turn") / DRAW_BLOCK))


def interleave_by_weight(parts: list[DataFrame], weights: list[float], key: str, until: str = "under", seed: int = 0) -> DataFrame:
    """Rows of several tables in a seeded random order, each turn from the table that is drawn with its weight.

    The k-th turn of a table takes its k-th row in hashed order, from the start again after the last. ``under`` ends
    with the turn that takes the last row of any table, ``over`` with the first turn by which every table has given all
    its rows. Adds turn (from 0) and part. Turns are drawn and counted block by block, so no task orders them all. A
    table without rows ends ``under`` at once and is left out of ``over``; all weights are above 0.
    """
    if len(parts) != len(weights) or min(weights) <= 0:
        raise ValueError("a weight above 0 for each table")
    spark = parts[0].sparkSession
    numbered = [hashed_position(p, key, seed).withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    have = [p.count() for p in parts]  # one number a table
    live = [i for i, n in enumerate(have) if n]
    rows = None
    for n in numbered:
        rows = n if rows is None else rows.unionByName(n)
    if not live or (until == "under" and len(live) < len(parts)):
        return rows.drop("position", "total").withColumn("turn", F.lit(0).cast("long")).limit(0)
    ask = max if until == "over" else min
    n, total = int(1.2 * ask(have[i] / weights[i] for i in live) * sum(weights)) + DRAW_BLOCK, None
    while True:
        draws = _draws(spark, n, weights, seed)
        per = draws.groupBy("part", "block").agg(F.count("*").alias("n"))
        before = per.withColumn("before", F.sum("n").over(Window.partitionBy("part").orderBy("block")) - F.col("n"))
        placed = draws.withColumn("_k", F.row_number().over(Window.partitionBy("part", "block").orderBy("turn"))).join(before.drop("n"), ["part", "block"]).withColumn("nth", F.col("before") + F.col("_k") - 1)
        size = F.element_at(F.array(*(F.lit(h).cast("long") for h in have)), F.col("part") + 1)
        ends = {r["part"]: r["turn"] for r in placed.where(F.col("nth") == size - 1).select("part", "turn").collect()}  # a row a table
        if (until == "over" and all(i in ends for i in live)) or (until != "over" and ends):
            total = ask(ends[i] for i in live if i in ends)
            break
        n *= 2
    chosen = placed.where(F.col("turn") <= total).where(size > 0).withColumn("position", F.col("nth") % size).select("turn", "part", "position")
    return rows.drop("total").join(chosen, ["part", "position"]).drop("position")


def validation_split(rows: DataFrame, key: str, size: float, seed: int = 0) -> DataFrame:
    """``split`` val or train: ``size`` rows (from 1 on) or that fraction of the rows, rounded up, for validation, in hashed order.

    At least one row stays in train; a size of 0 gives train rows only.
    """
    if size < 0 or (size >= 1 and size != int(size)):
        raise ValueError("a whole number of rows, or a fraction below 1")
    r = hashed_position(rows, key, seed)
    n = F.lit(int(size)) if size >= 1 else F.ceil(F.col("total") * F.lit(float(size)))
    return r.withColumn("split", F.when(F.col("position") < F.least(n.cast("long"), F.col("total") - 1), "val").otherwise("train")).drop("position", "total")


#: Terminal and pathless rows for each row of a capped kind, by source and task; a hundred elsewhere.
CAP_DIVISORS = {"MIII-LOS": 200, "MIV-LOS": 500}
#: Kinds of rows that some sources and tasks leave out of their mix.
LEFT_OUT = {"MIV-MOR": ("sub_response",), "eICU-LOS": ("sub_response", "meta_chose")}


def training_mix(rows: DataFrame, key: str, name: str, label: str | None = None, times: int = 1, divisor: int | None = None, seed: int = 0, kind: str = "kind", output: str = "output") -> DataFrame:
    """Instruction rows of all kinds as one training set; adds ``copy`` (from 1) and ``place``, a hash to order them by.

    ``name`` is source and task (``MIII-LOS``). Kinds rewrite, followup, sub_response, meta_chose, final_answer and
    decision have as many rows, in hashed order, as there are terminal and no_gold_path rows for ``divisor`` (see
    ``CAP_DIVISORS``); summaries have of these final_answer and decision only. Terminal and no_gold_path rows are all
    taken. With a ``label`` (yes or no) decisions go, and if ``times`` is above 1 (other than for readmission) terminal rows are balanced: as many of that output as of
    all others, ``times`` times. Unknown kinds go; keys tell rows of a kind apart.
    """
    source_task = name.split("-")[-1]
    short = {"final_answer"} | (set() if source_task == "SUMMARY" else {"rewrite", "followup", "sub_response", "meta_chose"} - set(LEFT_OUT.get(name, ())))
    if label not in ("yes", "no"):
        short.add("decision")
    balanced = label in ("yes", "no") and times > 1 and name not in ("MIII-REA", "MIV-REA")
    right = F.col(output) == F.lit(label)
    group = F.concat_ws("/", F.col(kind), F.when(F.lit(balanced) & (F.col(kind) == "terminal"), F.when(right, "own").otherwise("other")).otherwise(""))
    placed = hashed_position(rows.withColumn("_group", group), key, seed, "_group")
    counts = rows.agg(F.count_if(F.col(kind).isin("terminal", "no_gold_path")).alias("_all"), F.least(F.count_if((F.col(kind) == "terminal") & right), F.count_if((F.col(kind) == "terminal") & ~F.coalesce(right, F.lit(False)))).alias("_least"))
    joined = placed.join(F.broadcast(counts))  # one row
    cap = F.floor(F.col("_all") / (divisor or CAP_DIVISORS.get(name, 100)))
    terminal = (F.col("position") < F.col("_least")) if balanced else F.lit(True)
    keep = (F.col(kind).isin(*sorted(short)) & (F.col("position") < cap)) | ((F.col(kind) == "terminal") & terminal) | (F.col(kind) == "no_gold_path")
    many = F.when(F.lit(balanced) & (F.col(kind) == "terminal") & right, times).otherwise(1)
    out = oversample(joined.where(keep), many).withColumn("place", hashed(key, "copy", F.lit(seed)))
    return out.drop("_group", "position", "total", "_all", "_least")
