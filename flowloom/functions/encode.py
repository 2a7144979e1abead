"""Feature encodings as columns, and encoders that are fitted on training rows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Service port bins, first match wins; the last three are the remaining ranges.
PORT_BINS = [(80,), (443,), (53,), (22,), (20, 21), (25, 587), (3389,), (161, 162), (123,), (143, 993), (111,), (6881, 6882, 6883, 6884, 6885, 6886, 6887, 6888, 6889), (5190,)]
RANGES = [(0, 1023), (1024, 49151), (49152, 65535)]
N_BINS = 16


def port_bin(port: Column) -> Column:
    """Index 0 to 15 of a destination port's bin; null outside 0 to 65535. [H1]"""
    out = F.when(port.isin(*PORT_BINS[0]), 0)
    for i, ports in enumerate(PORT_BINS[1:], 1):
        out = out.when(port.isin(*ports), i)
    for i, (lo, hi) in enumerate(RANGES, len(PORT_BINS)):
        out = out.when(port.between(lo, hi), i)
    return out


def one_hot(index: Column, n: int) -> Column:
    """An array of n zeros and a one; all zeros for a null index."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == index, 1.0).otherwise(0.0))


def ephemeral_port(port: Column) -> Column:
    """1 for ports of 49152 or more. [H2]"""
    return (port >= 49152).cast("int")


def log_scale(x: Column) -> Column:
    """log(1 + x), negative values as 0. [H3]"""
    return F.log1p(F.greatest(x, F.lit(0.0)))


def is_internal_ip(ip: Column) -> Column:
    """Whether a dotted address is in 10/8, 172.16/12 or 192.168/16. [H7]"""
    parts = F.split(ip, r"\.")
    a, b = F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    inside = (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
    return F.coalesce((F.size(parts) == 4) & inside, F.lit(False))


def ip_number(ip: Column) -> Column:
    """A dotted address as a number; null if it isn't one."""
    parts = F.transform(F.split(ip, r"\."), lambda p: F.when(p.rlike(r"^\d{1,3}$"), p.try_cast("long")))
    good = (F.size(parts) == 4) & F.forall(parts, lambda p: F.coalesce(p <= 255, F.lit(False)))
    return F.when(good, F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p))


def in_any_prefix(ip: Column, prefixes: list[str]) -> Column:
    """Whether an address is in one of the CIDR prefixes; false if it isn't an address. [H8]"""
    number, out = ip_number(ip), F.lit(False)
    for prefix in prefixes:
        base, _, bits = prefix.partition("/")
        shift = 32 - int(bits or 32)
        start = int.from_bytes(bytes(map(int, base.split("."))), "big") >> shift
        out = out | (F.shiftright(number, shift) == start)
    return F.coalesce(out, F.lit(False))


def ip_type(ip: Column, loopback_first: bool = False) -> Column:
    """private, loopback, multicast or public, in that order of tests; 'invalid' otherwise. [H9]"""
    private = in_any_prefix(ip, ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8"])
    loop, multi = in_any_prefix(ip, ["127.0.0.0/8"]), in_any_prefix(ip, ["224.0.0.0/4"])
    first, name, second, other = (loop, "loopback", private, "private") if loopback_first else (private, "private", loop, "loopback")
    return F.when(ip_number(ip).isNull(), "invalid").when(first, name).when(second, other).when(multi, "multicast").otherwise("public")


def entropy(counts: Column) -> Column:
    """Shannon entropy in nats of an array of counts; 0 if all are 0. [H10]"""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.aggregate(counts, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / total * F.log(x / total)).otherwise(0.0))).otherwise(0.0)


def variation(xs: Column) -> Column:
    """Population deviation over mean of an array; 0 with fewer than one value or mean 0. [H11]"""
    n = F.size(xs)
    mean = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / n
    spread = F.sqrt(F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)
    return F.when((n > 0) & (mean > 0), spread / mean).otherwise(0.0)


def gaps(ts: Column) -> Column:
    """Differences of an array of times in order. [E5]"""
    ordered = F.array_sort(ts)
    return F.when(F.size(ordered) > 1, F.zip_with(F.slice(ordered, F.lit(2), F.size(ordered) - 1), F.slice(ordered, F.lit(1), F.size(ordered) - 1), lambda b, a: (b - a).cast("double"))).otherwise(F.array().cast("array<double>"))


def hour_of_day(ts: Column) -> Column:
    """Hours of the day, with fraction, of epoch milliseconds. [H12, H30]"""
    return F.pmod(ts / 3_600_000, F.lit(24.0))


def season(ts: Column) -> tuple[Column, Column]:
    """Sine and cosine of the time of day. [H12]"""
    angle = 2 * F.pi() * hour_of_day(ts) / 24
    return F.sin(angle), F.cos(angle)


def softmax(logits: Column) -> Column:
    """[H15]"""
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x))


def argmax(xs: Column) -> Column:
    """The first index of the largest value, from 0. [H15]"""
    return (F.array_position(xs, F.array_max(xs)) - 1).cast("int")


def masked(x: Column, background: Column, groups: list[list[int]], present: list[bool]) -> Column:
    """The features of absent groups replaced by the background's. [H13]"""
    gone = [i for group, kept in zip(groups, present) if not kept for i in group]
    return F.transform(x, lambda v, i: F.when(i.isin(gone), F.element_at(background, i + 1)).otherwise(v)) if gone else x


def check_groups(groups: dict[str, list[int]], width: int) -> None:
    """Raises unless the groups hold every index 0 to width - 1 exactly once. [H14]"""
    every = sorted(i for members in groups.values() for i in members)
    if every != list(range(width)):
        raise ValueError("the groups aren't a partition of the features")


def feature_groups(numeric: list[str], categorical: dict[str, int], width: int | None = None) -> dict[str, list[int]]:
    """The layout numeric, 16 destination bins, source flag, one-hot columns. [H14]"""
    groups, at = {}, 0
    for name, size in [*((n, 1) for n in numeric), ("DST_PORT", N_BINS), ("SRC_PORT", 1), *categorical.items()]:
        groups[name] = list(range(at, at + size))
        at += size
    check_groups(groups, at if width is None else width)
    return groups


def slug(text: Column) -> Column:
    """Lower-case letters and digits, other runs as one underscore, none at the ends. [H24]"""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def fit_scaler(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean and population deviation (1 where it is 0) of each column over training rows. [H4]"""
    scale = lambda c: F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(F.lit(1.0))
    return train.agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), scale(c).alias(f"{c}_scale"))])


def scale_with(df: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of all rows scaled by what ``fit_scaler`` found: one row, so a broadcast of fixed size. [H4]"""
    joined = df.join(F.broadcast(fitted), F.lit(True))
    return joined.select(*[((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_scale")).alias(c) if c in columns else c for c in df.columns])


def fit_categories(train: DataFrame, column: str, least_share: float = 0.001) -> DataFrame:
    """value, index: categories with at least that share of training rows; null is the category 'nan'. Rare ones share index 0. [H6]"""
    from flowloom.operators.ranges import running

    counts = train.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias("value")).agg(F.count("*").alias("n"))
    marked = counts.join(F.broadcast(counts.agg(F.sum("n").alias("_all"))), F.lit(True)).withColumn("often", F.col("n") >= F.col("_all") * F.lit(least_share))
    ranked = running(marked, F.col("often").cast("long"), ["value"], name="_rank")
    return ranked.select("value", F.when(F.col("often"), F.col("_rank")).otherwise(0).alias("index"))


def encode_categories(df: DataFrame, fitted: DataFrame, column: str) -> DataFrame:
    """``column``_index: the category's index, 0 for rare ones, null for values that training lacks (all zeros in one-hot). [H6]"""
    names = fitted.select(F.col("value").alias("_value"), F.col("index").alias(f"{column}_index"))
    return df.join(names, F.coalesce(F.col(column).cast("string"), F.lit("nan")) == F.col("_value"), "left").drop("_value")


def unscale_with(df: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """The inverse of ``scale_with``: scaled ``columns`` back in their own units. [M5]

    ValueError unless ``fitted`` is what ``fit_scaler`` made for at least these columns.
    """
    unknown = [c for c in columns if c not in df.columns or f"{c}_mean" not in fitted.columns or f"{c}_scale" not in fitted.columns]
    if unknown:
        raise ValueError(f"not scaled here: {unknown}")
    both = df.join(F.broadcast(fitted), F.lit(True))
    return both.select(*[(F.col(c) * F.col(f"{c}_scale") + F.col(f"{c}_mean")).alias(c) if c in columns else c for c in df.columns])


def decode_categories(df: DataFrame, fitted: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """The inverse of ``encode_categories``: adds ``name`` (``column``_decoded) for each ``column``_index. [M5]

    Index 0 stands for several rare values, so it, and a null index, decode to null; the category 'nan' stays a text. An
    index that ``fitted`` lacks is a null, too. The fitted table has a row per category that isn't rare: at most one over
    the least share it was fitted with.
    """
    back = fitted.filter("index > 0").select(F.col("index").alias("_index"), F.col("value").alias(name or f"{column}_decoded"))
    return df.join(F.broadcast(back), F.col(f"{column}_index") == F.col("_index"), "left").drop("_index")
