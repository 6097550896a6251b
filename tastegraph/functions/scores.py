"""Rating statistics, normalisation and fixed-point values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DONE = (2, 4)
SCALE = 32


def user_stats(ratings: DataFrame, by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Mean, population deviation (1 where there is none) and least rating over rated finished and dropped items.

    The variance is tested for zero in whole numbers, so equal ratings never leave a rest.
    """
    done = F.col("status").isin(*DONE)
    rated = done & (F.col("rating") != 0)
    r = F.when(rated, F.col("rating").cast("long"))
    sums = ratings.groupBy(*by).agg(
        F.count(r).alias("n"), F.coalesce(F.sum(r), F.lit(0)).alias("s"), F.coalesce(F.sum(r * r), F.lit(0)).alias("ss"), F.coalesce(F.min(r), F.lit(0)).alias("least"),
        F.count_if(F.col("status") == 2).alias("completed"), F.count_if(F.col("status") == 4).alias("dropped"),
    )
    spread = F.col("n") * F.col("ss") - F.col("s") * F.col("s")
    return sums.select(
        *by, "n", "least", "completed", "dropped",
        F.when(F.col("n") == 0, 0.0).otherwise(F.try_divide(F.col("s").cast("double"), "n")).alias("mean"),
        F.when(spread == 0, 1.0).otherwise(F.try_divide(F.sqrt(spread.cast("double")), "n")).alias("dev"),
    )


def normalized(w: float = 0.0, d: float = 0.0) -> Column:
    """Normalised rating from ``rating, status, mean, dev, least``; w and d set what unrated finished and dropped items count."""
    return (
        F.when(F.col("rating") > 0, (F.col("rating") - F.col("mean") + w) / F.col("dev"))
        .when(F.col("status") == 2, F.lit(w) / F.col("dev"))
        .when(F.col("status") == 4, (F.col("least") + d - F.col("mean")) / F.col("dev"))
        .otherwise(0.0)
    )


def quantized(x: Column) -> Column:
    """x in 32nds, cut towards zero and held in a signed byte."""
    return F.greatest(F.lit(-128), F.least(F.lit(127), (x * SCALE).cast("int")))


def dequantized(q: Column) -> Column:
    """The value that a number of 32nds stands for."""
    return q / float(SCALE)


def scored(ratings: DataFrame, w: float = 0.0, d: float = 0.0, by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Finished and dropped ratings with ``norm`` and ``q``."""
    done = ratings.where(F.col("status").isin(*DONE)).join(user_stats(ratings, by), list(by))
    return done.withColumn("norm", normalized(w, d)).withColumn("q", quantized(F.col("norm")))


def activity_bucket(count: Column) -> Column:
    """Fifteen-wide buckets up to 180, 45-wide beyond."""
    return F.when(count < 180, F.floor(count / 15)).otherwise(8 + F.floor(count / 45))


def bucket_start(bucket: Column) -> Column:
    """The least count that lies in an activity bucket."""
    return F.when(bucket < 12, bucket * 15).otherwise((bucket - 8) * 45)


def season(epoch: Column) -> Column:
    """Season and year in Tokyo; the third quarter is Fall and the fourth Winter."""
    at = F.from_utc_timestamp(F.timestamp_seconds(epoch), "Asia/Tokyo")
    name = F.when(F.month(at) <= 3, "Winter").when(F.month(at) <= 6, "Spring").when(F.month(at) <= 9, "Fall").otherwise("Winter")
    return F.when(F.coalesce(epoch, F.lit(0)) == 0, "Unknown season").otherwise(F.concat_ws(" ", name, F.year(at)))


def adjusted_date(text: Column) -> Column:
    """No date for all zeros; an unknown day counts as the first."""
    return F.when(text == "0000-00-00", None).otherwise(F.regexp_replace(text, "-00$", "-01"))


def short_date(text: Column) -> Column:
    """MM-DD-YY to ISO: decades below 5 lie in this century; nothing gives all zeros, another form is an error."""
    m, d, y = F.substring(text, 1, 2), F.substring(text, 4, 2), F.substring(text, 7, 2)
    iso = F.concat(F.when(y < "50", "20").otherwise("19"), y, F.lit("-"), m, F.lit("-"), d)
    return F.when(text.isNull(), "0000-00-00").when(text.rlike("^..-..-..$"), iso).otherwise(F.raise_error(F.concat(F.lit("unknown date "), text)).cast("string"))


def day_of(epoch: Column, status: Column) -> Column:
    """Days since 1970 of the last change of a finished or dropped item; 0 for other items."""
    return F.when(status.isin(*DONE), F.floor(epoch / 86400)).otherwise(0)


def latest_change(profile: Column, times: Column) -> Column:
    """The profile's time of change if there is one, else the latest of the list's ``times``, else 0."""
    return F.when(F.coalesce(profile, F.lit(0)) != 0, profile).otherwise(F.coalesce(F.array_max(times), F.lit(0)))


def unpacked(text: Column) -> Column:
    """Bytes of base64 text; null where it is none."""
    return F.try_to_binary(text, F.lit("base64"))


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def letter(title: Column) -> Column:
    """First letter of a title; digits and titles without letters go under 0."""
    first = F.regexp_extract(F.upper(title), "[A-Z0-9]", 0)
    return F.when(first.rlike("[A-Z]"), first).otherwise("0")


def similar_activity(a: Column, b: Column) -> Column:
    """Whether two counts of finished items are near enough for two users to be compared."""
    low, high = F.least(a, b), F.greatest(a, b)
    return F.when(low == 0, False).when((low < 5) & (high < 10), True).otherwise(high < 2 * low)


def http_date(text: Column) -> Column:
    """Epoch seconds of the three HTTP date formats; 0 where none fits. Weekday names are passed over."""
    body = F.regexp_replace(text, r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? +", "")
    forms = ("dd MMM yyyy HH:mm:ss 'GMT'", "dd-MMM-yy HH:mm:ss 'GMT'", "MMM d HH:mm:ss yyyy")
    squeezed = F.regexp_replace(body, " +", " ")
    found = [F.unix_timestamp(F.try_to_timestamp(squeezed, F.lit(f))) for f in forms[:1] + forms[2:]]
    parts = F.regexp_extract(body, r"^(\d\d-[A-Za-z]{3}-)(\d\d .*)$", 1), F.regexp_extract(body, r"^(\d\d-[A-Za-z]{3}-)(\d\d .*)$", 2)
    century = F.when(F.substring(parts[1], 1, 2) >= "70", "19").otherwise("20")
    found.append(F.unix_timestamp(F.try_to_timestamp(F.concat(parts[0], century, parts[1]), F.lit("dd-MMM-yyyy HH:mm:ss 'GMT'"))))
    return F.coalesce(*found, F.lit(0))


def relative_date(text: Column, as_of: Column, zone: str = "UTC") -> Column:
    """Epoch seconds of a profile's update time, read in ``zone`` and relative to the instant ``as_of``.

    Minutes and hours are cut to their start; null where no form fits.
    """
    t = F.lower(F.trim(text))
    now = F.from_utc_timestamp(as_of, zone)
    n = F.regexp_extract(t, r"^(\d+) ", 1).cast("int")
    ago = lambda secs, unit: F.unix_timestamp(F.date_trunc(unit, F.timestamp_seconds(F.unix_timestamp(as_of) - secs)))
    epoch = lambda local: F.unix_timestamp(F.to_utc_timestamp(local, zone))
    clock = F.upper(F.regexp_extract(t, r"(\d{1,2}:\d{1,2} [ap]m)$", 1))
    on = lambda date: epoch(F.try_to_timestamp(F.concat_ws(" ", F.date_format(date, "yyyy-MM-dd"), clock), F.lit("yyyy-MM-dd h:m a")))
    dated = lambda body: epoch(F.try_to_timestamp(F.initcap(body), F.lit("MMM d, yyyy h:m a")))
    return (
        F.when(t == "now", F.unix_timestamp(as_of))
        .when(t.rlike(r"^\d+ seconds? ago$"), F.unix_timestamp(as_of) - n)
        .when(t.rlike(r"^\d+ minutes? ago$"), ago(n * 60, "minute"))
        .when(t.rlike(r"^\d+ hours? ago$"), ago(n * 3600, "hour"))
        .when(t.startswith("today, "), on(F.to_date(now)))
        .when(t.startswith("yesterday, "), on(F.date_sub(F.to_date(now), 1)))
        .when(t.rlike(r"^[a-z]{3} \d+, \d{4} "), dated(t))
        .when(t.rlike(r"^[a-z]{3} \d+, \d{1,2}:"), dated(F.concat(F.regexp_replace(t, ", .*", ", "), F.year(now).cast("string"), F.lit(" "), F.lower(clock))))
    )
