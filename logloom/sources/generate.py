"""Synthetic log lines as expressions over spark.range: every value is a hash of the seed, the line and the field."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The mix of outcomes of access-log lines, as (status, level, weight).
STATUS_MIX = [(200, "info", 55), (206, "info", 15), (204, "info", 5), (404, "warn", 8), (403, "warn", 5), (499, "warn", 6), (500, "error", 4), (503, "error", 2)]
# End of fixed values.
METHODS, BUCKETS, TENANTS = ["GET", "PUT", "HEAD", "DELETE", "POST"], ["media", "backup", "logs", "models"], ["alpha", "beta", "gamma"]
EPOCH_US = 1_704_067_200_000_000
#: Ticks of a block of a schedule's sums.
BLOCK = 1 << 16


class Fields:
    """Pseudo-random scalars of a line."""

    def __init__(self, seed: int, line: Column) -> None:
        self.seed, self.line = seed, line

    def bits(self, field: str, i: int = 0) -> Column:
        return F.xxhash64(F.lit(self.seed), F.lit(field), F.lit(i), self.line)

    def below(self, field: str, n: int) -> Column:
        return F.pmod(self.bits(field), F.lit(n)).cast("int")

    def hex(self, field: str, n_bytes: int) -> Column:
        return F.substring(F.lower(F.concat(*[F.lpad(F.hex(self.bits(field, i)), 16, "0") for i in range(-(-n_bytes // 8))])), 1, 2 * n_bytes)

    def uuid4(self, field: str) -> Column:
        h = self.hex(field, 16)
        variant = F.substring(F.lit("89ab"), self.below(field + ".v", 4) + 1, F.lit(1))
        return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))

    def text(self, field: str, n: int, alphabet: str) -> Column:
        return F.concat(*[F.substring(F.lit(alphabet), F.pmod(self.bits(field, i), F.lit(len(alphabet))).cast("int") + 1, F.lit(1)) for i in range(n)])

    def one_of(self, field: str, values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), self.below(field, len(values)) + 1)


def from_template(spark: SparkSession, template: list[str], n: int) -> DataFrame:
    """n lines that go round a template."""
    t = F.broadcast(spark.createDataFrame(list(enumerate(template)), "_k int, text string"))
    return spark.range(n).withColumn("_k", (F.col("id") % len(template)).cast("int")).join(t, "_k").select(F.lit("generated").alias("stream_id"), F.col("id").alias("line_no"), "text")


def access_log(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """n wide JSON lines with dotted keys, a nested object, and an error where the status is 400 or more."""
    d = spark.range(n)
    f = Fields(seed, F.col("id"))
    roll, status, level, upto = f.below("status", sum(w for *_, w in STATUS_MIX)), F.lit(None).cast("int"), F.lit(None).cast("string"), sum(w for *_, w in STATUS_MIX)
    for s, lev, w in reversed(STATUS_MIX):
        status, level, upto = F.when(roll < upto, F.lit(s)).otherwise(status), F.when(roll < upto, F.lit(lev)).otherwise(level), upto - w
    method, bucket, tenant = f.one_of("method", METHODS), f.one_of("bucket", BUCKETS), f.one_of("tenant", TENANTS)
    ended = F.lit(EPOCH_US) + F.col("id") * 1000
    started = ended - f.below("dur", 180_000) * 1000
    path = F.concat(F.lit("/"), bucket, F.lit("/archive/%7B"), f.uuid4("object"), F.lit("%7D/"), f.hex("chunk", 8))
    stamp = lambda us: F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    headers = F.struct(tenant.alias("X-Tenant-Name"), F.lit("https").alias("X-Forwarded-Proto"), f.text("sum", 12, alnum + "+/").alias("X-Checksum"), f.hex("request", 16).alias("X-Request-Id"))
    record = F.struct(
        level.alias("level"), f.hex("trace", 16).alias("dd.trace_id"), f.hex("span", 8).alias("dd.span_id"), F.lit("object-gateway").alias("service.name"), method.alias("http.method"), path.alias("http.url"), headers.alias("http.headers"),
        bucket.alias("app.bucket_name"), tenant.alias("app.tenant_name"), f.hex("request", 16).alias("http.request_id"), F.when(status >= 400, F.concat(F.lit("request failed with status "), status.cast("string"))).alias("error"),
        (f.below("size", 2_000_000) + 1024).alias("http.size_request"), stamp(started).alias("http.timestamp_start"), stamp(ended).alias("http.timestamp_end"), ((ended - started) / 1000).cast("long").alias("http.duration_ms"), status.alias("http.status_code"), stamp(ended).alias("time"),
        F.concat(F.lit("["), f.text("key", 20, alnum), F.lit("] "), method, F.lit(" "), path, F.lit(" "), status.cast("string")).alias("message"),
    )
    return d.select(F.lit("generated").alias("stream_id"), F.col("id").alias("line_no"), F.to_json(record).alias("text"))


def linear(start: float, end: float, seconds: float):
    """Rate at a time in seconds, as an expression."""
    return lambda t: F.lit(end) if seconds <= 0 else F.lit(start) + F.lit(end - start) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), t / seconds))


def exponential(start: float, end: float, seconds: float):
    if seconds <= 0 or start <= 0 or end <= 0:
        return linear(start, end, seconds)
    return lambda t: F.lit(start) * F.exp(F.lit(math.log(end / start)) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), t / seconds)))


def stepped(levels: list[float], hold: float):
    return lambda t: F.element_at(F.array(*[F.lit(float(x)) for x in levels]), F.least(F.lit(len(levels)), F.greatest(F.lit(0), F.floor(t / hold)) + 1).cast("int"))


def parse_rates(text: str) -> list[float]:
    out = [float(p) for p in (x.strip() for x in text.split(",")) if p]
    if any(x <= 0 for x in out):
        raise ValueError("rates must be positive")
    return out


def schedule(spark: SparkSession, rate, seconds: float, tick_ms: int = 1) -> DataFrame:
    """(tick, t, due): lines due by each tick, the trapezoidal integral of the rate."""
    n = int(seconds * 1000 / tick_ms)
    t = lambda k: k * (tick_ms / 1000)
    part = (rate(t(F.col("id") - 1)) + rate(t(F.col("id")))) / 2 * (tick_ms / 1000)
    d = spark.range(n).select(F.col("id").alias("tick"), F.expr(f"id div {BLOCK}").alias("_block"), t(F.col("id")).alias("t"), F.when(F.col("id") > 0, part).otherwise(0.0).alias("_part"))
    # in two levels: within blocks of ticks, and over the blocks' sums
    sums = d.groupBy("_block").agg(F.sum("_part").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    within = F.sum("_part").over(Window.partitionBy("_block").orderBy("tick"))
    d = d.withColumn("_within", within).join(sums.select("_block", before.alias("_before")), "_block")
    return d.select("tick", "t", F.floor(F.col("_before") + F.col("_within")).alias("due"))
