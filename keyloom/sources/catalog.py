"""Relations over the driver's tables, one row for each element of a key, with expiry and governance applied on
request. Nothing is read before an operator asks for it, and then only its columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import live, visible


def millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone, whatever the session's zone is."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
    return F.floor(micros / 1000).cast("bigint")


class Catalog:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def kv_all(self) -> DataFrame:
        """Every stored entry, expired and governed ones too."""
        k = F.col("c_custkey")
        return self.table("customer").select(
            F.concat(F.lit("cust:"), k.cast("string")).alias("key"), F.col("c_name").alias("value"),
            F.when(k % 7 == 0, k * 1000).alias("expire_at_ms"), F.when(k % 11 == 0, F.concat(F.lit("g"), (k % 3).cast("string"))).alias("governance"),
        )

    def kv(self, now_ms: int, allowed: list[str] | None = None) -> DataFrame:
        return self.kv_all.filter(live(F.col("expire_at_ms"), now_ms) & visible(F.col("governance"), allowed))

    @property
    def counters(self) -> DataFrame:
        """key, seq, delta: a changelog of additions."""
        return self.table("events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.floor("value").cast("bigint").alias("delta"))

    @property
    def h(self) -> DataFrame:
        k = F.col("c_custkey")
        fields = [("name", F.col("c_name")), ("segment", F.col("c_mktsegment")), ("nation", F.col("c_nationkey").cast("string")), ("cents", F.round(F.col("c_acctbal") * 100).cast("bigint").cast("string"))]
        rows = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in fields])).alias("r")
        out = self.table("customer").select(F.concat(F.lit("cust:"), k.cast("string")).alias("key"), k.alias("k"), rows)
        expire = F.when((F.col("r.field") == "segment") & (F.col("k") % 5 == 0), F.col("k") * 1000)
        return out.select("key", "r.field", "r.value", expire.alias("field_expire_at_ms"))

    @property
    def l(self) -> DataFrame:  # noqa: E743
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
        return self.table("lineitem").select(F.col("l_orderkey").alias("key"), (F.row_number().over(order) - 1).cast("bigint").alias("pos"), (F.col("l_partkey") % 10).cast("string").alias("value"))

    @property
    def s(self) -> DataFrame:
        return self.table("events").select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("member")).distinct()

    @property
    def z(self) -> DataFrame:
        return self.table("customer").select(F.col("c_nationkey").cast("string").alias("key"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("member"), F.col("c_acctbal").alias("score"))

    @property
    def za(self) -> DataFrame:
        """member (a nation), score (its customers)."""
        return self.table("customer").groupBy(F.col("c_nationkey").cast("string").alias("member")).agg(F.count("*").cast("double").alias("score"))

    @property
    def zb(self) -> DataFrame:
        """member (a nation), score (its suppliers)."""
        return self.table("supplier").groupBy(F.col("s_nationkey").cast("string").alias("member")).agg(F.count("*").cast("double").alias("score"))

    @property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("ms", millis(F.col("ts"))).drop("ts")

    @property
    def x(self) -> DataFrame:
        return self.events.select(F.col("event_type").alias("key"), "ms", F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("user"), "value")

    @property
    def a(self) -> DataFrame:
        return self.table("lineitem").groupBy(F.col("l_orderkey").alias("key"), F.col("l_linenumber").cast("bigint").alias("idx")).agg(F.max("l_quantity").cast("bigint").alias("value"))

    @property
    def v(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("element"), F.col("embedding").alias("vector"), F.to_json(F.struct(F.col("label"))).alias("attrs"), "label")

    @property
    def j(self) -> DataFrame:
        return self.table("events").select(F.col("event_id").alias("key"), F.col("props").alias("doc"))

    @property
    def jd(self) -> DataFrame:
        """key, doc: documents with an array, a boolean, a number, an object and a string."""
        e = F.col("event_id")
        items = F.when(e % 4 == 0, "").otherwise(F.concat_ws(",", (F.col("user_id") % 7).cast("string"), (e % 3).cast("string"), F.lit('"x"')))
        flag = F.when(e % 2 == 0, "true").otherwise("false")
        doc = F.concat(F.lit('{"a":['), items, F.lit('],"b":'), flag, F.lit(',"n":'), (F.col("user_id") % 10).cast("string"), F.lit(',"o":{"k":1},"s":"'), F.col("event_type"), F.lit('"}'))
        return self.table("events").select(e.alias("key"), doc.alias("doc"))

    def requests(self, *commands: str) -> DataFrame:
        """seq, command, args: the events as requests of the commands by turns."""
        e = F.col("event_id")
        command = F.element_at(F.lit(list(commands)), (e % len(commands) + 1).cast("int"))
        name = F.when(command.startswith("RG."), F.concat(F.lit("exec-"), (e - 3).cast("string"))).otherwise(F.concat(F.lit("k"), (F.col("user_id") % 40).cast("string")))
        return self.table("events").select(e.alias("seq"), command.alias("command"), F.array(name, F.col("event_type"), F.floor("value").cast("string")).alias("args"))

    @property
    def versions(self) -> DataFrame:
        """key, value, version: a user's last event type and number of events."""
        return self.table("events").groupBy(F.col("user_id").cast("string").alias("key")).agg(F.max_by("event_type", "event_id").alias("value"), F.count("*").alias("version"))

    @property
    def writes(self) -> DataFrame:
        """key, value, seq: several writes of each key, half of them of customers."""
        return self.table("events").select(F.concat(F.lit("cust:"), (F.col("user_id") % 400).cast("string")).alias("key"), F.concat(F.lit("w"), F.col("event_id").cast("string")).alias("value"), F.col("event_id").alias("seq"))

    @property
    def ts(self) -> DataFrame:
        return self.events.groupBy(F.col("event_type").alias("key"), F.col("ms").alias("ts")).agg(F.max_by("value", "event_id").alias("value"))

    @property
    def series(self) -> DataFrame:
        """key, labels."""
        odd = F.when(F.length("event_type") % 2 == 1, "odd").otherwise("even")
        return self.table("events").select("event_type").distinct().select(F.col("event_type").alias("key"), F.create_map(F.lit("type"), F.col("event_type"), F.lit("length"), odd).alias("labels"))

    @property
    def items(self) -> DataFrame:
        return self.table("events").select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("item"), F.col("event_id").alias("seq"))

    @property
    def samples(self) -> DataFrame:
        return self.table("events").select(F.col("event_type").alias("key"), "value")

    @property
    def bits(self) -> DataFrame:
        return self.table("events").select(F.col("event_type").alias("key"), F.col("user_id").alias("bit")).distinct()

    @property
    def places(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(F.lit("geo").alias("key"), k.alias("member"), ((k * 37 % 36000) / 100.0 - 180.0).alias("lon"), ((k * 91 % 17000) / 100.0 - 85.0).alias("lat"))

    @property
    def wal(self) -> DataFrame:
        op = F.when(F.col("event_type").isin("signup", "purchase"), "Set").when(F.col("event_type") == "view", "Expire").when(F.col("event_type") == "error", "Del")
        e = self.events.withColumn("op", op).filter("op IS NOT NULL")
        return e.select((F.col("user_id") % 8).cast("int").alias("shard_id"), F.col("event_id").alias("sequence"), F.col("ms").alias("timestamp_ms"), "op", F.col("user_id").cast("string").alias("key"), F.col("value").cast("double").alias("value"), F.when(F.col("op") == "Expire", F.col("ms") + 3_600_000).alias("expire_at_ms"))
