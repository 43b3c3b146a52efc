"""The fixture views as DataFrames over the driver's tables (FIXTURES.md): inputs of the operators' queries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order keys from which a line's place is beyond 64 bits.
LONG_KEYS = 9_200_000


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def line_place(self) -> str:
        """The place of a line by its keys: a bigint while order keys leave room for it, else a decimal that sorts alike."""
        if (self.table("lineitem").agg(F.max("l_orderkey")).first()[0] or 0) < LONG_KEYS:
            return "(((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 100 + cast(l_quantity as bigint)"
        low = "(l_partkey * 10000 + l_suppkey) * 100 + cast(l_quantity as bigint)"
        return f"cast(cast(l_orderkey * 10 + l_linenumber as decimal(20,0)) * 100000000000BD + {low} as decimal(28,0))"

    def statement_rows(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            f"{self.line_place} as pos", "concat('bank', l_orderkey % 3) as bank_key", "lpad(cast(l_orderkey % 37 as string), 4, '0') as account_tail",
            "concat('item ', l_partkey % 5) as summary", "if(l_partkey % 4 = 0, '', concat('Party ', l_partkey % 5)) as counterparty", "if(l_suppkey % 6 = 0, '', concat('ch', l_suppkey % 3)) as channel",
            "if(l_linestatus = 'O', concat(l_orderkey, '-', l_linenumber), '') as transaction_reference", "date_format(date_trunc('month', l_shipdate), 'yyyy-MM-dd') as transaction_time",
            "case l_returnflag when 'A' then 'inflow' when 'R' then 'outflow' else 'unknown' end as direction", "concat(cast(cast(floor(l_extendedprice / 10000) as bigint) as string), '.50') as amount",
            "cast(50 + l_suppkey % 50 as double) / 100 as confidence",
        )

    def order_captures(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            f"{self.line_place} as pos", "case l_orderkey % 4 when 0 then 'taobao' when 1 then 'pdd' when 2 then 'jd' else 'meituan' end as platform",
            "if(l_orderkey % 5 = 0, '', cast(l_orderkey as string)) as order_id", "if(l_partkey % 3 = 0, '', date_format(date_trunc('month', l_shipdate), 'yyyy-MM-dd')) as order_time",
            "if(l_suppkey % 4 = 0, '', concat('shop', l_orderkey % 50)) as merchant", "if(l_suppkey % 7 = 0, '', concat('title ', l_linenumber)) as title",
            "if(l_partkey % 6 = 0, '', concat('¥', cast(cast(floor(l_extendedprice / 10000) as bigint) as string), '.00')) as paid_amount", "l_returnflag = 'N' as is_partial",
            "cast(50 + l_suppkey % 50 as double) / 100 as confidence", "concat('file', l_orderkey % 1000) as source_file", "l_linenumber as order_index",
        )

    PLATFORM = "case o_custkey % 4 when 0 then 'taobao' when 1 then 'pdd' when 2 then 'jd' else 'meituan' end"

    def orders(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_orderkey as pos", "if(o_orderkey % 10 = 0, '', cast(o_orderkey as string)) as order_id", f"{self.PLATFORM} as platform",
            "if(o_orderkey % 17 = 0, '', date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')) as order_time", "concat('shop', lpad(cast(o_custkey % 50 as string), 2, '0')) as merchant",
            "concat('title ', o_orderpriority) as title", "cast(floor(o_totalprice / 2000) as decimal(18,2)) as paid_amount", "o_orderstatus = 'P' as is_partial", "cast(50 + o_orderkey % 50 as double) / 100 as confidence",
        )

    def payments(self) -> DataFrame:
        return self.table("orders").filter("o_orderkey % 7 <> 0").selectExpr(
            "o_orderkey as pos", "'outflow' as direction", "cast(floor(o_totalprice / 2000) as decimal(18,2)) as amount",
            "date_format(o_orderdate + make_dt_interval(cast(o_orderkey % 10 as int)), 'yyyy-MM-dd HH:mm:ss') as transaction_time", f"if(o_orderkey % 3 = 0, '', {self.PLATFORM}) as platform",
            "if(o_orderkey % 4 = 0, concat('shop', lpad(cast(o_custkey % 50 as string), 2, '0'), ' pay'), 'card pay') as summary",
        )

    def orders_skew(self) -> DataFrame:
        return self.orders().withColumn("paid_amount", F.floor(F.col("paid_amount") / 10).cast("decimal(18,2)"))

    def payments_skew(self) -> DataFrame:
        return self.payments().withColumn("amount", F.floor(F.col("amount") / 10).cast("decimal(18,2)"))

    def movements(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id as pos", "concat('bank', user_id % 5) as bank_key", "lpad(cast(user_id as string), 4, '0') as account_tail", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') as transaction_time",
            "case event_type when 'purchase' then 'outflow' when 'signup' then 'inflow' else '' end as direction",
            "cast(case when event_type = 'error' then -value when event_type = 'view' then 0 else value end as decimal(18,2)) as amount", "concat(event_type, ' ', if(event_id % 9 = 0, 'refund', 'ok')) as summary",
        )

    def merchants(self) -> DataFrame:
        return self.table("part").selectExpr("p_partkey as pos", "p_name as merchant", "p_type as summary", "p_brand as counterparty", "case p_size % 3 when 0 then 'inflow' when 1 then 'outflow' else 'unknown' end as direction")

    def lines(self) -> DataFrame:
        return self.table("documents").selectExpr("doc_id", "posexplode(split(text, '\n')) as (i, text)").selectExpr("doc_id", "i + 1 as line_no", "text")

    def messages(self) -> DataFrame:
        return self.table("documents").selectExpr("doc_id as pos", "concat(source, '@example.com') as sender", "concat(lang, ' statement') as subject", "text as body")

    def manifest(self) -> DataFrame:
        suffix = "case page_id % 4 when 0 then 'PDF' when 1 then 'xls' when 2 then 'csv' else 'txt' end"
        return self.table("pages").selectExpr("page_id as pos", "if(page_id % 5 = 0, 'password_failed', 'success') as status", f"array(concat(url, '.', {suffix}), concat(url, '.csv')) as output_files")

    def files(self) -> DataFrame:
        return self.table("pages").selectExpr("page_id as mtime", "concat('2024-01-', lpad(cast(1 + page_id % 28 as string), 2, '0'), '_g', page_id % 7, '.xlsx') as name")

    def model_replies(self) -> DataFrame:
        return self.table("events").selectExpr("event_id as id", "case event_id % 3 when 0 then props when 1 then concat('Here you are: ', props, ' done') else 'no json' end as raw_text")

    def elements(self) -> DataFrame:
        return self.table("conversations").selectExpr("conv_id as file_id", "turn as idx", "role = 'system' as bad")

    def frames(self) -> DataFrame:
        return self.table("embeddings").selectExpr("vec_id as pos", "label as session_id", "embedding")

    def overrides(self) -> DataFrame:
        return self.table("labels").selectExpr("doc_id", "if(quality = 1, 'keep', '') as override_category", "toxic")

    def records(self) -> DataFrame:
        c = F.expr(
            "named_struct('id', event_id, 'c', named_struct('raw_line', concat(event_type, ' ', event_id), 'amounts', if(event_id % 8 = 0, array('n/a'), "
            "array(cast(cast(value as decimal(18,2)) as string), cast(cast(event_id % 300 as decimal(18,2)) as string))), 'direction', if(event_type = 'purchase', 'outflow', 'unknown')))"
        )
        return self.table("events").groupBy("user_id").agg(F.array_sort(F.collect_list(c)).alias("x")).selectExpr("user_id as message_uid", "concat('bank', user_id % 5) as bank_key", "transform(x, y -> y.c) as candidates")

    def headers(self) -> DataFrame:
        return self.table("part").selectExpr("p_partkey div 10 as table_id", "p_partkey % 10 as col", "if(p_size % 5 = 0, '', p_type) as header")
