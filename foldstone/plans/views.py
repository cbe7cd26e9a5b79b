"""Views over the test tables in the shapes the log-store operators take, as SQL text that either engine runs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from foldstone.sources.tables import table

NOW_MS = 1706745600000  # 2024-02-01 00:00:00 UTC

#: Functions that differ by engine are written as {name}; tables as [name].
VIEWS = {
    "kv_log": """
select event_id as seq, case when event_type = 'error' then 'delete' else 'put' end as op,
  concat('user/', lpad(cast(user_id as {text}), 6, '0')) as key, case when event_type = 'error' then null else props end as value,
  cast(floor({micros} / 1000) as bigint) as ts_ms,
  case when event_type = 'view' then cast(floor({micros} / 1000) as bigint) + cast(floor(value) as bigint) * 3600000 end as expires_at,
  concat('tenant-', cast(user_id % 5 as {text})) as tenant
from [events]""",
    "kv_docs": """
select concat('doc/', lpad(cast(doc_id as {text}), 8, '0')) as key, doc_id, text as value, cast({bytes}(text) as bigint) as size,
  {sha}(text{bits}) as hash, coalesce(lower(trim(source)), 'none') as tenant
from [documents]""",
    "requests": """
select event_id, user_id, concat('/', event_type) as path,
  case when event_type in ('purchase', 'signup') then 'POST' when event_type = 'error' then 'DELETE' else 'GET' end as method,
  value as duration_ms, event_type <> 'error' as success, {micros} as ts_us, concat('tenant-', cast(user_id % 5 as {text})) as tenant
from [events]""",
    "tenant_ops": """
select o_orderkey as seq, n_name as tenant,
  case when o_orderstatus = 'O' then -cast(floor(o_totalprice) as bigint) else cast(floor(o_totalprice) as bigint) end as delta_bytes,
  cast(case when o_orderstatus = 'O' then -1 else 1 end as bigint) as delta_objects
from [orders] join [customer] on o_custkey = c_custkey join [nation] on c_nationkey = n_nationkey""",
    "quotas": """
select n_name as tenant_id, cast(case when n_nationkey % 5 = 0 then 0 else (n_nationkey + 1) * 4000000 end as bigint) as storage_limit,
  cast(case when n_nationkey % 6 = 0 then 0 else (n_nationkey + 1) * 30 end as bigint) as object_limit, cast(3 as bigint) as rate_limit, n_nationkey % 7 <> 6 as enabled
from [nation] where n_nationkey < 20""",
    "api_keys": """
select concat('key-', cast(c_custkey as {text})) as id, c_name as name, {sha}(concat('secret-', cast(c_custkey as {text})){bits}) as key_hash, n_name as tenant,
  case c_mktsegment when 'BUILDING' then 'Admin' when 'AUTOMOBILE' then 'ReadWrite' else 'ReadOnly' end as role, 1704067200000 as created_at,
  case when c_custkey % 4 = 0 then 1704067200000 + (c_custkey % 60) * 86400000 end as expires_at, c_acctbal >= 0 as active
from [customer] join [nation] on c_nationkey = n_nationkey""",
}

_SPARK = {"text": "string", "micros": "unix_micros(cast(ts as timestamp))", "bytes": "octet_length", "sha": "sha2", "bits": ", 256"}
_DUCK = {"text": "varchar", "micros": "epoch_us(ts)", "bytes": "octet_length", "sha": "sha256", "bits": ""}


def view(spark: SparkSession, d: str, name: str) -> DataFrame:
    text = VIEWS[name].format(**_SPARK)
    tables = {t: table(spark, d, t) for t in re.findall(r"\[(\w+)\]", text)}
    return spark.sql(re.sub(r"\[(\w+)\]", r"{\1}", text), **tables)


def ctes(*names: str) -> str:
    """The views as the WITH clause of an oracle query, without a final comma."""
    def one(name: str) -> str:
        text = VIEWS[name].format(**_DUCK)
        text = text.replace("octet_length(text)", "strlen(text)")
        return f"{name} as ({re.sub(r'\[(\w+)\]', r'\1', text)})"

    return "with recursive " + ",\n".join(one(n) for n in names)
