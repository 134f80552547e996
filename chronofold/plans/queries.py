"""The registered queries: each an operator applied to the driver's tables, and the same in SQL.

The events table is read as a log (sources.log.from_events). Heads, checkpoints, dead letters and
graphs are derived from the same tables on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.functions import text, values
from chronofold.operators import append, checkpoints, dlq, envelope, fold, graph, health, lineage, metrics, readmodel, rules, upcast
from chronofold.plans import projections
from chronofold.sources import log as reading
from chronofold.sources.shared import shared_dir
from chronofold.streaming import runtime

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LOG = """WITH log AS (
  SELECT 't' || CAST(user_id % 4 AS VARCHAR) AS tenant_id, 'User-' || CAST(user_id AS VARCHAR) AS aggregate_id, 'User' AS aggregate_type,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS aggregate_nonce, event_id + 1 AS global_nonce,
         CAST(event_id AS VARCHAR) AS event_id, event_type, 1 AS event_version, epoch_us(ts) // 1000 AS timestamp_unix_ms,
         props AS payload, CAST(round(value * 100) AS BIGINT) AS amount, user_id, ts
  FROM events)
"""

#: Projections of the examples: name, version, subscribed types.
REGISTERED = [("accounts", 1, ["signup", "purchase", "error"]), ("views", 1, ["view"]), ("clicks", 2, ["click"]), ("everything", 1, ["click", "error", "purchase", "signup", "view"]), ("unstarted", 1, ["view"])]
REGISTERED_SQL = "reg(projection_name, version, types) AS (VALUES " + ", ".join(f"('{n}', {v}, [{', '.join(repr(t) for t in ts)}])" for n, v, ts in REGISTERED) + ")"


def query(sql: str | None = None, log: bool = True) -> Callable[[Query], Query]:
    """Registers a query with its SQL; log: the SQL reads the log."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = LOG + sql if log else sql
        return f

    return put


def _log(spark: SparkSession, d: str) -> DataFrame:
    return reading.from_events(spark, d)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


COLUMNS = ["tenant_id", "aggregate_id", "aggregate_nonce", "global_nonce", "event_type", "timestamp_unix_ms", "payload"]
COLUMNS_SQL = ", ".join(COLUMNS)


# Reading


@query(f"SELECT {COLUMNS_SQL} FROM log WHERE tenant_id = 't1' AND aggregate_id = 'User-5' AND aggregate_nonce >= 3 ORDER BY aggregate_nonce LIMIT 20")
def read_stream_forward(spark, d):
    own = _log(spark, d).where("user_id = 5")  # the stream's number reaches the scan
    return reading.read_stream(own, "t1", "User-5", 3, 20).select(COLUMNS)


@query(f"SELECT {COLUMNS_SQL} FROM log WHERE tenant_id = 't1' AND aggregate_id = 'User-5' ORDER BY aggregate_nonce DESC LIMIT 10")
def read_stream_backward(spark, d):
    return reading.read_stream(_log(spark, d).where("user_id = 5"), "t1", "User-5", None, 10, forward=False).select(COLUMNS)


@query("SELECT tenant_id, aggregate_id, global_nonce, event_type, amount FROM log WHERE tenant_id = 't2' AND global_nonce >= 100 ORDER BY global_nonce LIMIT 100")
def read_all_page(spark, d):
    return reading.read_all(reading.without_nonce(spark, d), "t2", 100).select("tenant_id", "aggregate_id", "global_nonce", "event_type", "amount")


@query("SELECT tenant_id, aggregate_id, global_nonce, event_type, amount FROM log WHERE tenant_id = 't2' ORDER BY global_nonce DESC LIMIT 50")
def read_all_backward(spark, d):
    return reading.read_all(reading.without_nonce(spark, d), "t2", None, 50, forward=False).select("tenant_id", "aggregate_id", "global_nonce", "event_type", "amount")


@query("SELECT tenant_id, aggregate_id, global_nonce, event_type FROM log WHERE global_nonce > 500 AND tenant_id = 't0'")
def read_all_after(spark, d):
    got = reading.subscription(reading.without_nonce(spark, d), "t0", 500, exclusive=True)
    return got.select("tenant_id", "aggregate_id", "global_nonce", "event_type")


@query(""", n AS (SELECT *, (row_number() OVER (PARTITION BY tenant_id, aggregate_id ORDER BY aggregate_nonce) - 1) // 10 AS page FROM log)
SELECT tenant_id, aggregate_id, page, min(aggregate_nonce) AS first, max(aggregate_nonce) AS last, count(*) AS n, count(*) < 10 AS is_end, max(aggregate_nonce) + 1 AS next_from
FROM n GROUP BY ALL""")
def page_cursors(spark, d):
    return reading.page_cursors(_log(spark, d), 10, projections.STREAM, "aggregate_nonce")


@query("SELECT tenant_id, aggregate_id, global_nonce, event_type FROM log WHERE tenant_id = 't1' AND global_nonce >= 10 AND starts_with(aggregate_id, 'User-1') AND event_type IN ('purchase', 'view')")
def subscribe_prefix(spark, d):
    got = reading.subscription(reading.without_nonce(spark, d), "t1", 10, "User-1", ["purchase", "view"])
    return got.select("tenant_id", "aggregate_id", "global_nonce", "event_type")


@query("SELECT CAST(max(global_nonce) AS BIGINT) AS head, count(*) AS n_events FROM log")
def head_position(spark, d):
    return reading.without_nonce(spark, d).agg(F.max("global_nonce").alias("head"), F.count("*").alias("n_events"))


@query("SELECT tenant_id, aggregate_id, max(aggregate_nonce) AS head, max_by(event_type, aggregate_nonce) AS last_type, max(global_nonce) AS last_global, count(*) AS n_events FROM log GROUP BY ALL")
def stream_heads(spark, d):
    return reading.heads(_log(spark, d))


@query(""", names AS (SELECT 't' || CAST(c_custkey % 4 AS VARCHAR) AS tenant_id, 'User-' || CAST(c_custkey AS VARCHAR) AS aggregate_id FROM customer)
SELECT * FROM names WHERE EXISTS (SELECT 1 FROM log WHERE log.tenant_id = names.tenant_id AND log.aggregate_id = names.aggregate_id)""")
def streams_exist(spark, d):
    k = F.col("c_custkey").cast("string")
    names = _table(spark, d, "customer").select(F.concat(F.lit("t"), (F.col("c_custkey") % 4).cast("string")).alias("tenant_id"), F.concat(F.lit("User-"), k).alias("aggregate_id"))
    return reading.existing(names, reading.without_nonce(spark, d))


@query("""SELECT DISTINCT aggregate_type || '-' || aggregate_id AS name, 'User' AS kind, aggregate_id AS id FROM log""")
def stream_names(spark, d):
    got = _log(spark, d).select(text.stream_name(F.col("aggregate_type"), F.col("aggregate_id")).alias("name")).distinct()
    return got.select("name", text.stream_type(F.col("name")).alias("kind"), text.stream_id(F.col("name")).alias("id"))


@query("""SELECT tenant_id, aggregate_id, global_nonce, coalesce(lag(global_nonce) OVER w, 0) AS previous FROM log
WINDOW w AS (PARTITION BY tenant_id, aggregate_id ORDER BY global_nonce) QUALIFY global_nonce <> previous + 1""")
def nonce_gaps(spark, d):
    """Where a stream's events don't follow each other in the global order."""
    got = reading.gaps(_log(spark, d), F.col("global_nonce"))
    return got.select("tenant_id", "aggregate_id", "global_nonce", "previous")


# Writing: requests are derived from conversations, one request a conversation


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """A request a conversation: appends its turns to the stream of a user, expecting the head of half of them."""
    c = _table(spark, d, "conversations").where("conv_id is not null")
    event = F.struct(
        F.lit("").alias("tenant_id"), F.lit("").alias("aggregate_id"), F.lit("").alias("aggregate_type"), F.col("turn").alias("aggregate_nonce"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("event_id"), F.col("role").alias("event_type"),
        F.lit(None).cast("int").alias("event_version"), F.lit("").alias("content_type"), F.lit("").alias("content_schema"), F.lit("").alias("correlation_id"), F.lit("").alias("causation_id"),
        F.lit("").alias("actor_id"), F.lit(0).cast("bigint").alias("timestamp_unix_ms"), F.lit(0).cast("bigint").alias("recorded_time_unix_ms"), F.lit(None).cast("binary").alias("payload_sha256"),
        F.lit(None).cast("string").alias("headers"), F.col("text").cast("binary").alias("payload"),
    )
    event = event.dropFields("headers")  # a map has no order, and sort_array needs one
    got = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", event.alias("e")))).alias("t"), F.count("*").alias("n"))
    heads = append.heads_of(_log(spark, d)).select(F.substring_index("aggregate_id", "-", -1).cast("bigint").alias("u"), "head")
    got = got.withColumn("u", F.col("conv_id")).join(heads, "u", "left")
    head = F.coalesce("head", F.lit(0).cast("bigint"))
    kind = F.col("conv_id") % 5
    events = F.transform("t", lambda x, i: x["e"].withField("aggregate_nonce", head + i + 1 + F.when(kind == 3, 1).otherwise(0)).withField("headers", F.lit(None).cast("map<string,string>")))
    return got.select(
        F.col("conv_id").alias("request_id"), F.when(kind == 4, "").otherwise(F.concat(F.lit("t"), (F.col("u") % 4).cast("string"))).alias("tenant_id"), F.concat(F.lit("User-"), F.col("u").cast("string")).alias("aggregate_id"),
        F.lit("User").alias("aggregate_type"), F.when(kind == 1, head + 7).otherwise(head).alias("expected"), F.concat(F.lit("k"), F.col("conv_id").cast("string")).alias("idempotency_key"), events.alias("events"), "n",
    )


@query(""", c AS (SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT user_id, max(aggregate_nonce) AS head FROM log GROUP BY user_id)
SELECT conv_id AS request_id,
  CASE conv_id % 5 WHEN 4 THEN 'Unauthenticated' WHEN 1 THEN 'Concurrency' WHEN 3 THEN 'Invalid' ELSE 'ok' END AS status,
  CASE WHEN conv_id % 5 = 4 THEN 0 ELSE coalesce(head, 0) END AS actual_head,
  CASE WHEN conv_id % 5 IN (0, 2) THEN coalesce(head, 0) + n END AS last_nonce
FROM c LEFT JOIN h ON c.conv_id = h.user_id""")
def append_conflicts(spark, d):
    """Outcomes of many requests at once: kept apart by tenant, argument, head and nonce checks."""
    log = _log(spark, d)
    none = spark.createDataFrame([], "tenant_id string, aggregate_id string, idempotency_key string, fingerprint string, last_nonce bigint")
    return append.outcomes(append.validate(_requests(spark, d).drop("n"), append.heads_of(log), none, log.select("tenant_id", "event_id")))


@query("""SELECT conv_id AS request_id, CASE WHEN conv_id % 5 = 4 THEN 'Unauthenticated' WHEN conv_id % 2 = 0 THEN 'replayed' ELSE 'AlreadyExists' END AS status
FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)""", log=False)
def idempotent_replays(spark, d):
    """The same requests again, half of them with other contents under the same key."""
    log = _log(spark, d)
    requests = _requests(spark, d).drop("n")
    none = spark.createDataFrame([], "tenant_id string, aggregate_id string, idempotency_key string, fingerprint string, last_nonce bigint")
    first = append.validate(requests, append.heads_of(log), none, log.select("tenant_id", "event_id"))
    changed = F.when(F.col("request_id") % 2 == 0, F.col("fingerprint")).otherwise(F.sha2("fingerprint", 256))
    ledger = first.select("tenant_id", "aggregate_id", "idempotency_key", changed.alias("fingerprint"), F.col("expected").alias("last_nonce"))
    again = append.validate(requests, append.heads_of(log), ledger, log.select("tenant_id", "event_id"))
    return append.outcomes(again).select("request_id", "status")


@query("""SELECT o_orderkey AS request_id, o_custkey AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS granted FROM orders""", log=False)
def unique_claims(spark, d):
    return append.claims(_table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("value")))


@query("""SELECT tenant_id, event_id, event_type, 1 AS event_version, 'application/json' AS content_type, sha256(payload) AS payload_sha256,
  CASE WHEN user_id % 2 = 0 THEN 'c' || event_id END AS correlation_id FROM log""")
def normalized_events(spark, d):
    e = _log(spark, d)
    absent = {c: F.lit("") for c in ("content_type", "content_schema", "causation_id", "actor_id")}
    e = e.withColumns(absent | {"correlation_id": F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("c"), F.col("event_id"))).otherwise(""), "headers": F.lit(None).cast("map<string,string>"), "payload_sha256": F.lit(None).cast("binary"), "recorded_time_unix_ms": F.lit(0).cast("bigint"), "payload": F.col("payload").cast("binary")})
    got = e.select(append.normalize(F.struct("*"), F.col("tenant_id"), F.col("aggregate_id"), F.col("aggregate_type")).alias("e"))
    return got.select("e.tenant_id", "e.event_id", "e.event_type", "e.event_version", "e.content_type", F.lower(F.hex("e.payload_sha256")).alias("payload_sha256"), "e.correlation_id")


# Folds

HISTORY = """seg AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY aggregate_id ORDER BY global_nonce ROWS UNBOUNDED PRECEDING) AS seg FROM log WHERE event_type IN ('signup', 'purchase', 'error')),
run AS (SELECT *, sum(CASE event_type WHEN 'error' THEN -amount ELSE amount END) OVER (PARTITION BY aggregate_id, seg ORDER BY global_nonce ROWS UNBOUNDED PRECEDING) AS balance_after FROM seg),
hist AS (SELECT tenant_id, aggregate_id, global_nonce, CASE event_type WHEN 'purchase' THEN 'deposit' ELSE 'withdrawal' END AS type, amount, CAST(balance_after AS BIGINT) AS balance_after FROM run WHERE event_type <> 'signup')"""

SUMMARY = """own AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN global_nonce END) OVER (PARTITION BY aggregate_id) AS begin FROM log WHERE event_type IN ('signup', 'purchase', 'error')),
summary AS (SELECT tenant_id, aggregate_id, CAST(sum(CASE event_type WHEN 'error' THEN -amount ELSE amount END) AS BIGINT) AS balance,
  count(*) FILTER (event_type <> 'signup') AS transactions, 'Open' AS status, max_by(timestamp_unix_ms, global_nonce) AS last_activity
  FROM own WHERE global_nonce >= begin GROUP BY tenant_id, aggregate_id)"""


@query(f", {SUMMARY} SELECT * FROM summary")
def account_summary(spark, d):
    return projections.account_summary(reading.without_nonce(spark, d))


@query(f", {SUMMARY} SELECT tenant_id, count(*) AS accounts, CAST(sum(balance) AS BIGINT) AS balance, count(*) FILTER (status = 'Open') AS open, CAST(sum(transactions) AS BIGINT) AS transactions FROM summary GROUP BY tenant_id")
def accounts_by_tenant(spark, d):
    return projections.accounts_by_tenant(projections.account_summary(reading.without_nonce(spark, d)))


@query(f", {HISTORY} SELECT * FROM hist")
def transaction_history(spark, d):
    return projections.transaction_history(reading.without_nonce(spark, d))


@query(f", {HISTORY} SELECT * FROM hist WHERE type = 'withdrawal' AND balance_after < 0")
def overdrafts(spark, d):
    return projections.overdrafts(reading.without_nonce(spark, d))


STATE = """SELECT tenant_id, aggregate_id, CAST(sum(CASE event_type WHEN 'purchase' THEN amount WHEN 'error' THEN -amount ELSE 0 END) AS BIGINT) AS balance,
  count(*) FILTER (event_type = 'view') AS views, max(aggregate_nonce) AS version FROM log {where} GROUP BY tenant_id, aggregate_id"""


def _rehydrated(spark, d, up_to=None):
    start = F.struct(F.lit(0).cast("bigint").alias("balance"), F.lit(0).cast("bigint").alias("views"))

    def add(sign: int) -> fold.Step:
        return lambda s, e: F.struct((s["balance"] + sign * e["amount"]).alias("balance"), s["views"].alias("views"))

    step = fold.dispatch({"purchase": add(1), "error": add(-1), "view": lambda s, e: F.struct(s["balance"].alias("balance"), (s["views"] + 1).alias("views"))})
    got = fold.fold(_log(spark, d), projections.STREAM, "aggregate_nonce", ["event_type", "amount"], start, step, up_to)
    return got.select(*projections.STREAM, "state.balance", "state.views", "version")


@query(STATE.format(where=""))
def rehydrate_state(spark, d):
    """The general fold over each stream."""
    return _rehydrated(spark, d)


@query(STATE.format(where="WHERE aggregate_nonce <= 20"))
def state_as_of(spark, d):
    """The same as of the 20th event."""
    return _rehydrated(spark, d, 20)


@query(""", s AS (SELECT tenant_id, global_nonce, sum(CASE event_type WHEN 'purchase' THEN 1 ELSE -1 END) OVER w AS s FROM log WHERE event_type IN ('purchase', 'error') WINDOW w AS (PARTITION BY tenant_id ORDER BY global_nonce ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY tenant_id ORDER BY global_nonce ROWS UNBOUNDED PRECEDING)) AS c FROM s)
SELECT tenant_id, CAST(max_by(c, global_nonce) AS BIGINT) AS now, CAST(max(c) AS BIGINT) AS most, count(*) AS changes FROM m GROUP BY tenant_id""")
def status_counts_clamped(spark, d):
    return projections.status_counts(reading.without_nonce(spark, d), "purchase", "error")


@query("SELECT o_orderstatus, count(*) AS orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS revenue, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) // count(*) AS BIGINT) AS average FROM orders GROUP BY o_orderstatus", log=False)
def order_summary(spark, d):
    return projections.order_summary(_table(spark, d, "orders"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(sum(amount) AS BIGINT) AS revenue, count(*) AS sales, CAST(sum(amount) // count(*) AS BIGINT) AS average FROM log WHERE event_type = 'purchase' GROUP BY day")
def daily_sales(spark, d):
    return projections.daily_sales(reading.without_nonce(spark, d), "purchase")


@query("SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS revenue FROM lineitem GROUP BY l_partkey ORDER BY revenue DESC, l_partkey LIMIT 10", log=False)
def product_sales_topk(spark, d):
    return projections.product_sales(_table(spark, d, "lineitem"))


CUSTOMERS = """SELECT o_custkey, count(*) AS orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS value,
  first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS first_order, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS last_order FROM orders GROUP BY o_custkey"""


@query(CUSTOMERS, log=False)
def customer_history(spark, d):
    return projections.customer_history(_table(spark, d, "orders"))


@query(CUSTOMERS + " ORDER BY value DESC, o_custkey LIMIT 10", log=False)
def customer_history_topk(spark, d):
    return projections.customer_history(_table(spark, d, "orders")).orderBy(F.col("value").desc(), "o_custkey").limit(10)


@query("""SELECT o_custkey, CAST(row_number() OVER w AS INTEGER) AS n, o_orderkey, o_orderdate, CAST(round(o_totalprice * 100) AS BIGINT) AS total,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS value
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""", log=False)
def customer_orders(spark, d):
    return projections.customer_orders(_table(spark, d, "orders"))


@query("SELECT * FROM orders WHERE o_orderkey = 7", log=False)
def get_order(spark, d):
    return projections.get_order(_table(spark, d, "orders"), 7)


@query("SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 100 OFFSET 100", log=False)
def list_orders(spark, d):
    return projections.list_orders(_table(spark, d, "orders"), status="O", offset=100)


@query("""SELECT l_partkey AS product, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS revenue,
  count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_partkey""", log=False)
def product_sales_items(spark, d):
    item = F.struct(F.col("l_partkey").alias("product"), F.col("l_quantity").cast("bigint").alias("quantity"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price"))
    return projections.sales_of_items(_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.collect_list(item).alias("items")))


@query(""", e AS (SELECT *, max(CASE event_type WHEN 'signup' THEN aggregate_nonce END) OVER (PARTITION BY user_id) AS opening FROM log WHERE event_type IN ('signup', 'purchase', 'error', 'closed')),
own AS (SELECT * FROM e WHERE opening IS NOT NULL AND aggregate_nonce >= opening)
SELECT tenant_id, aggregate_id, CAST(sum(CASE event_type WHEN 'error' THEN -amount WHEN 'closed' THEN 0 ELSE amount END) AS BIGINT) AS balance,
  count(*) FILTER (event_type IN ('purchase', 'error')) AS transactions, CASE WHEN bool_or(event_type = 'closed') THEN 'Closed' ELSE 'Open' END AS status,
  arg_max(timestamp_unix_ms, global_nonce) AS last_activity, arg_max('c' || CAST(amount % 50 AS VARCHAR), aggregate_nonce) FILTER (event_type = 'signup') AS customer_id
FROM own GROUP BY tenant_id, aggregate_id""")
def accounts_by_customer(spark, d):
    customer = F.concat(F.lit("c"), (F.col("amount") % 50).cast("string"))
    return projections.accounts_by_customer(_log(spark, d), customer)


PRODUCTS = projections.Products("signup", "view", "purchase", "error")
PRODUCTS_SQL = """, e AS (SELECT *, amount % 1000 AS stock FROM log WHERE event_type IN ('signup', 'view', 'purchase', 'error')),
c AS (SELECT *, CASE event_type WHEN 'signup' THEN stock WHEN 'purchase' THEN amount WHEN 'error' THEN -amount ELSE 0 END AS change,
  CASE WHEN event_type IN ('signup', 'view') THEN amount END AS price FROM e)
"""


@query(PRODUCTS_SQL + "SELECT tenant_id, aggregate_id, arg_max(price, aggregate_nonce) FILTER (price IS NOT NULL) AS price, CAST(sum(change) AS BIGINT) AS stock FROM c GROUP BY ALL")
def product_states(spark, d):
    return projections.product_states(_log(spark, d).withColumn("stock", F.col("amount") % 1000), PRODUCTS)


@query(PRODUCTS_SQL + """, b AS (SELECT *, coalesce(bool_or(event_type = 'signup') OVER w, false) AS there, coalesce(sum(change) OVER w, 0) AS stock_before,
  last_value(price IGNORE NULLS) OVER w AS price_before FROM c WINDOW w AS (PARTITION BY user_id ORDER BY aggregate_nonce ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, CASE WHEN event_type = 'signup' AND there THEN 'exists already' WHEN event_type <> 'signup' AND NOT there THEN 'does not exist'
  WHEN price < 0 THEN 'negative price' WHEN event_type = 'signup' AND stock < 0 THEN 'negative stock' WHEN event_type = 'view' AND amount = price_before THEN 'same price'
  WHEN price IS NULL AND amount <= 0 THEN 'quantity not positive' WHEN event_type = 'error' AND stock_before < amount THEN 'insufficient stock' END AS rule FROM b)
SELECT tenant_id, aggregate_id, aggregate_nonce, event_type, rule FROM r WHERE rule IS NOT NULL""")
def product_violations(spark, d):
    return projections.product_violations(_log(spark, d).withColumn("stock", F.col("amount") % 1000), PRODUCTS)


@query(", e AS (SELECT *, 'street ' || CAST(amount % 7 AS VARCHAR) AS address FROM log WHERE event_type IN ('signup', 'click')) SELECT tenant_id, aggregate_id, arg_max(address, aggregate_nonce) AS address, count(*) FILTER (event_type = 'click') AS moves FROM e GROUP BY ALL")
def customer_states(spark, d):
    return projections.customer_states(_log(spark, d), "signup", "click", F.concat(F.lit("street "), (F.col("amount") % 7).cast("string")))


@query(""", e AS (SELECT *, CASE WHEN amount % 11 > 0 THEN 'street ' || CAST(amount % 7 AS VARCHAR) END AS address FROM log WHERE event_type IN ('signup', 'click')),
b AS (SELECT *, coalesce(bool_or(event_type = 'signup') OVER w, false) AS there, last_value(address) OVER w AS was FROM e
  WINDOW w AS (PARTITION BY user_id ORDER BY aggregate_nonce ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, CASE WHEN event_type = 'signup' AND there THEN 'registered already' WHEN event_type = 'click' AND NOT there THEN 'does not exist'
  WHEN coalesce(address, '') = '' THEN 'no address' WHEN event_type = 'click' AND address = was THEN 'same address' END AS rule FROM b)
SELECT tenant_id, aggregate_id, aggregate_nonce, event_type, rule FROM r WHERE rule IS NOT NULL""")
def customer_violations(spark, d):
    address = F.when(F.col("amount") % 11 > 0, F.concat(F.lit("street "), (F.col("amount") % 7).cast("string")))
    return projections.customer_violations(_log(spark, d), "signup", "click", address)


@query("SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS total, count(*) AS lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY l_orderkey", log=False)
def order_totals(spark, d):
    return projections.order_totals(_table(spark, d, "lineitem"))


@query("""SELECT tenant_id, aggregate_id, CAST(total AS BIGINT) AS total, CAST(reserved AS BIGINT) AS reserved, CAST(total - reserved AS BIGINT) AS available FROM (
  SELECT tenant_id, aggregate_id, sum(CASE event_type WHEN 'purchase' THEN amount WHEN 'error' THEN -amount ELSE 0 END) AS total, sum(CASE event_type WHEN 'click' THEN amount ELSE 0 END) AS reserved
  FROM log WHERE event_type IN ('purchase', 'error', 'click') GROUP BY ALL)""")
def inventory_levels(spark, d):
    return projections.inventory(reading.without_nonce(spark, d), "purchase", "error", "click")


@query(""", f AS (SELECT tenant_id, aggregate_id, min(CASE WHEN event_type = 'signup' THEN aggregate_nonce END) AS opened, max(aggregate_nonce) AS version FROM log GROUP BY tenant_id, aggregate_id),
p AS (SELECT l.aggregate_id, min(l.aggregate_nonce) AS confirmed FROM log l JOIN f ON l.aggregate_id = f.aggregate_id AND l.aggregate_nonce > f.opened WHERE l.event_type = 'purchase' GROUP BY l.aggregate_id),
v AS (SELECT l.aggregate_id, min(l.aggregate_nonce) AS shipped FROM log l JOIN p ON l.aggregate_id = p.aggregate_id AND l.aggregate_nonce > p.confirmed WHERE l.event_type = 'view' GROUP BY l.aggregate_id)
SELECT tenant_id, f.aggregate_id, CASE WHEN shipped IS NOT NULL THEN 'SHIPPED' WHEN confirmed IS NOT NULL THEN 'CONFIRMED' WHEN opened IS NOT NULL THEN 'DRAFT' ELSE 'NEW' END AS state, version
FROM f LEFT JOIN p USING (aggregate_id) LEFT JOIN v USING (aggregate_id)""")
def order_states(spark, d):
    """A state machine over each stream: signup -> DRAFT, purchase -> CONFIRMED, view -> SHIPPED."""
    machine = projections.Machine("NEW", (("signup", "NEW", "DRAFT"), ("purchase", "DRAFT", "CONFIRMED"), ("view", "CONFIRMED", "SHIPPED")))
    return projections.states(_log(spark, d), machine)


@query("""SELECT tenant_id, aggregate_id, (aggregate_nonce - 1) // 10 AS snapshot, max(aggregate_nonce) AS version, max_by(event_type, aggregate_nonce) AS event_type FROM log GROUP BY tenant_id, aggregate_id, snapshot""")
def snapshots(spark, d):
    return fold.snapshots(_log(spark, d), projections.STREAM, 10)


@query("SELECT tenant_id, aggregate_id, event_type, global_nonce, amount FROM log QUALIFY row_number() OVER (PARTITION BY tenant_id, aggregate_id, event_type ORDER BY global_nonce DESC) = 1")
def latest_record_per_key(spark, d):
    got = fold.latest(reading.without_nonce(spark, d), [*projections.STREAM, "event_type"], "global_nonce")
    return got.select(*projections.STREAM, "event_type", "global_nonce", "amount")


# Projections, checkpoints, health

POSITIONS = f""", {REGISTERED_SQL},
h AS (SELECT max(global_nonce) AS head FROM log),
cp AS (SELECT 'accounts' AS projection_name, head - 50 AS global_position, 1 AS version, 3600000 AS age_ms FROM h UNION ALL SELECT 'views', head - 400, 1, 3600000 FROM h
       UNION ALL SELECT 'clicks', head - 10, 1, 3600000 FROM h UNION ALL SELECT 'everything', head, 1, 3600000 FROM h),
pos AS (SELECT reg.projection_name, reg.version, CASE WHEN cp.version IS NULL OR cp.version <> reg.version THEN 0 ELSE global_position END AS position, coalesce(cp.version <> reg.version, false) AS rebuild
        FROM reg LEFT JOIN cp USING (projection_name))"""
NOW_MS = 1_704_110_400_000


def _registered(spark):
    return spark.createDataFrame([(n, v, t) for n, v, t in REGISTERED], "projection_name string, version int, types array<string>")


def _checkpoints(spark, d):
    """Checkpoints some way behind the head, last moved an hour ago; `unstarted` has none, `clicks` one of an old version."""
    head = reading.without_nonce(spark, d).agg(F.max("global_nonce").alias("head"))
    behind = spark.createDataFrame([("accounts", 50), ("views", 400), ("clicks", 10), ("everything", 0)], "projection_name string, behind bigint")
    at = F.timestamp_millis(F.lit(NOW_MS - 3_600_000))
    return behind.crossJoin(F.broadcast(head)).select("projection_name", (F.col("head") - F.col("behind")).alias("global_position"), F.lit(1).alias("version"), at.alias("updated_at"))


def _positions(spark, d):
    return checkpoints.start_positions(_registered(spark).drop("types"), _checkpoints(spark, d))


@query(POSITIONS + " SELECT * FROM pos")
def start_positions(spark, d):
    return _positions(spark, d)


@query(POSITIONS + " SELECT CASE WHEN min(position) = 0 THEN 0 ELSE min(position) + 1 END AS start, count(*) AS projections FROM pos WHERE NOT rebuild AND projection_name <> 'unstarted'")
def checkpoint_min_position(spark, d):
    return checkpoints.minimum(_positions(spark, d).where("not rebuild and projection_name <> 'unstarted'"))


@query(POSITIONS + " SELECT projection_name, count(*) AS pending, min(global_nonce) AS first, max(global_nonce) AS last FROM pos JOIN reg USING (projection_name) JOIN log ON list_contains(types, event_type) AND global_nonce > position GROUP BY projection_name")
def pending_for_projection(spark, d):
    types = _registered(spark).select("projection_name", F.explode("types").alias("event_type"))
    got = checkpoints.pending(reading.without_nonce(spark, d), _positions(spark, d).select("projection_name", "position"), types)
    return got.groupBy("projection_name").agg(F.count("*").alias("pending"), F.min("global_nonce").alias("first"), F.max("global_nonce").alias("last"))


@query(f", {REGISTERED_SQL} SELECT projection_name, event_type, count(*) AS n FROM reg JOIN log ON list_contains(types, event_type) GROUP BY ALL")
def event_type_subscription(spark, d):
    types = _registered(spark).select("projection_name", F.explode("types").alias("event_type"))
    return reading.without_nonce(spark, d).join(F.broadcast(types), "event_type").groupBy("projection_name", "event_type").agg(F.count("*").alias("n"))


@query("""SELECT tenant_id, count(*) FILTER (global_nonce <= 500) AS catching_up, count(*) FILTER (global_nonce > 500) AS live FROM log GROUP BY tenant_id""")
def catch_up_and_live(spark, d):
    behind = fold.catching_up(None, 500)
    return reading.without_nonce(spark, d).groupBy("tenant_id").agg(F.count_if(behind).alias("catching_up"), F.count_if(~behind).alias("live"))


FAILED = """f AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'accounts' ELSE 'views' END AS projection_name, event_id AS id, 'amount ' || CAST(amount // 1000 AS VARCHAR) AS error,
  CASE WHEN amount % 2 = 0 THEN 'resolved' ELSE 'pending' END AS status, amount FROM log WHERE event_type = 'error')"""


def _failed(spark, d):
    """Dead letters from error events: a pending row each, then for even amounts a row that resolves it."""
    e = _log(spark, d).where("event_type = 'error'")
    name = F.when(F.col("user_id") % 3 == 0, "accounts").otherwise("views")
    rows = e.select(F.col("event_id").alias("id"), name.alias("projection_name"), F.concat(F.lit("amount "), F.floor(F.col("amount") / 1000).cast("string")).alias("error"), F.lit(dlq.PENDING).alias("status"), F.lit(1).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("ignore_reason"), F.timestamp_millis("timestamp_unix_ms").alias("last_failed_at"))
    return dlq.mark(rows, e.where("amount % 2 = 0").select(F.col("event_id").alias("id")), dlq.RESOLVED, 2)


@query(f""", {FAILED}, o AS (SELECT *, row_number() OVER (PARTITION BY projection_name ORDER BY ts DESC, id) AS n FROM (SELECT f.*, log.ts FROM f JOIN log ON f.id = log.event_id) WHERE status = 'pending'),
m AS (SELECT projection_name, string_agg(error, ';' ORDER BY n) AS messages FROM o WHERE n <= 5 GROUP BY projection_name)
SELECT f.projection_name, count(*) FILTER (status = 'pending') AS pending, count(*) AS total, any_value(coalesce(messages, '')) AS messages FROM f LEFT JOIN m USING (projection_name) GROUP BY f.projection_name""")
def dlq_newest(spark, d):
    """Dead letters by projection, with the messages of the five newest pending ones."""
    return dlq.counts(_failed(spark, d)).withColumn("messages", F.array_join("messages", ";"))


HEALTH = POSITIONS + f""", {FAILED}, bad AS (SELECT projection_name, count(*) FILTER (status = 'pending') AS pending FROM f WHERE projection_name = 'views' GROUP BY projection_name),
hp AS (SELECT reg.projection_name, coalesce(global_position, 0) AS position, head, head - coalesce(global_position, 0) AS lag, coalesce(pending, 0) AS failed,
  coalesce(age_ms, {NOW_MS}) AS age_ms FROM reg LEFT JOIN cp USING (projection_name) LEFT JOIN bad USING (projection_name) CROSS JOIN h),
hs AS (SELECT *, CASE WHEN failed > 0 OR lag >= 1000 THEN 'unhealthy' WHEN lag >= 100 OR (age_ms > 60000 AND lag > 0) THEN 'degraded' ELSE 'healthy' END AS status FROM hp)"""


def _health(spark, d):
    failed = dlq.counts(_failed(spark, d)).where("projection_name = 'views'")
    head = reading.without_nonce(spark, d).agg(F.max("global_nonce").alias("head"))
    return health.projections(_registered(spark), _checkpoints(spark, d), head, failed, F.lit(NOW_MS))


@query(HEALTH + " SELECT * FROM hs")
def projection_health(spark, d):
    return _health(spark, d)


@query(HEALTH + """ SELECT count(*) AS total, count(*) FILTER (status = 'healthy') AS healthy, count(*) FILTER (status = 'degraded') AS degraded, count(*) FILTER (status = 'unhealthy') AS unhealthy,
  CAST(sum(lag) AS BIGINT) AS total_lag, CAST(sum(failed) AS BIGINT) AS total_failed, CASE max(CASE status WHEN 'healthy' THEN 0 WHEN 'degraded' THEN 1 ELSE 2 END) WHEN 0 THEN 'healthy' WHEN 1 THEN 'degraded' ELSE 'unhealthy' END AS overall FROM hs""")
def health_summary(spark, d):
    return health.summary(_health(spark, d))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN CASE WHEN amount % 3 = 0 AND user_id % 4 < 3 THEN 'retry' ELSE 'dead letter' END WHEN 'click' THEN CASE WHEN user_id % 4 < 3 THEN 'retry' ELSE 'dead letter' END ELSE 'advance' END AS action,
  CASE WHEN (event_type = 'click' OR (event_type = 'error' AND amount % 3 = 0)) AND user_id % 4 < 3 THEN CAST(100 * 2 ** (user_id % 4) AS BIGINT) END AS delay_ms FROM log""")
def retry_routing(spark, d):
    e = reading.from_events(spark, d)
    result = F.when(F.col("event_type") == "error", "FAILURE").when(F.col("event_type") == "click", "RETRY").when(F.col("event_type") == "view", "SKIP").otherwise("SUCCESS")
    error = F.when(F.col("event_type") == "error", F.when(F.col("amount") % 3 == 0, "Connection reset").otherwise("bad payload"))
    got = e.select("event_id", result.alias("result"), error.alias("error"), (F.col("user_id") % 4).cast("int").alias("attempt"))
    return dlq.route(got, dlq.RetryPolicy()).select("event_id", "action", "delay_ms")


# Metrics


@query(""", b(le) AS (VALUES (5.0), (10.0), (25.0), (50.0), (100.0), (NULL)),
t AS (SELECT event_type, count(*) AS n, sum(amount) AS total FROM log GROUP BY event_type)
SELECT t.event_type, CAST(le AS DOUBLE) AS le, (SELECT count(*) FROM log l WHERE l.event_type = t.event_type AND (le IS NULL OR l.amount / 100.0 <= le)) AS cumulative, n, CAST(total AS BIGINT) AS total FROM t CROSS JOIN b""")
def latency_histogram(spark, d):
    got = metrics.histogram(reading.without_nonce(spark, d), F.col("amount") / 100.0, ["event_type"], (5.0, 10.0, 25.0, 50.0, 100.0))
    return got.withColumn("total", F.round(F.col("total") * 100).cast("bigint"))


@query("""SELECT event_type, strftime(time_bucket(INTERVAL 5 minutes, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, count(*) / 300.0 AS per_second FROM log GROUP BY ALL""")
def rate_5m(spark, d):
    e = reading.without_nonce(spark, d).withColumn("ts", F.timestamp_millis("timestamp_unix_ms"))
    got = metrics.rate(e, "ts", ["event_type"])
    return got.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "per_second")


@query("""SELECT global_nonce, event_type, count(*) OVER (PARTITION BY event_type ORDER BY timestamp_unix_ms RANGE BETWEEN 299999 PRECEDING AND CURRENT ROW) / 300.0 AS per_second FROM log""")
def sliding_rate_5m(spark, d):
    e = reading.without_nonce(spark, d).withColumn("ts", F.timestamp_millis("timestamp_unix_ms"))
    return metrics.sliding_rate(e, "ts", ["event_type"]).select("global_nonce", "event_type", "per_second")


@query("""SELECT 'events_total' AS name, '{"tenant":"' || tenant_id || '","type":"' || event_type || '"}' AS labels, CAST(count(*) AS DOUBLE) AS value FROM log GROUP BY tenant_id, event_type""")
def event_counters(spark, d):
    e = reading.without_nonce(spark, d)
    labels = F.create_map(F.lit("type"), F.col("event_type"), F.lit("tenant"), F.col("tenant_id"))
    return metrics.counters(e.select(F.lit("events_total").alias("name"), labels.alias("labels"), F.lit(1.0).alias("value")))


@query("""SELECT 'events_total{tenant="' || tenant_id || '",type="' || event_type || '"} ' || CAST(count(*) AS VARCHAR) AS line FROM log GROUP BY tenant_id, event_type""")
def metrics_exposition(spark, d):
    e = reading.without_nonce(spark, d).groupBy("tenant_id", "event_type").agg(F.count("*").alias("value"))
    labels = F.create_map(F.lit("type"), F.col("event_type"), F.lit("tenant"), F.col("tenant_id"))
    return metrics.exposition(e.select(F.lit("events_total").alias("name"), labels.alias("labels"), "value"))


# Read models


def _records(spark, d):
    """Customers as records: saved, then those of one segment saved again with another status, then those below zero deleted."""
    c = _table(spark, d, "customer")
    data = F.create_map(F.lit("status"), F.lit("new"), F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    base = c.select(F.lit("customers").alias("projection"), F.col("c_name").alias("key"), data.alias("data"), F.lit(1).cast("bigint").alias("seq"), F.lit(False).alias("deleted"))
    again = base.where(F.col("data")["segment"] == "BUILDING").drop("deleted").withColumns({"data": F.map_concat(F.map_filter("data", lambda k, _: k != "status"), F.create_map(F.lit("status"), F.lit("seen"))), "seq": F.lit(2).cast("bigint")})
    changes = readmodel.save(base, again)
    gone = c.where("c_acctbal < 0").select(F.lit("customers").alias("projection"), F.col("c_name").alias("key"), F.lit(3).cast("bigint").alias("seq"))
    return readmodel.current(readmodel.delete(changes, gone))


RECORDS = """WITH r AS (SELECT c_name AS key, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation, CASE WHEN c_mktsegment = 'BUILDING' THEN 'seen' ELSE 'new' END AS status FROM customer WHERE NOT c_acctbal < 0)
"""


@query(RECORDS + "SELECT key, segment, nation, status FROM r WHERE status = 'seen' ORDER BY nation DESC, key LIMIT 20 OFFSET 5", log=False)
def readmodel_query(spark, d):
    got = readmodel.query(_records(spark, d), {"status": "seen", "absent": None}, "-nation", 20, 5)
    return got.select("key", F.col("data")["segment"].alias("segment"), F.col("data")["nation"].alias("nation"), F.col("data")["status"].alias("status"))


@query(RECORDS + "SELECT key, status FROM r WHERE starts_with(key, 'Customer#00000001') OR starts_with(key, 'Customer#1')", log=False)
def readmodel_prefix(spark, d):
    r = _records(spark, d)
    got = readmodel.by_prefix(r, "customers", "Customer#00000001").union(readmodel.by_prefix(r, "customers", "Customer#1"))
    return got.select("key", F.col("data")["status"].alias("status"))


@query("""SELECT 'order' AS kind, CAST(o_orderkey AS VARCHAR) AS key, CAST(round(o_totalprice * 100) AS BIGINT) AS amount FROM orders UNION ALL SELECT event_type, CAST(event_id AS VARCHAR), CAST(round(value * 100) AS BIGINT) FROM events""", log=False)
def union_streams(spark, d):
    o = _table(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").cast("string").alias("key"), values.cents(F.col("o_totalprice")).alias("amount"))
    return o.unionByName(_table(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("key"), values.cents(F.col("value")).alias("amount")))


@query("SELECT tenant_id, event_id, event_type FROM log")
def dedup_events(spark, d):
    """Deliveries that come twice, once."""
    e = _log(spark, d).select("tenant_id", "event_id", "event_type")
    return e.union(e.where("event_type = 'purchase'")).dropDuplicates(["tenant_id", "event_id"])


@query("""SELECT o_custkey, count(DISTINCT o_orderkey) AS orders, count(DISTINCT l_orderkey) AS shipped, count(DISTINCT CASE WHEN l_orderkey IS NULL THEN o_orderkey END) AS incomplete
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linestatus = 'F') l ON o_orderkey = l_orderkey GROUP BY o_custkey""", log=False)
def correlated_orders(spark, d):
    """Orders, their payments and shipments as streams of their own, by order."""
    o = _table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("ordered"))
    paid = o.select("order_id", F.lit(1).alias("paid"))
    shipped = _table(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("order_id")).distinct().withColumn("shipped", F.lit(1))
    got = projections.correlate(o, paid, shipped).where("ordered is not null")
    return got.groupBy(F.col("ordered").alias("o_custkey")).agg(F.count("*").alias("orders"), F.count_if(F.col("complete")).alias("shipped"), F.count_if(~F.col("complete")).alias("incomplete"))


# Lineage and graph


def _caused(spark, d):
    """Each event caused by the one before it in its stream; an error starts a new chain."""
    w = Window.partitionBy("user_id").orderBy("global_nonce")
    cause = F.when(F.col("event_type") != "error", F.lag("event_id").over(w))
    return _log(spark, d).withColumn("causation_id", cause)


CAUSED = """, c AS (SELECT *, CASE WHEN event_type <> 'error' THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY global_nonce) END AS causation_id FROM log)"""


@query(CAUSED + " SELECT p.event_type AS parent_type, c.event_type, count(*) AS n FROM c JOIN c p ON c.causation_id = p.event_id AND c.tenant_id = p.tenant_id GROUP BY ALL")
def causation_lineage(spark, d):
    return lineage.parents(_caused(spark, d)).groupBy("parent_type", "event_type").agg(F.count("*").alias("n"))


@query(
    CAUSED
    + """, d AS (SELECT event_id AS root, event_id AS id, 0 AS steps FROM c WHERE causation_id IS NULL UNION ALL SELECT d.root, c.event_id, d.steps + 1 FROM d JOIN c ON c.causation_id = d.id)
SELECT root, id, steps FROM d WHERE steps > 0"""
)
def causation_chains(spark, d):
    """All that came of every event without a cause, to the end of its chain."""
    e = _caused(spark, d).select(F.col("causation_id").alias("parent"), F.col("event_id").alias("child"))
    return lineage.descendants(spark, e.where("parent is not null"), e.where("parent is null").select(F.col("child").alias("id")))


SQL["causation_chains"] = SQL["causation_chains"].replace("WITH log", "WITH RECURSIVE log", 1)


@query("""SELECT 'corr-' || CAST(user_id % 50 AS VARCHAR) AS correlation_id, count(*) AS n_events, count(DISTINCT aggregate_id) AS n_streams, min(global_nonce) AS first, max(global_nonce) AS last, max(timestamp_unix_ms) - min(timestamp_unix_ms) AS took_ms FROM log GROUP BY 1""")
def correlations(spark, d):
    e = reading.without_nonce(spark, d)
    return lineage.correlated(e.withColumn("correlation_id", F.concat(F.lit("corr-"), (F.col("user_id") % 50).cast("string"))))


def _graph(spark, d):
    """A graph from nations and event types: a nation emits the region's name, and nations of the next region handle it."""
    n = _table(spark, d, "nation")
    emits = n.select(F.col("n_name").alias("src"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("dst"), F.lit("emits").alias("kind"))
    handled = n.select(F.concat(F.lit("R"), ((F.col("n_regionkey") + 1) % 5).cast("string")).alias("src"), F.col("n_name").alias("dst"), F.lit("handled").alias("kind"))
    command = n.select(F.concat(F.lit("Open"), F.col("n_name")).alias("src"), F.col("n_name").alias("dst"), F.lit("command").alias("kind"))
    return emits.union(handled).union(command)


GRAPH = """WITH RECURSIVE g AS (SELECT n_name AS src, 'R' || CAST(n_regionkey AS VARCHAR) AS dst, 'emits' AS kind FROM nation UNION ALL SELECT 'R' || CAST((n_regionkey + 1) % 5 AS VARCHAR), n_name, 'handled' FROM nation UNION ALL SELECT 'Open' || n_name, n_name, 'command' FROM nation)
"""


@query(GRAPH + "SELECT kind, src, array_to_string(list_sort(list(DISTINCT dst)), ',') AS targets FROM g GROUP BY kind, src", log=False)
def relationship_edges(spark, d):
    return graph.relation_maps(_graph(spark, d)).withColumn("targets", F.array_join("targets", ","))


@query(GRAPH + "SELECT DISTINCT e.src AS emitter, e.dst AS event, h.dst AS handler FROM g e JOIN g h ON e.dst = h.src AND e.kind = 'emits' AND h.kind = 'handled' WHERE e.src <> h.dst", log=False)
def cross_aggregate_flows(spark, d):
    return graph.flows(_graph(spark, d))


@query(GRAPH + """, l AS (SELECT DISTINCT a.n_regionkey AS src, (a.n_regionkey + 1) % 5 AS dst FROM nation a UNION SELECT DISTINCT n_regionkey, (n_regionkey + 2) % 5 FROM nation WHERE n_regionkey % 2 = 0),
w AS (SELECT src AS start, dst AS at, [src] AS path FROM l WHERE dst >= src UNION ALL SELECT w.start, l.dst, list_append(w.path, l.src) FROM w JOIN l ON l.src = w.at WHERE w.at <> w.start AND l.dst >= w.start AND NOT list_contains(w.path, l.src) AND len(w.path) < 12)
SELECT array_to_string(path, ' -> ') AS cycle, len(path) AS n FROM w WHERE "at" = start""", log=False)
def context_cycles(spark, d):
    n = _table(spark, d, "nation").select(F.col("n_regionkey").alias("src")).distinct()
    links = n.select("src", ((F.col("src") + 1) % 5).alias("dst")).union(n.where("src % 2 = 0").select("src", ((F.col("src") + 2) % 5).alias("dst")))
    return graph.cycles(spark, links)


@query(GRAPH + "SELECT DISTINCT dst AS event FROM g WHERE kind = 'emits' AND dst NOT IN (SELECT src FROM g WHERE kind = 'handled' AND src <> 'R2')", log=False)
def unhandled_events(spark, d):
    return graph.unhandled(_graph(spark, d).where("not (kind = 'handled' and src = 'R2')"))


@query(GRAPH + "SELECT kind, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM g GROUP BY kind", log=False)
def component_statistics(spark, d):
    return graph.statistics(_graph(spark, d))


@query(GRAPH + "SELECT dst AS event, count(*) AS n, array_to_string(list_sort(list(DISTINCT src)), ',') AS who FROM g WHERE kind = 'emits' GROUP BY dst HAVING count(*) > 1", log=False)
def duplicate_publishers(spark, d):
    got = graph.duplicates(_graph(spark, d).where("kind = 'emits'").withColumnRenamed("dst", "event"), "event", "src")
    return got.withColumn("who", F.array_join("who", ","))


@query("""SELECT n_name AS context, coalesce(c, 0) AS n_aggregates, CASE WHEN coalesce(c, 0) > 0 THEN 'bounded context' ELSE 'module' END AS kind FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS c FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON n_nationkey = s_nationkey""", log=False)
def context_kinds(spark, d):
    n = _table(spark, d, "nation")
    rich = _table(spark, d, "supplier").where("s_acctbal > 5000").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("context"))
    return graph.classify_contexts(n.select(F.col("n_name").alias("context")), rich)


# Upcasting and scalar functions


@query("""SELECT event_id, CASE WHEN event_type IN ('purchase', 'click') THEN 3 WHEN event_type = 'view' THEN 2 ELSE 1 END AS event_version, json_extract_string(payload, '$.k') AS k,
  CASE WHEN event_type = 'purchase' THEN 'EUR' END AS currency, CASE WHEN event_type IN ('purchase', 'click') THEN 'k' || json_extract_string(payload, '$.k') END AS label, CASE WHEN event_type = 'view' THEN 'web' WHEN event_type = 'click' THEN 'none' END AS channel FROM log""")
def upcast_events(spark, d):
    """Version 1 events by chains of upcasters: constants, and fields made from older fields."""
    e = _log(spark, d).withColumn("payload", F.from_json("payload", "map<string,string>"))
    label = upcast.with_fields(label=lambda p: F.concat(F.lit("k"), p["k"]))
    chain = [
        upcast.Upcaster("purchase", 1, upcast.with_fields(currency=F.lit("EUR"))), upcast.Upcaster("purchase", 2, label),
        upcast.Upcaster("view", 1, upcast.with_fields(channel=F.lit("web"))),
        upcast.Upcaster("click", 1, upcast.with_fields(channel=F.lit("none"))), upcast.Upcaster("click", 2, label),
    ]
    got = upcast.upcast(e, chain)
    return got.select("event_id", "event_version", *(F.col("payload")[c].alias(c) for c in ("k", "currency", "label", "channel")))


@query("""SELECT n_name AS name, lower(n_name[1]) || lower(n_name[2:]) AS lowered, 'on_' || lower(n_name) AS handler, regexp_replace(n_name, '[^A-Za-z0-9_]', '_', 'g') AS clean, lower(n_name) LIKE '%an%' AS classified FROM nation""", log=False)
def name_functions(spark, d):
    n = F.col("n_name")
    return _table(spark, d, "nation").select(n.alias("name"), text.pascal_to_camel(F.lower(n)).alias("lowered"), F.concat(F.lit("on_"), F.lower(n)).alias("handler"), text.sanitized(n).alias("clean"), text.contains_any(n, ["an"]).alias("classified"))


def _values(e):
    notice = F.concat(F.col("tenant_id"), F.lit(":"), F.col("global_nonce").cast("string"))
    return e.select("event_id", values.backoff_ms(F.col("aggregate_nonce")).alias("delay_ms"), values.saturating_minus(F.col("global_nonce"), 500).alias("lag"), notice.alias("notice"), text.notice(notice)["tenant_id"].alias("notice_tenant"))


@query("""SELECT event_id, CAST(least(30000.0, 100.0 * 2.0 ** least(aggregate_nonce - 1, 60)) AS BIGINT) AS delay_ms, greatest(0, global_nonce - 500) AS lag, tenant_id || ':' || CAST(global_nonce AS VARCHAR) AS notice, tenant_id AS notice_tenant FROM log""")
def value_functions_all(spark, d):
    """The value functions over every event."""
    return _values(_log(spark, d))


@query("""SELECT event_id, event_type <> 'purchase' AS is_generic, CASE WHEN event_type = 'purchase' THEN CAST(json_extract(payload, '$.k') AS INTEGER) END AS k,
  CASE WHEN event_type <> 'purchase' THEN json_extract_string(payload, '$.k') END AS generic_k FROM log""")
def decoded_events(spark, d):
    """Payloads of a registered type as a struct, of others as a map."""
    got = envelope.decode(_log(spark, d).select("event_id", "event_type", "payload"), {"purchase": "k int"})
    return got.select("event_id", "is_generic", F.col("as_purchase.k").alias("k"), F.col("fields")["k"].alias("generic_k"))


@query("""SELECT event_id, event_type AS type, CAST(event_version AS VARCHAR) AS version, aggregate_id, json_extract_string(payload, '$.k') AS k FROM log""")
def serialized_events(spark, d):
    """Envelopes to JSON and back."""
    j = envelope.to_json(_log(spark, d))
    return j.select("event_id", *(F.get_json_object("json", p).alias(n) for n, p in (("type", "$.type"), ("version", "$.version"), ("aggregate_id", "$.metadata.aggregate_id"), ("k", "$.data.k"))))


@query("""SELECT event_id, coalesce(CASE WHEN user_id % 3 = 0 THEN 'own' END, 'ctx-' || tenant_id) AS correlation_id, CASE WHEN user_id % 2 = 0 THEN 'mine' ELSE 'theirs' END AS trace, 'b' AS region FROM log""")
def context_merge(spark, d):
    """Context over events: what they have themselves stays."""
    e = _log(spark, d).withColumn("correlation_id", F.when(F.col("user_id") % 3 == 0, "own").otherwise(""))
    e = e.withColumn("headers", F.when(F.col("user_id") % 2 == 0, F.create_map(F.lit("trace"), F.lit("mine"))))
    common = F.create_map(F.lit("trace"), F.lit("theirs"), F.lit("region"), F.lit("b"))
    got = envelope.with_context(e, correlation_id=F.concat(F.lit("ctx-"), F.col("tenant_id")), headers=common)
    return got.select("event_id", "correlation_id", F.col("headers")["trace"].alias("trace"), F.col("headers")["region"].alias("region"))


@query(HEALTH + """ SELECT 'events_appended_total' AS name, event_type AS label, CAST(count(*) AS DOUBLE) AS value FROM log GROUP BY event_type
UNION ALL SELECT 'projection_lag', projection_name, CAST(lag AS DOUBLE) FROM hs UNION ALL SELECT 'projection_position', projection_name, CAST(position AS DOUBLE) FROM hs
UNION ALL SELECT 'projection_failed_events', projection_name, CAST(failed AS DOUBLE) FROM hs UNION ALL SELECT 'projection_up', projection_name, CASE WHEN status = 'unhealthy' THEN 0.0 ELSE 1.0 END FROM hs""")
def log_metrics(spark, d):
    got = metrics.of_log(reading.without_nonce(spark, d), _health(spark, d))
    return got.select("name", F.element_at(F.map_values("labels"), 1).alias("label"), "value")


@query("""SELECT CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS revenue, count(*) AS orders, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / count(*) AS average FROM orders WHERE o_orderstatus <> 'F'""", log=False)
def average_order_value(spark, d):
    price = F.round(F.col("o_totalprice") * 100).cast("bigint")
    got = _table(spark, d, "orders").where("o_orderstatus <> 'F'").agg(F.sum(price).alias("revenue"), F.count("*").alias("orders"))
    return got.withColumn("average", F.col("revenue") / F.col("orders"))


@query("""SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""", log=False)
def unprimed_sources(spark, d):
    """Sources that were never polled: an anti-join."""
    return _table(spark, d, "customer").select(F.col("c_custkey").alias("id")).join(_table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")), "id", "left_anti")


@query("""SELECT tenant_id, aggregate_id, aggregate_nonce, event_type, CAST(sum(CASE event_type WHEN 'purchase' THEN amount WHEN 'error' THEN -amount ELSE 0 END) OVER (PARTITION BY tenant_id, aggregate_id ORDER BY aggregate_nonce ROWS UNBOUNDED PRECEDING) AS BIGINT) AS state FROM log""")
def step_by_step_replay(spark, d):
    """State after each event of every stream, by the general fold, one a stream."""
    step = fold.dispatch({"purchase": lambda s, e: s + e["amount"], "error": lambda s, e: s - e["amount"]})
    got = fold.history(_log(spark, d), projections.STREAM, "aggregate_nonce", ["event_type", "amount"], F.lit(0).cast("bigint"), step)
    return got.select(*projections.STREAM, "aggregate_nonce", "event_type", "state")


@query("""SELECT tenant_id, aggregate_id, aggregate_nonce, event_type, CAST(sum(CASE event_type WHEN 'purchase' THEN amount WHEN 'error' THEN -amount ELSE 0 END) OVER (PARTITION BY tenant_id, aggregate_id ORDER BY aggregate_nonce ROWS UNBOUNDED PRECEDING) AS BIGINT) AS state FROM log""")
def replay_all_streams(spark, d):
    """State after each event of every stream, as a running sum."""
    change = F.when(F.col("event_type") == "purchase", F.col("amount")).when(F.col("event_type") == "error", -F.col("amount")).otherwise(F.lit(0).cast("bigint"))
    got = fold.running_sum(_log(spark, d), projections.STREAM, change, "aggregate_nonce", "state")
    return got.select(*projections.STREAM, "aggregate_nonce", "event_type", "state")


@query("""SELECT tenant_id, aggregate_id, global_nonce, event_type, state FROM (SELECT *, sum(CASE event_type WHEN 'purchase' THEN amount WHEN 'error' THEN -amount ELSE 0 END) OVER (PARTITION BY tenant_id, aggregate_id ORDER BY global_nonce ROWS UNBOUNDED PRECEDING) AS state FROM log) WHERE NOT state >= -20000""")
def invariant_violations(spark, d):
    """Events after which a stream's running balance is below a limit."""
    change = F.when(F.col("event_type") == "purchase", F.col("amount")).when(F.col("event_type") == "error", -F.col("amount")).otherwise(F.lit(0).cast("bigint"))
    return fold.violations(reading.without_nonce(spark, d), F.sum(change).over(fold.by_stream(projections.STREAM)), F.col("state") >= -20000, projections.STREAM)


def _tree(spark, d):
    """A source tree made of nations: each a context with an aggregate that imports from layers by region."""
    n = _table(spark, d, "nation")
    path = F.concat(F.lit("contexts/"), F.lower("n_name"), F.lit("/domain/"), F.col("n_name"), F.lit("Aggregate.ts"))
    target = F.element_at(F.array(*map(F.lit, ("../infrastructure/db", "./values", "../application/service", "./more", "../events/list"))), F.col("n_regionkey") + 1)
    return n.select(path.alias("path"), F.concat(F.lit("import { X } from '"), target, F.lit("';\nexport class N"), F.col("n_nationkey").cast("string"), F.lit("Aggregate {}")).alias("text"))


@query("""SELECT 'layer-dependency' AS rule, 'error' AS severity, 'contexts/' || lower(n_name) || '/domain/' || n_name || 'Aggregate.ts' AS path,
  'domain imports ' || CASE n_regionkey WHEN 0 THEN 'infrastructure ../infrastructure/db' ELSE 'application ../application/service' END AS message FROM nation WHERE n_regionkey IN (0, 2)""", log=False)
def layer_violations(spark, d):
    return rules.check(_tree(spark, d))


@query("""SELECT 'aggregate' AS kind, 'N' || CAST(n_nationkey AS VARCHAR) || 'Aggregate' AS name, lower(n_name) AS context FROM nation""", log=False)
def scanned_components(spark, d):
    return rules.components(_tree(spark, d)).select("kind", "name", "context")


@query("""SELECT count(*) FILTER (n_regionkey IN (0, 2)) AS errors, 0 AS warnings, count(*) FILTER (n_regionkey IN (0, 2)) = 0 AS is_valid FROM nation""", log=False)
def architecture_report(spark, d):
    return rules.report(rules.check(_tree(spark, d)))


# The coordinator over a log: state in files, started anew for each batch


def _root(spark):
    return f"{shared_dir(spark)}/coordinator-{uuid.uuid4().hex}"


@query("SELECT event_type, count(*) AS n FROM log WHERE event_type IN ('purchase', 'error', 'view') GROUP BY event_type")
def coordinator_counts(spark, d):
    """A projection that counts, fed in three batches by a coordinator that is started anew for each, one of them delivered twice."""
    log, root = _log(spark, d), _root(spark)

    def count(events, context):
        events.groupBy("event_type").agg(F.count("*").alias("n")).write.parquet(f"{root}/counts/{uuid.uuid4().hex}")

    third = log.agg(F.max("global_nonce")).first()[0] // 3
    for i in (0, 1, 1, 2):
        part = log.where((F.col("global_nonce") > i * third) & ((F.col("global_nonce") <= (i + 1) * third) | F.lit(i == 2)))
        runtime.Coordinator(spark, root, [runtime.Projection("counts", count, ["purchase", "error", "view"])], boundary=third // 2).run_batch(part, i)
    return spark.read.parquet(f"{root}/counts/*").groupBy("event_type").agg(F.sum("n").alias("n"))


@query("""SELECT 'kept' AS projection_name, max(global_nonce) AS global_position, 1 AS version FROM log UNION ALL SELECT 'rebuilt', max(global_nonce), 1 FROM log
UNION ALL SELECT 'changed', max(global_nonce), 2 FROM log""")
def coordinator_checkpoints(spark, d):
    """Checkpoints by name after a run, a rebuild of one projection, a change of another's version, and a second run."""
    log, root = _log(spark, d), _root(spark)

    def build(version):
        return runtime.Coordinator(spark, root, [runtime.Projection(n, lambda *_: None, version=v) for n, v in (("kept", 1), ("rebuilt", 1), ("changed", version))])

    first = build(1)
    first.run_table(log)
    first.rebuild("rebuilt")
    again = build(2)
    again.run_table(log)
    return checkpoints.listing(again.checkpoints()).drop("updated_at")


@query("""SELECT 'outcomes' AS projection_name, event_type, CASE event_type WHEN 'error' THEN 1 ELSE 3 END AS attempts, count(*) AS n FROM log WHERE event_type IN ('error', 'click') GROUP BY event_type""")
def coordinator_dead_letters(spark, d):
    """Outcomes by event: errors fail for good, clicks are tried three times, views are skipped."""
    log, root = _log(spark, d), _root(spark)

    def handle(events, _):
        result = F.when(F.col("event_type") == "error", "FAILURE").when(F.col("event_type") == "click", "RETRY").when(F.col("event_type") == "view", "SKIP").otherwise("SUCCESS")
        return events.select("event_id", result.alias("result"), F.lit("no such payload").alias("error"))

    c = runtime.Coordinator(spark, root, [runtime.Projection("outcomes", handle)], sleep=lambda _: None)
    c.run_table(log)
    return c.dead_letters().groupBy("projection_name", "event_type", "attempts").agg(F.count("*").alias("n"))


@query("SELECT aggregate_id AS key FROM log WHERE event_type = 'signup' AND global_nonce > 0 GROUP BY aggregate_id")
def process_manager_items(spark, d):
    """What a process manager has to do: an item a user who signed up, found in two batches by managers started anew; nothing is acted on."""
    log, root = _log(spark, d), _root(spark)
    half = log.agg(F.max("global_nonce")).first()[0] // 2
    for part in (log.where(F.col("global_nonce") <= half), log):
        manager = runtime.ProcessManager("greetings", lambda e: e.where("event_type = 'signup'").select(F.col("aggregate_id").alias("key")), print, spark, root)
        runtime.Coordinator(spark, root, [], [manager], boundary=1 << 62).run_batch(part, 0)
    return manager.pending()


@query("""SELECT event_id AS request_id, CASE WHEN user_id % 3 = 0 THEN 'PermissionDenied' WHEN user_id % 3 = 1 THEN 'DuplicateEvent'
  WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1 THEN 'Concurrency' ELSE 'ok' END AS status FROM log""")
def append_refusals(spark, d):
    """A request an event: to a stranger's tenant, with an id that the log has, or right; of right ones for a stream the first goes in."""
    log = _log(spark, d)
    own = F.when(F.col("user_id") % 3 == 0, "stranger").otherwise(F.lit(""))
    known = F.when(F.col("user_id") % 3 == 1, F.col("event_id")).otherwise(F.concat(F.lit("new-"), "event_id"))
    head = append.heads_of(log).select("aggregate_id", "head")
    none, empty = F.lit(""), F.lit(None)
    event = F.struct(
        own.alias("tenant_id"), none.alias("aggregate_id"), none.alias("aggregate_type"), (F.col("head") + 1).alias("aggregate_nonce"), known.alias("event_id"), "event_type", F.lit(1).alias("event_version"),
        *(none.alias(c) for c in ("content_type", "content_schema", "correlation_id", "causation_id", "actor_id")), *(F.lit(0).cast("bigint").alias(c) for c in ("timestamp_unix_ms", "recorded_time_unix_ms")),
        empty.cast("binary").alias("payload_sha256"), empty.cast("map<string,string>").alias("headers"), F.col("payload").cast("binary").alias("payload"),
    )
    requests = log.join(head, "aggregate_id").select(F.col("event_id").alias("request_id"), "tenant_id", "aggregate_id", "aggregate_type", F.col("head").alias("expected"), none.alias("idempotency_key"), F.array(event).alias("events"))
    ledger = spark.createDataFrame([], "tenant_id string, aggregate_id string, idempotency_key string, fingerprint string, last_nonce bigint")
    return append.outcomes(append.validate(requests, append.heads_of(log), ledger, log.select("tenant_id", "event_id"))).select("request_id", "status")


@query(HEALTH + """ SELECT 'es_events_appended_total' AS name, event_type AS label, CAST(count(*) AS DOUBLE) AS value FROM log GROUP BY event_type
UNION ALL SELECT 'es_projection_lag_events', projection_name, CAST(lag AS DOUBLE) FROM hs UNION ALL SELECT 'es_dlq_size', projection_name, CAST(failed AS DOUBLE) FROM hs
UNION ALL SELECT 'es_projection_errors_total', projection_name, CAST(count(*) AS DOUBLE) FROM f GROUP BY projection_name
UNION ALL SELECT 'es_retries_total', projection_name, CAST(sum(amount % 3) AS DOUBLE) FROM f GROUP BY projection_name
UNION ALL SELECT 'es_projection_events_processed_total', projection_name, CAST(count(*) AS DOUBLE) FROM reg JOIN log ON list_contains(types, event_type) GROUP BY projection_name""")
def es_metrics(spark, d):
    """The standard counters and gauges of a log, its projections and their dead letters."""
    e = _log(spark, d).where("event_type = 'error'")
    failed = e.select(F.when(F.col("user_id") % 3 == 0, "accounts").otherwise("views").alias("projection_name"), (F.col("amount") % 3 + 1).alias("attempts"))
    types = _registered(spark).select("projection_name", F.explode("types").alias("event_type"))
    log = reading.without_nonce(spark, d)
    got = metrics.standard(log, _health(spark, d), failed, log.join(F.broadcast(types), "event_type"))
    return got.select("name", F.element_at(F.map_values("labels"), 1).alias("label"), "value")


@query("""SELECT '# HELP es_command_duration_seconds Time of a command' AS line UNION ALL SELECT '# TYPE es_command_duration_seconds histogram'
UNION ALL SELECT 'es_command_duration_seconds_bucket{type="' || event_type || '",le="' || le || '"} ' || (SELECT count(*) FROM log l WHERE l.event_type = t.event_type AND (bound IS NULL OR l.amount <= bound))
  FROM (SELECT DISTINCT event_type FROM log) t CROSS JOIN (VALUES ('1000.0', 1000), ('5000.0', 5000), ('+Inf', NULL)) b(le, bound)
UNION ALL SELECT 'es_command_duration_seconds_count{type="' || event_type || '"} ' || count(*) FROM log GROUP BY event_type
UNION ALL SELECT 'es_command_duration_seconds_sum{type="' || event_type || '"} ' || sum(amount) FROM log GROUP BY event_type""")
def histogram_lines(spark, d):
    """A histogram in the text form: HELP, TYPE, buckets, sum and count."""
    name = "es_command_duration_seconds"
    h = metrics.histogram(reading.without_nonce(spark, d), F.col("amount"), ["event_type"], (1000.0, 5000.0))
    top = spark.createDataFrame([(name, "Time of a command", metrics.NAMES[name])], "name string, help string, type string")
    return metrics.headers(top).union(metrics.histogram_exposition(h, name, F.create_map(F.lit("type"), F.col("event_type"))))


#: A tree of two contexts that violates every rule, one nation's name at the front of each; the codes each file has.
VIOLATING = [
    ("A/slices/pay/PayCommand.ts", "export class PayCommand {}", "001 002 003 020"), ("A/slices/pay/sub/one/two/three/Deep.ts", "x", "005"), ("A/slices/get/getQuery.ts", "export class GetQuery {}", "001 004 007 008"),
    ("A/slices/list/ListProjection.ts", "import axios from 'axios'\nimport { X } from '../pay/PayCommand'\nexport class ListProjection {}", "009 010 032"), ("A/slices/list/ListController.ts", "\n" * 60, "001 011"),
    ("A/slices/list/Reach.ts", "import { Db } from '../../infrastructure/Db'", "031 206"), ("A/PayCommandHandler.ts", "export class PayCommandHandler {}", "015"), ("A/PaidEvent.ts", "export class PaidEvent {}", "021"),
    ("A/PayAggregate.ts", "export class PayAggregate {}", "022"), ("A/StorePort.ts", "export interface StorePort {}", "023"), ("A/CommandBus.ts", "export class CommandBus {}", "024 200 205"),
    ("A/ports/Mailer.ts", "import { Db } from '../infrastructure/Db'\nexport interface Mailer {}", "025 029 206"), ("A/domain/value-objects/Money.ts", "export class Money {}", "026"),
    ("A/domain/CartAggregate.ts", "import { S } from '../application/S'\nexport class CartAggregate {}", "027 027 206"), ("A/domain/events/ShippedEvent.ts", "export class ShippedEvent {}", ""), ("A/events/E.ts", "import { C } from '../domain/C'", "028 206"),
    ("A/application/S.ts", "import { Db } from '../infrastructure/Db'", "030 206"), ("A/infrastructure/Db.ts", "export class Db {}", ""), ("A/ShipProcessManager.ts", "export class ShipProcessManager {}", "033"),
    ("A/OutIntegrationEvent.ts", "export class OutIntegrationEvent {}", "021 101"), ("A/integration-events/AOdd.ts", "export class Odd_A {}", "102"), ("B/integration-events/BOdd.ts", "export class B_Odd {}", "102"),
    ("B/Use.ts", "import { C } from '../A/domain/CartAggregate'", "200 201 203 204 205"), ("A/Use.ts", "import { C } from '../B/Use'", "201"),
]


def _violating(spark, d):
    """VIOLATING once for each nation: A is the context a<key>, B is b<key>."""
    rows = spark.createDataFrame([(p, t) for p, t, _ in VIOLATING], "p string, t string")
    n = _table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("k"))

    def named(c):
        a = F.regexp_replace(F.regexp_replace(c, r"(^|\.\./)A/", F.concat(F.lit("$1a"), "k", F.lit("/"))), r"(^|\.\./)B/", F.concat(F.lit("$1b"), "k", F.lit("/")))
        return a

    return n.join(F.broadcast(rows)).select(F.concat(F.lit("contexts/"), named(F.col("p"))).alias("path"), named(F.col("t")).alias("text"))


@query("WITH v(code) AS (VALUES " + ", ".join(f"('VSA{c}')" for _, _, codes in VIOLATING for c in codes.split()) + """)
SELECT code, count(*) AS n FROM v CROSS JOIN nation GROUP BY code UNION ALL SELECT 'VSA202', 1 UNION ALL SELECT 'VSA100', 2""", log=False)
def rule_codes(spark, d):
    """How often each rule is violated by a tree in which a nation has two contexts that violate most; two names are in all of them."""
    return rules.check_codes(_violating(spark, d)).groupBy("code").agg(F.count("*").alias("n"))
