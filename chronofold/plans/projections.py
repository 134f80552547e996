"""Read models as folds over the log: accounts, orders, sales, customers, stock.

The vocabulary of the account folds is a mapping, so the same fold runs over the driver's events
(signup opens, purchase deposits, error withdraws) and over a bank's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.operators import fold

STREAM = ["tenant_id", "aggregate_id"]


@dataclass(frozen=True)
class Accounts:
    """Event types of an account, and the column with the amount in cents."""

    opened: str = "AccountOpened"
    deposited: str = "MoneyDeposited"
    withdrawn: str = "MoneyWithdrawn"
    closed: str = "AccountClosed"
    amount: str = "amount"

    @property
    def types(self) -> list[str]:
        return [self.opened, self.deposited, self.withdrawn, self.closed]

    def signed(self) -> Column:
        t = F.col("event_type")
        return F.when(t == self.deposited, F.col(self.amount)).when(t == self.withdrawn, -F.col(self.amount)).otherwise(F.lit(0).cast("bigint"))

    def moves(self) -> Column:
        return F.col("event_type").isin(self.deposited, self.withdrawn)


USERS = Accounts("signup", "purchase", "error", "closed")


def account_summary(log: DataFrame, a: Accounts = USERS) -> DataFrame:
    """Balance, transactions, status and last activity of each account. Opening again starts afresh; before it nothing counts."""
    own = fold.last_segment(log.where(F.col("event_type").isin(a.types)), STREAM, F.col("event_type") == a.opened)
    opening = F.sum(F.when(F.col("event_type") == a.opened, F.col(a.amount)).otherwise(F.lit(0).cast("bigint")))
    closed = F.max(F.when(F.col("event_type") == a.closed, 1).otherwise(0))
    return own.groupBy(*STREAM).agg(
        (opening + F.sum(a.signed())).alias("balance"),
        F.count_if(a.moves()).alias("transactions"),
        F.when(closed == 1, "Closed").otherwise("Open").alias("status"),
        F.max_by("timestamp_unix_ms", "global_nonce").alias("last_activity"),
    )


def transaction_history(log: DataFrame, a: Accounts = USERS) -> DataFrame:
    """Each deposit and withdrawal with the balance after it; the base is the last opening before (0 without)."""
    own = log.where(F.col("event_type").isin(a.opened, a.deposited, a.withdrawn))
    own = fold.segment(own, STREAM, F.col("event_type") == a.opened)
    change = F.when(F.col("event_type") == a.opened, F.col(a.amount)).otherwise(a.signed())
    own = fold.running_sum(own, [*STREAM, "segment"], change, name="balance_after")
    kind = F.when(F.col("event_type") == a.deposited, "deposit").otherwise("withdrawal")
    return own.where(a.moves()).select(*STREAM, "global_nonce", kind.alias("type"), F.col(a.amount).alias("amount"), "balance_after")


def accounts_by_customer(log: DataFrame, customer: Column, a: Accounts = USERS) -> DataFrame:
    """Account summaries with the customer that the last opening names; a customer's accounts are a filter on it."""
    owner = log.where(F.col("event_type") == a.opened).groupBy(*STREAM).agg(F.max_by(customer, "aggregate_nonce").alias("customer_id"))
    return account_summary(log, a).join(owner, list(STREAM))


def accounts_by_tenant(summary: DataFrame) -> DataFrame:
    return summary.groupBy("tenant_id").agg(F.count("*").alias("accounts"), F.sum("balance").alias("balance"), F.count_if(F.col("status") == "Open").alias("open"), F.sum("transactions").alias("transactions"))


def status_counts(log: DataFrame, up: str, down: str) -> DataFrame:
    """Orders by status as a running counter that stops at 0: its last value for each tenant, and the highest."""
    own = log.where(F.col("event_type").isin(up, down))
    change = F.when(F.col("event_type") == up, 1).otherwise(-1).cast("bigint")
    own = fold.clamped_count(own, ["tenant_id"], change)
    return own.groupBy("tenant_id").agg(F.max_by("clamped", "global_nonce").alias("now"), F.max("clamped").alias("most"), F.count("*").alias("changes"))


def order_summary(orders: DataFrame) -> DataFrame:
    """Orders, revenue in cents and average, by status."""
    total = F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint"))
    return orders.groupBy("o_orderstatus").agg(F.count("*").alias("orders"), total.alias("revenue"), F.floor(total / F.count("*")).cast("bigint").alias("average"))


def daily_sales(log: DataFrame, sale: str) -> DataFrame:
    """Revenue, count and average by UTC day."""
    day = F.date_format(F.timestamp_millis("timestamp_unix_ms"), "yyyy-MM-dd")
    own = log.where(F.col("event_type") == sale).groupBy(day.alias("day"))
    return own.agg(F.sum("amount").alias("revenue"), F.count("*").alias("sales"), F.floor(F.sum("amount") / F.count("*")).cast("bigint").alias("average"))


def product_sales(lines: DataFrame, top: int = 10) -> DataFrame:
    """Products by revenue (cents), the first `top`; ties by product."""
    price = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    got = lines.groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"), F.sum(price).alias("revenue"))
    return got.orderBy(F.col("revenue").desc(), "l_partkey").limit(top)


def customer_history(orders: DataFrame) -> DataFrame:
    """Orders, lifetime value in cents, first and last order of each customer."""
    when = F.struct("o_orderdate", "o_orderkey")
    return orders.groupBy("o_custkey").agg(
        F.count("*").alias("orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("value"), F.min_by("o_orderkey", when).alias("first_order"), F.max_by("o_orderkey", when).alias("last_order")
    )


def customer_orders(orders: DataFrame) -> DataFrame:
    """Each customer's orders in order of time, with their number and the lifetime value (cents) up to each. A row an order, so no customer is a collected list."""
    own = orders.withColumn("total", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    value = F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return own.select("o_custkey", F.row_number().over(w).alias("n"), "o_orderkey", "o_orderdate", "total", value.alias("value"))


def get_order(orders: DataFrame, key: int) -> DataFrame:
    return orders.where(F.col("o_orderkey") == key)


def list_orders(orders: DataFrame, customer: int | None = None, status: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of the orders of a customer, of a status, or of all, oldest first."""
    for column, wanted in (("o_custkey", customer), ("o_orderstatus", status)):
        orders = orders if wanted is None else orders.where(F.col(column) == wanted)
    return orders.orderBy("o_orderdate", "o_orderkey").offset(offset).limit(limit)


def sales_of_items(orders: DataFrame, items: str = "items") -> DataFrame:
    """Quantity, revenue (cents) and orders by product, of orders with an array of (product, quantity, price)."""
    each = orders.select("order_id", F.explode(items).alias("i")).select("order_id", "i.*")
    # an order that has a product twice is one order of it; first by both, which also spreads a hot product
    by_order = each.groupBy("product", "order_id").agg(F.sum("quantity").alias("quantity"), F.sum("price").alias("revenue"))
    return by_order.groupBy("product").agg(F.sum("quantity").alias("quantity"), F.sum("revenue").alias("revenue"), F.count("*").alias("orders"))


def order_totals(lines: DataFrame) -> DataFrame:
    """Each order's total in cents, lines and quantity."""
    price = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return lines.groupBy("l_orderkey").agg(F.sum(price).alias("total"), F.count("*").alias("lines"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))


def inventory(log: DataFrame, added: str, removed: str, reserved: str) -> DataFrame:
    """Stock by stream: total, reserved, available."""
    def of(kind: str) -> Column:
        return F.sum(F.when(F.col("event_type") == kind, F.col("amount")).otherwise(F.lit(0).cast("bigint")))

    got = log.where(F.col("event_type").isin(added, removed, reserved)).groupBy(*STREAM).agg((of(added) - of(removed)).alias("total"), of(reserved).alias("reserved"))
    return got.withColumn("available", F.col("total") - F.col("reserved"))


@dataclass(frozen=True)
class Products:
    """Event types of products. `amount` is the quantity of a movement and the price of a creation or change; `stock` what a creation opens with."""

    created: str
    priced: str
    added: str
    removed: str
    amount: str = "amount"
    stock: str = "stock"

    def change(self) -> Column:
        of = F.when(F.col("event_type") == self.created, F.col(self.stock)).when(F.col("event_type") == self.added, F.col(self.amount))
        return of.when(F.col("event_type") == self.removed, -F.col(self.amount)).otherwise(F.lit(0).cast("bigint"))

    def price(self) -> Column:
        return F.when(F.col("event_type").isin(self.created, self.priced), F.col(self.amount))


def _before(log: DataFrame, created: str) -> tuple[Column, object]:
    """Whether a stream's creation came before an event, and the window of the events before it."""
    w = Window.partitionBy(*STREAM).orderBy("aggregate_nonce").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(F.col("event_type") == created).over(w), F.lit(False)), w


def product_states(log: DataFrame, p: Products) -> DataFrame:
    """Price and stock of each product after its events."""
    own = log.where(F.col("event_type").isin(p.created, p.priced, p.added, p.removed))
    price = F.max_by(p.price(), F.when(p.price().isNotNull(), F.col("aggregate_nonce")))
    return own.groupBy(*STREAM).agg(price.alias("price"), F.sum(p.change()).alias("stock"))


def product_violations(log: DataFrame, p: Products) -> DataFrame:
    """Events that break a rule of products in the state they meet: the first rule broken, in the order below."""
    own = log.where(F.col("event_type").isin(p.created, p.priced, p.added, p.removed))
    exists, w = _before(own, p.created)
    kind, amount = F.col("event_type"), F.col(p.amount)
    own = own.withColumns({"there": exists, "stock_before": F.coalesce(F.sum(p.change()).over(w), F.lit(0).cast("bigint")), "price_before": F.last(p.price(), ignorenulls=True).over(w)})
    moves = kind.isin(p.added, p.removed)
    rule = F.when((kind == p.created) & F.col("there"), "exists already").when((kind != p.created) & ~F.col("there"), "does not exist")
    rule = rule.when(~moves & (amount < 0), "negative price").when((kind == p.created) & (F.col(p.stock) < 0), "negative stock")
    rule = rule.when((kind == p.priced) & (amount == F.col("price_before")), "same price").when(moves & (amount <= 0), "quantity not positive")
    rule = rule.when((kind == p.removed) & (F.col("stock_before") < amount), "insufficient stock")
    return own.withColumn("rule", rule).where("rule is not null").select(*STREAM, "aggregate_nonce", "event_type", "rule")


def customer_states(log: DataFrame, registered: str, moved: str, address: Column) -> DataFrame:
    """The address of each customer after its events, and how often it changed."""
    own = log.where(F.col("event_type").isin(registered, moved))
    return own.groupBy(*STREAM).agg(F.max_by(address, "aggregate_nonce").alias("address"), F.count_if(F.col("event_type") == moved).alias("moves"))


def customer_violations(log: DataFrame, registered: str, moved: str, address: Column) -> DataFrame:
    """Events that break a rule of customers in the state they meet: the first rule broken."""
    own = log.where(F.col("event_type").isin(registered, moved)).withColumn("to", address)
    exists, w = _before(own, registered)
    own = own.withColumns({"there": exists, "from": F.last("to").over(w)})
    kind = F.col("event_type")
    rule = F.when((kind == registered) & F.col("there"), "registered already").when((kind == moved) & ~F.col("there"), "does not exist")
    rule = rule.when(F.coalesce(F.col("to"), F.lit("")) == "", "no address").when((kind == moved) & (F.col("to") == F.col("from")), "same address")
    return own.withColumn("rule", rule).where("rule is not null").select(*STREAM, "aggregate_nonce", "event_type", "rule")


@dataclass(frozen=True)
class Machine:
    """A state machine: initial state, and transitions (event type, from, to)."""

    initial: str
    transitions: tuple[tuple[str, str, str], ...]

    def step(self) -> fold.Step:
        def step(state: Column, e: Column) -> Column:
            to = F.lit(None).cast("string")
            for kind, before, after in self.transitions:
                to = F.when((e["event_type"] == kind) & (state == before), after).otherwise(to)
            return F.coalesce(to, state)

        return step


ORDER = Machine("NEW", (("OrderCreated", "NEW", "DRAFT"), ("OrderSubmitted", "NEW", "DRAFT"), ("OrderConfirmed", "DRAFT", "CONFIRMED"), ("OrderShipped", "CONFIRMED", "SHIPPED"), ("OrderCancelled", "DRAFT", "CANCELLED"), ("OrderCancelled", "CONFIRMED", "CANCELLED")))
ACCOUNT = Machine("NEW", (("AccountOpened", "NEW", "Open"), ("AccountClosed", "Open", "Closed"), ("AccountOpened", "Closed", "Open")))


def states(log: DataFrame, machine: Machine) -> DataFrame:
    """Each stream's state after its events; an event that has no transition from the state changes nothing."""
    return fold.fold(log, STREAM, "aggregate_nonce", ["event_type"], F.lit(machine.initial), machine.step())


def refused(log: DataFrame, machine: Machine) -> DataFrame:
    """Events that had no transition from the state they met: what a command handler would have refused."""
    steps = fold.history(log, STREAM, "aggregate_nonce", ["event_type"], F.lit(machine.initial), machine.step())
    before = F.coalesce(F.lag("state").over(Window.partitionBy(*STREAM).orderBy("aggregate_nonce")), F.lit(machine.initial))
    known = {k for k, _, _ in machine.transitions}
    return steps.withColumn("before", before).where(F.col("event_type").isin(*known) & (F.col("before") == F.col("state"))).select(*STREAM, "aggregate_nonce", "event_type", "before")


def overdrafts(log: DataFrame, a: Accounts = USERS) -> DataFrame:
    """Withdrawals that took an account below zero."""
    return transaction_history(log, a).where("type = 'withdrawal' and balance_after < 0")


def correlate(orders: DataFrame, payments: DataFrame, shipments: DataFrame, key: str = "order_id") -> DataFrame:
    """Streams of several kinds by a business key: what is there of each."""
    got = orders.join(payments, key, "full").join(shipments, key, "full")
    return got.withColumn("complete", F.col("ordered").isNotNull() & F.col("paid").isNotNull() & F.col("shipped").isNotNull())
