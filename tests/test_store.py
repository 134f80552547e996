from __future__ import annotations

import json
import pathlib

import pytest

from chronofold import schema
from chronofold.operators import envelope
from chronofold.plans.bus import Aggregate, CommandBus, QueryBus, Repository, applies, handles
from chronofold.schema import T
from chronofold.sources import log as reading
from chronofold.sources import store as storage
from chronofold.sources.commits import Commits
from chronofold.sources.store import EventStore, open_store

EVENT = T.StructType([T.StructField(f.name, f.dataType) for f in schema.ENVELOPE.fields])
REQUEST = T.StructType([*schema.APPEND.fields[:-1], T.StructField("events", T.ArrayType(EVENT))])


def event(nonce, event_id, payload=b"x", kind="Test", **more):
    return {n: None for n in schema.ENVELOPE.names} | {"aggregate_nonce": nonce, "event_id": event_id, "event_type": kind, "payload": payload} | more


def request(spark, *requests):
    return spark.createDataFrame([(i, t, a, "Order", expected, key, events) for i, (t, a, expected, key, events) in enumerate(requests)], REQUEST)


def statuses(df):
    return [r["status"] for r in df.orderBy("request_id").collect()]


def test_append_read_conflict_replay(spark, root):
    store = EventStore(spark, root)
    assert store.events().count() == 0 and reading.head(store.events()) == 0
    first = [event(1, "e1", b"o1"), event(2, "e2", b"o2")]
    assert statuses(store.append(request(spark, ("t", "Order-9", 0, "k1", first), ("t", "Payment-1", 0, "", [event(1, "e3", b"p1")])))) == ["ok", "ok"]
    log = store.events()
    assert [(r["aggregate_id"], r["aggregate_nonce"], r["global_nonce"]) for r in log.orderBy("global_nonce").collect()] == [("Order-9", 1, 1), ("Order-9", 2, 2), ("Payment-1", 1, 3)]
    again = store.append(request(spark, ("t", "Order-9", 0, "k1", first))).first()
    assert (again["status"], again["last_nonce"]) == ("replayed", 2)
    got = statuses(
        store.append(
            request(
                spark,
                ("t", "Order-9", 0, "k1", [event(1, "e1", b"other")]),
                ("t", "Order-8", 1, "", [event(2, "e9")]),
                ("t", "Order-7", 0, "", [event(3, "e8")]),
                ("", "Order-6", 0, "", [event(1, "e7")]),
                ("t", "Order-5", 0, "", []),
                ("t", "Order-4", 0, "", [event(1, "e1")]),
                ("t", "Order-3", 0, "", [event(1, "e6", tenant_id="stranger")]),
                ("u", "Order-9", None, "", [event(1, "e1")]),
            )
        )
    )
    assert got == ["AlreadyExists", "Concurrency", "Invalid", "Unauthenticated", "Invalid", "DuplicateEvent", "PermissionDenied", "ok"]
    assert reading.head(store.events()) == 4
    with pytest.raises(schema.Immutable):
        store.update()


def test_two_requests_for_a_stream(spark, root):
    store = EventStore(spark, root)
    assert statuses(store.append(request(spark, ("t", "a", 0, "", [event(1, "e1")]), ("t", "a", 0, "", [event(1, "e2")])))) == ["ok", "Concurrency"]


def test_refused_requests_stand_in_nobodys_way(spark, root):
    store = EventStore(spark, root)
    got = store.append(
        request(
            spark,
            ("t", "a", 3, "", [event(1, "e1")]),  # wrong head
            ("t", "a", 0, "", [event(1, "e2")]),
            ("t", "b", 0, "", [event(1, "e1")]),  # the id of the refused first
            ("t", "c", 0, "", [event(1, "e2")]),  # the id of the accepted second
            ("t", "d", 0, "", [event(1, "e5"), event(2, "e5")]),  # an id twice
            ("t", "e", 0, "", [event(1, "e6", tenant_id="u")]),
            ("t", "b", 0, "", [event(1, "e7")]),
        )
    )
    assert statuses(got) == ["Concurrency", "ok", "ok", "DuplicateEvent", "DuplicateEvent", "PermissionDenied", "Concurrency"]
    assert sorted(r["event_id"] for r in store.events().collect()) == ["e1", "e2"]
    assert sorted((r["aggregate_id"], r["head"]) for r in store.heads().collect()) == [("a", 1), ("b", 1)]


def test_a_writer_that_dies_leaves_the_store_whole(spark, root, monkeypatch):
    store = EventStore(spark, root)
    store.append(request(spark, ("t", "a", 0, "k", [event(1, "e1")])))
    with monkeypatch.context() as m:  # dies between the commit's contents and its name
        m.setattr(Commits, "_give", lambda *_: (_ for _ in ()).throw(RuntimeError("dead")))
        with pytest.raises(RuntimeError):
            store.append(request(spark, ("t", "a", 1, "", [event(2, "e2")])))
    (pathlib.Path(root.removeprefix("file://")) / "commits" / f"{1:012d}.json").touch()  # an empty file is no commit
    assert store.events().count() == 1 and store.ledger().count() == 1
    assert statuses(EventStore(spark, root).append(request(spark, ("t", "a", 1, "", [event(2, "e2")])))) == ["ok"]
    assert sorted(r["global_nonce"] for r in store.events().collect()) == [1, 2]


def test_two_writers_and_an_index(spark, root, monkeypatch):
    monkeypatch.setattr(storage, "INDEX", 2)
    store = EventStore(spark, root)
    claim, raced = Commits.claim, []

    def race(self, name, text):
        if not raced and self.folder.endswith("commits"):
            raced.append(1)
            assert statuses(EventStore(spark, root).append(request(spark, ("t", "a", 0, "", [event(1, "other")])))) == ["ok"]
        return claim(self, name, text)

    monkeypatch.setattr(Commits, "claim", race)
    assert statuses(store.append(request(spark, ("t", "a", 0, "", [event(1, "mine")]), ("t", "b", 0, "", [event(1, "also")])))) == ["Concurrency", "ok"]
    for i in range(3):
        store.append(request(spark, ("t", f"s{i}", 0, "", [event(1, f"x{i}")])))
    assert [c["number"] for c in store.commits()] == [0, 1, 2, 3, 4] and store._index.names() == ["000000000002.json", "000000000004.json"]
    assert sorted(r["global_nonce"] for r in store.events().collect()) == [1, 2, 3, 4, 5]


def test_commits(spark, root):
    c = Commits(spark, f"{root}/c")
    assert c.names() == [] and c.get("a") is None and c.claim("a", "é\n") and not c.claim("a", "y")
    c.write("nameless")
    assert c.names() == ["a"] and c.get("a") == "é\n"
    with pytest.raises(ValueError):
        c.claim("b", "")


def test_json_keeps_types(spark):
    texts = ['{"n":1,"o":{"p":[1,2]},"z":true}', ' {} ', "[1]", "no json", None]
    log = spark.createDataFrame([(str(i), "T", 1, None if t is None else bytearray(t.encode())) for i, t in enumerate(texts)], "event_id string, event_type string, event_version int, payload binary")
    got = [json.loads(r["json"]) for r in envelope.to_json(log).orderBy("event_id").collect()]
    assert [g.get("data") for g in got] == [{"n": 1, "o": {"p": [1, 2]}, "z": True}, {}, None, None, None]
    assert got[0]["metadata"] == {"event_id": "0"} and got[0]["type"] == "T"


def test_pages(spark, root):
    store = EventStore(spark, root)
    store.append(request(spark, *(("t", f"a{i}", 0, "", [event(1, f"e{i}")]) for i in range(5))))
    log, at, seen, ends = store.events(), 0, [], []
    while True:
        page = reading.page_all(log, "t", at, 2)
        seen += [r["global_nonce"] for r in page.events]
        ends.append(page.is_end)
        at = page.next_from
        if page.is_end:
            break
    assert seen == [1, 2, 3, 4, 5] and ends == [False, False, True]
    assert [r["global_nonce"] for r in reading.page_all(log, "t", 4, 2, forward=False).events] == [4, 3]
    assert reading.page_all(log, "t", 4, 2, forward=False).next_from == 2
    assert reading.page_all(log, "nobody").is_end
    page = reading.page_stream(log, "t", "a1")
    assert page.is_end and len(page.events) == 1
    assert reading.exists(log, "t", "a1") and not reading.exists(log, "t", "a9")


class Open:
    pass


class Account(Aggregate):
    aggregate_type = "Account"
    balance = 0

    @handles(Open)
    def open(self, command):
        self.emit("Opened", amount=5)

    @applies("Opened")
    def opened(self, data):
        self.balance += data["amount"]


def test_repository_and_buses(spark, root):
    repo = Repository(EventStore(spark, root), "t", Account)
    assert repo.load("a") is None
    a, b = Account("a"), Account("a")
    a.handle(Open())
    b.handle(Open())
    repo.save_new(a)
    assert not a.uncommitted and repo.exists("a")
    with pytest.raises(schema.Concurrency) as e:
        repo.save_new(b)
    assert e.value.actual == 1
    c = repo.load("a")
    assert (c.balance, c.version) == (5, 1)
    c.handle(Open())
    repo.save(c)
    assert repo.load("a").balance == 10
    bus = CommandBus()
    bus.register(Open, lambda c: "done")
    assert bus.send(Open()) == "done"
    with pytest.raises(schema.AlreadyExists):
        bus.register(Open, print)
    queries = QueryBus(spark)
    queries.register("numbers")(lambda spark, n: spark.range(n))
    assert queries.send("numbers", n=3).count() == 3
    with pytest.raises(schema.NotFound):
        queries.send("none")
    with pytest.raises(schema.Invalid):
        open_store(spark, "files")
