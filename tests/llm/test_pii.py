"""op10: base spans against the plain rules, votes -> EM -> classifier against a plain version of each."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time

import numpy as np

from chronofold.llm import pii

SF = "/root/testdata/sf0.001"
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def slow_luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        t += x - 9 * (x > 9)
    return t % 10 == 0


def passes(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and slow_luhn(d)
    return kind != "phone" or 8 <= len(d) <= 15


def slow_base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def test_base_spans_equal_plain_rules(spark):
    rnd = random.Random(12)
    atoms = ["a", "b.c", "@", "@x.y", ".", "-", " ", "+", "(", ")", "1", "23", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1111", "0", "é", "👍", "_", "%", "+1 (555) 555-0199", "1.2.3.4", "001.2.3.4", "x@y.z", "\n"]
    texts = [None, "", "x@y.z_w@q.r", "a@b@c.d", "1.2.3.4.5.6.7.8", "300.1.1.1 2.2.2.2", "9" * 400, "a" * 5000 + "@b.c", "+" * 50 + "1" * 9, "@" * 100, "1.2.3x4.5.6.7", "👍 x@y.z"]
    texts += ["".join(rnd.choice(atoms) for _ in range(rnd.randint(1, 25))) for _ in range(1500)]
    texts.append(" 👍 ".join(f"u{i}@x.y 1.2.3.{i % 300}" for i in range(1500)))  # more matches than are summed at once
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, spans string")
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    for i, t in enumerate(texts):
        want = slow_base(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (t, want, got[i]["spans"])
        assert set(want) <= set(got[i]["spans"].split(",")) | {""} or not want
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x.startswith(k) for x in want) for k in pii.KINDS]


def vote(yes, no=True):
    return 1 if yes else 0 if no else -1


def slow_votes(kind, base, value, before, left, right):
    """The labelers as their docstrings have them, in plain Python."""
    digits, edge = re.sub("[^0-9]", "", value), re.search(r"[^\W]", left + right)
    if kind == "email":
        shape = vote(re.search("^[A-Za-z0-9]", value) and re.search("[A-Za-z]{2,}$", value), re.search(r"\.\.|-$", value))
        known = vote(re.search("([A-Za-z]+)$", value) and re.search("([A-Za-z]+)$", value)[1].lower() in pii.DOMAINS, False)
    elif kind == "ip":
        shape = vote(re.search(r"^(?:[1-9][0-9]{0,2}\.){3}[0-9]{1,3}$|:", value), re.search(r"(?:^|\.)0[0-9]", value))
        first = re.match("[0-9]{1,3}", value)
        known = vote(first and 1 <= int(first[0]) <= 223, first and int(first[0]) == 0)
    elif kind == "card":
        shape = vote(re.search(r"^[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}$", value), len(digits) < 16)
        known = vote(re.match("4|5[1-5]|2[2-7]|3[47]|6", digits), digits.startswith("0"))
    elif kind == "phone":
        shape = vote(re.search("[() .-]", value), re.fullmatch("[0-9.]+", value))
        known = vote(re.search(r"^\+?(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])|^\(?[2-9]", value), False)
    else:
        mixed = re.search("[a-z]", value) and re.search("[A-Z]", value) and re.search("[0-9].*[0-9]", value)
        shape = vote(re.fullmatch("[0-9a-f]+|[0-9A-F]+", value) or mixed, re.search("[A-Za-z]{8}|[_/-].*[_/-].*[_/-]", value))
        known = vote(re.search(pii.TOKENS, value), False)
    if kind == "secret":
        around = vote(left == right and left in "\"'`" and left, edge)
    else:
        around = vote(not edge)
    rule = (1 if passes(kind, value) else 0) if base else -1
    return rule, shape, known, vote(re.search(pii.FOR[kind], before), re.search(pii.AGAINST, before)), around


def slow_candidates(text):
    out = []
    for base, kinds, forms in ((True, pii.KINDS, BASE), (False, pii.ALL_KINDS, pii.WIDE)):
        for kind in kinds:
            last = 0
            for m in re.finditer(forms[kind], text):
                if base and kind == "card" and not 16 <= len(re.sub("[^0-9]", "", m[0])) <= 19:
                    continue
                votes = slow_votes(kind, base, m[0], text[last : m.start()][-40:], text[: m.start()][-1:], text[m.end() :][:1])
                out.append((kind, m.start(), m.end(), base and votes[0] == 1, votes))
                last = m.end()
    return out


def slow_weights(all_candidates):
    """EM with one posterior a candidate, then logistic regression on counted votes by Newton's method with numpy."""
    weights = {}
    for kind in pii.ALL_KINDS:
        votes = [c[4] for c in all_candidates if c[0] == kind]
        prior = {1: (0.6, 0.1), 0: (0.1, 0.6), -1: (0.3, 0.3)}
        p = [{x: prior[x] for x in (-1, 0, 1)} for _ in range(5)]
        p[0], share = {1: (0.96, 0.01), 0: (0.02, 0.97), -1: (0.02, 0.02)}, 0.5
        for _ in range(pii.ROUNDS):
            y = []
            for v in votes:
                yes = share * math.prod(p[j][x][0] for j, x in enumerate(v))
                no = (1 - share) * math.prod(p[j][x][1] for j, x in enumerate(v))
                y.append(1.0 if v[0] == 1 else yes / (yes + no))
            share = min(0.999, max(0.001, (sum(y) + 1) / (len(y) + 2)))
            for j in range(1, 5):
                for x in (-1, 0, 1):
                    t = sum(a for a, v in zip(y, votes, strict=True) if v[j] == x)
                    f = sum(1 - a for a, v in zip(y, votes, strict=True) if v[j] == x)
                    p[j][x] = ((t + 5 * prior[x][0]) / (sum(y) + 5), (f + 5 * prior[x][1]) / (len(y) - sum(y) + 5))
        kinds = sorted(set(votes))
        label = []
        for v in kinds:
            odds = math.log(share / (1 - share)) + sum(math.log(max(p[j][x][0], 1e-9) / max(p[j][x][1], 1e-9)) for j, x in enumerate(v))
            label.append(1.0 if v[0] == 1 else 1 / (1 + math.exp(-odds)))
        f = np.array([[1.0, *(float(x == z) for x in v for z in (0, 1))] for v in kinds]).reshape(-1, 11)
        n, y, w = np.array([math.log1p(votes.count(v)) for v in kinds]), np.array(label), np.zeros(11)
        for _ in range(pii.STEPS):
            q = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
            w = w + np.linalg.solve(f.T @ (f * (n * q * (1 - q))[:, None]) + pii.RIDGE * np.eye(11), f.T @ (n * (y - q)) - pii.RIDGE * w)
        weights[kind] = w
    return weights


def slow_find(texts):
    """Spans and turned down candidates of each text."""
    found = [slow_candidates(t or "") for t in texts]
    weights, out = slow_weights([c for f in found for c in f]), []
    for f in found:
        spans, no = [], []
        for kind, a, b, base, votes in sorted(f, key=lambda c: (pii.ALL_KINDS.index(c[0]), c[1], c[2])):
            w = weights[kind]
            score = 1 / (1 + math.exp(-(w[0] + sum(w[1 + 2 * j + x] for j, x in enumerate(votes) if x >= 0))))
            touches = any(o[3] and o[1] < b and a < o[2] for o in f)
            (spans if base or (score >= pii.THRESHOLD and not touches) else no).append((f"{kind}:{a}:{b}", score))
        out.append(([s for s, _ in spans], no))
    return out


def redacted(text, spans):
    out, at = [], 0
    for a, b, k in sorted((int(a), -int(b), k) for k, a, b in (x.split(":") for x in spans)):
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


def mixed_texts():
    rnd = random.Random(3)
    forms = [
        lambda: f"phone 555-010-{rnd.randint(1000, 9999)}", lambda: f"order 555-010-{rnd.randint(1000, 9999)}x9", lambda: f"card {rnd.randint(10**12, 10**14)}", lambda: f"invoice {rnd.randint(10**12, 10**14)}",
        lambda: "mail joe (at) example (dot) org", lambda: "x (at) y (dot) z", lambda: f'token = "{rnd.randbytes(20).hex()}"', lambda: f"commit {rnd.randbytes(20).hex()} build", lambda: "src/some/long/path/to4/file.ts",
        lambda: "server fe80:0:0:0:1:2:3:4 up", lambda: f"{rnd.randint(10**15, 10**16)}", lambda: f"1.2.{rnd.randint(0, 400)}.4", lambda: "+1 (555) 555-0199", lambda: "a@b.com", lambda: "👍", lambda: "words only",
    ]
    return [rnd.choice([", ", " and ", "\n"]).join(rnd.choice(forms)() for _ in range(rnd.randint(0, 9))) for _ in range(400)]


def test_spans_equal_plain_em_and_classifier(spark):
    texts = [None, "", *mixed_texts()]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    want, added, down = slow_find(texts), 0, 0
    for i, (spans, no) in enumerate(want):
        assert got[i]["spans"] == ",".join(spans), texts[i]
        mine = [x.rsplit(":", 1) for x in got[i]["rejected"].split(",") if x]
        assert [x[0] for x in mine] == [s for s, _ in no] and all(abs(float(x[1]) - s) < 0.002 for x, (_, s) in zip(mine, no, strict=True))
        assert got[i]["n_added"] == len(spans) - len(slow_base(texts[i]))
        added, down = added + got[i]["n_added"], down + len(no)
    assert added > 100 and down > 100
    out = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert all(out[i] == (None if t is None else redacted(t, want[i][0])) for i, t in enumerate(texts))


def test_the_classifier_decides_on_the_tables(spark):
    got = pii.find(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert sum(r["n_added"] for r in got) > 0 and sum(r["rejected"] != "" for r in got) > 0


def test_added_spans_and_redaction(spark):
    rows_ = [(i, f"call me, phone 555-010-{1000 + i} or +1 (555) 010-{1000 + i} today", "s", 1) for i in range(200)]
    rows_ += [(1000 + i, f"order 555-010-{1000 + i}x9", "s", 1) for i in range(50)] + [(2000, "nothing here", "s", 7), (2001, None, "s", 9), (2002, "x@y.z, then 1.2.3.4", "s", 1)]
    df = spark.createDataFrame(rows_, "doc_id bigint, text string, source string, n_chars bigint")
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    assert got[0]["n_phone"] == 1 and got[0]["n_added"] == 1 and got[2000]["spans"] == ""
    out = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert out[0]["text"] == "call me, phone <PHONE> or <PHONE> today" and out[0]["n_chars"] == len(out[0]["text"])
    assert out[2002]["text"] == "<EMAIL>, then <IP>" and out[2000][:] == (2000, "nothing here", "s", 7) and out[2001][:] == (2001, None, "s", 9)
    assert pii.find(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).columns == df.columns
    clashing = df.selectExpr("*", "1 as `row`", "2 as `candidates`", "3 as found", "4 as spans", "5 as `a.b`", "6 as kind", "7 as blocks", "8 as `new`")
    again = pii.redact(clashing)
    assert again.columns == clashing.columns and [r["a.b"] for r in again.collect()] == [5] * again.count()
    assert {r["doc_id"]: r["text"] for r in again.collect()} == {k: r["text"] for k, r in out.items()}
    assert pii.find(clashing).count() == df.count()


def test_very_many_matches_take_linear_time(spark):
    text = " ".join(f"u{i}@x{i % 7}.com" for i in range(100_000))
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id bigint, text string")
    pii.find(df.limit(0)).collect()
    began = time.monotonic()
    assert [r["n_email"] for r in pii.find(df).collect()] == [100_000] * 2
    assert time.monotonic() - began < 60
    assert {r["text"] for r in pii.redact(df).collect()} == {" ".join(["<EMAIL>"] * 100_000)}


def test_em_finds_a_bad_labeler():
    """Of three labelers one votes at random; EM trusts it least."""
    rnd = random.Random(13)
    seen = {}
    for _ in range(3000):
        y = rnd.random() < 0.5
        votes = (-1, *(int(y if rnd.random() < p else not y) for p in (0.95, 0.9, 0.5, 0.85)))
        seen[votes] = seen.get(votes, 0) + 1
    patterns = [("phone", v, n) for v, n in sorted(seen.items())]
    reliable = pii.estimate(patterns)["phone"][1]
    gap = [reliable[j, 1][0] - reliable[j, 1][1] for j in range(1, 5)]
    assert gap[2] < 0.2 < 0.5 < min(gap[0], gap[1], gap[3])
    w = pii.classifier(patterns)["phone"]
    assert abs(w[6] - w[5]) < abs(w[4] - w[3])
