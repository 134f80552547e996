"""Personal data by weak supervision, in DataFrame functions only.

Candidates come from patterns: for each kind the base rule's pattern, and a wider one for forms that
the rule does not know; a kind without a base rule, secrets, has the wider one only. Labelers vote
on each candidate: 1, 0, or nothing (-1).

    rule       the base rule's checks: octets, Luhn, number of digits
    shape      what the match looks like by itself
    gazetteer  lists: top-level domains, first octets, issuers' prefixes, country codes, tokens' prefixes
    before     a word just before that speaks for or against
    around     what borders on the match

Their votes are counted (one row for each kind and combination of votes, whatever the size of the
corpus), expectation-maximisation estimates how reliable each labeler is, and a logistic model of
the votes is trained on the resulting labels. It is the final span classifier, an expression over
votes. Base spans always stay; a span that the classifier adds must not touch one. Candidates that
it turns down are reported with their scores.

Work is linear in a text's length, however long and however many matches: patterns never go over a
run of characters twice (runs are entered at their start only and taken whole, which changes no
match of the base rules); a candidate's surroundings are cut from the gaps beside it; places are
running sums taken in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm import common

#: Kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
#: Kinds that have a base rule and kinds that only the classifier finds, in the order in which spans are listed.
ALL_KINDS = (*KINDS, "secret")

#: Base patterns, with runs entered at their start and taken whole.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain to have a match of the pattern.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

_KEY = "A-Za-z0-9_/+-"
#: Wider forms: "name (at) host (dot) org", IPv6 in full, numbers of 13 to 15 digits, phone numbers without a country code; runs
#: of 20 or more letters and digits for secrets.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|[(\[](?:dot|DOT)[)\]])\x20?[A-Za-z0-9-]{1,63}+)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9+])(?<![0-9][\x20.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![\x20.-]?[0-9])",
    "secret": rf"(?<![{_KEY}=])(?=[A-Za-z_/+-]{{0,64}}[0-9])(?=[0-9_/+-]{{0,64}}[A-Za-z])[{_KEY}]{{20,}}+={{0,2}}+(?![{_KEY}=])",
}
WIDE_NEEDS = {"email": r"(?i)[(\[]at[)\]]", "ip": "[0-9A-Fa-f]:[0-9A-Fa-f]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"[0-9][\x20.-][0-9]{4}", "secret": f"[{_KEY}]{{20}}"}

LABELERS = ("rule", "shape", "gazetteer", "before", "around")
#: Fixed values of the gazetteers.
DOMAINS = "com org net edu gov info biz io eu uk de fr es it nl ch at be se pl ca us au jp cn in br".split()
FOR = {
    "email": r"(?i)(?:e-?mail|mail|contact|contacto|kontakt|courriel|correo|write to|reply)",
    "ip": r"(?i)(?:\bip\b|address|host|server|client|login|from)",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|telefon|t[ée]l[ée]phone|tel[ée]fono|whatsapp)",
    "secret": r"(?i)(?:token|secret|passw|pwd|api.?key|access.?key|private.?key|credential|bearer|authorization)",
}
#: Beginnings of public kinds of tokens, and lengths of hexadecimal digests that are used as such.
TOKENS = r"^(?:ghp_|gho_|glpat-|sk_live_|sk_test_|xox[abprs]-|AKIA|ASIA|AIza|eyJ)|^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$"
AGAINST = r"(?i)(?:version|release|isbn|issn|order|invoice|article|section|serial|build|token|hash|page)"
#: Code points before a candidate that are looked at, up to the match before it of its pattern.
CONTEXT = 40
#: Rounds of expectation-maximisation; of the classifier's Newton steps; pull of its weights to zero.
ROUNDS, STEPS, RIDGE = 60, 12, 0.1
THRESHOLD = 0.9

#: Entries that are summed at once; code points that are cut from at once.
RUN, BLOCK = 256, 1024

_CANDIDATE = "array<struct<kind:string,start:bigint,end:bigint,base:boolean,votes:array<int>>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def _scan(values: Column, op: Callable[[Column, Column], Column], start: Column) -> Column:
    """For each entry `op` over all before it, from `start`; op is associative.

    In blocks: an array grows by copies, so one that grew to the whole length would take its square.
    """

    def running(array: Column, first: Column) -> Column:
        return F.aggregate(array, F.array(first), lambda out, x: F.concat(out, F.array(op(F.element_at(out, -1), x))))

    def joined(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, start, lambda x, y: op(x, y)))
        each = F.zip_with(blocks, F.slice(running(sums, start), F.lit(1), F.size(blocks)), lambda b, first: F.slice(running(b, first), F.lit(1), F.size(b)))
        return F.flatten(each)

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")), lambda i: F.slice(v, i * RUN + 1, F.lit(RUN)))
        return F.when(F.size(v) > 0, _let(blocks, joined)).otherwise(F.array().cast("array<bigint>"))

    return _let(values, whole)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _octet_ok(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+", "")
    return (F.length(plain) <= 3) & (F.coalesce(plain.try_cast("int"), F.lit(0)) <= 255)


def rule(kind: str, value: Column) -> Column:
    """The base rule's check of a match of the base pattern."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _octet_ok)
    if kind == "card":
        return luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, 1).when(F.lit(True) if no is None else no, 0).otherwise(-1)


def _shape(kind: str, value: Column) -> Column:
    if kind == "email":
        return _vote(value.rlike(r"^[A-Za-z0-9]") & value.rlike(r"[A-Za-z]{2,}$"), value.rlike(r"\.\.|-$"))
    if kind == "ip":
        return _vote(value.rlike(r"^(?:[1-9][0-9]{0,2}\.){3}[0-9]{1,3}$|:"), value.rlike(r"(?:^|\.)0[0-9]"))
    if kind == "card":
        return _vote(value.rlike(r"^[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}$"), F.length(_digits(value)) < 16)
    if kind == "secret":
        mixed = value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9].*[0-9]")
        return _vote(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") | mixed, value.rlike("[A-Za-z]{8}|[_/-].*[_/-].*[_/-]"))
    return _vote(value.rlike(r"[()\x20.-]"), value.rlike(r"^[0-9.]+$"))


def _gazetteer(kind: str, value: Column) -> Column:
    if kind == "email":
        return _vote(F.lower(F.regexp_extract(value, "([A-Za-z]+)$", 1)).isin(DOMAINS), F.lit(False))
    if kind == "ip":
        first = F.regexp_extract(value, "^([0-9]{1,3})", 1).try_cast("int")
        return _vote(first.between(1, 223), first.between(0, 0))
    if kind == "card":
        return _vote(_digits(value).rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), _digits(value).rlike("^0"))
    if kind == "secret":
        return _vote(value.rlike(TOKENS), F.lit(False))
    return _vote(value.rlike(r"^\+?(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])|^\(?[2-9]"), F.lit(False))


def _around(kind: str, edges: Column) -> Column:
    """edges: the code points on either side, a bar between."""
    if kind == "secret":
        return _vote(edges.rlike("^([\"'`]).\\1$"), edges.rlike(r"[\p{L}\p{N}_]"))
    return _vote(~edges.rlike(r"[\p{L}\p{N}_]"), F.lit(True))


def _labelled(kind: str, gaps: Column, values: Column, base: bool) -> Column:
    """Candidates of one pattern, with places in code points, end exclusive. gaps: what is before, between and after the values."""
    n = F.size(values)
    others = F.slice(values, F.lit(1), F.greatest(n - 1, F.lit(0)))
    lengths = F.zip_with(F.slice(gaps, F.lit(1), n), values, lambda g, v: (F.char_length(g) + F.char_length(v)).cast("bigint"))
    parts = F.arrays_zip(
        F.slice(gaps, F.lit(1), n).alias("gap"), values.alias("value"), F.slice(gaps, F.lit(2), n).alias("after"),
        F.concat(F.array(F.lit("")), others).alias("last"), F.concat(F.slice(values, F.lit(2), F.greatest(n - 1, F.lit(0))), F.array(F.lit(""))).alias("next"),
        _scan(lengths, lambda a, b: a + b, F.lit(0).cast("bigint")).alias("at"),
    )

    def one(m: Column) -> Column:
        value, before = m["value"], F.substring(m["gap"], -CONTEXT, CONTEXT)
        passes = rule(kind, value) if base else F.lit(False)
        left = F.substring(F.when(m["gap"] == "", m["last"]).otherwise(before), -1, 1)
        right = F.substring(F.when(m["after"] == "", m["next"]).otherwise(m["after"]), 1, 1)
        votes = F.array(
            F.when(passes, 1).otherwise(0) if base else F.lit(-1),
            _shape(kind, value),
            _gazetteer(kind, value),
            _vote(before.rlike(FOR[kind]), before.rlike(AGAINST)),
            _around(kind, F.concat(left, F.lit("|"), right)),
        )
        start = m["at"] + F.char_length(m["gap"])
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.char_length(value)).alias("end"), passes.alias("base"), votes.alias("votes"))

    return F.when(n > 0, F.transform(parts, one)).otherwise(F.array()).cast(_CANDIDATE)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, candidates): each row as a struct, whatever its columns are called, and all candidates of all kinds, with votes.

    Null texts are empty.
    """
    t = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    forms = [(k, True, BASE[k], NEEDS[k]) for k in KINDS] + [(k, False, WIDE[k], WIDE_NEEDS[k]) for k in ALL_KINDS]
    found = {}
    for i, (_, _, pattern, needs) in enumerate(forms):
        there = t.rlike(needs)
        found[f"gaps{i}"] = F.when(there, F.split(t, pattern, -1)).otherwise(F.array(t))
        found[f"values{i}"] = F.when(there, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    got = rows.withColumns(found)  # a projection of its own: each list is used more than once
    lists = [_labelled(k, F.col(f"gaps{i}"), F.col(f"values{i}"), base) for i, (k, base, _, _) in enumerate(forms)]
    return got.select("row", F.concat(*lists).alias("candidates"))


def estimate(patterns: list[tuple[str, tuple[int, ...], int]]) -> dict[str, tuple[float, dict[tuple[int, int], tuple[float, float]]]]:
    """EM over counted vote patterns: by kind the share of true candidates, and P(vote | true), P(vote | false) by (labeler, vote).

    Two classes, labelers independent given the class, with a weak prior that labelers beat chance.
    A candidate that the base rule accepts is true.
    """
    out = {}
    for kind in ALL_KINDS:
        rows = [(v, n) for k, v, n in patterns if k == kind]
        share = 0.5
        reliable = {(j, x): ((0.6, 0.1) if x == 1 else (0.1, 0.6) if x == 0 else (0.3, 0.3)) for j in range(len(LABELERS)) for x in (-1, 0, 1)}
        for x, p in ((1, (0.96, 0.01)), (0, (0.02, 0.97)), (-1, (0.02, 0.02))):
            reliable[0, x] = p
        for _ in range(ROUNDS):
            weight = []
            for v, n in rows:
                yes, no = share, 1 - share
                for j, x in enumerate(v):
                    yes, no = yes * reliable[j, x][0], no * reliable[j, x][1]
                weight.append((v, n, 1.0 if v[0] == 1 else yes / max(yes + no, 1e-300)))
            true, total = sum(n * w for _, n, w in weight), sum(n for _, n, _ in weight)
            share = min(0.999, max(0.001, (true + 1) / (total + 2)))
            for j in range(1, len(LABELERS)):
                for x in (-1, 0, 1):
                    prior = (0.6, 0.1) if x == 1 else (0.1, 0.6) if x == 0 else (0.3, 0.3)
                    t = sum(n * w for v, n, w in weight if v[j] == x) + 5 * prior[0]
                    f = sum(n * (1 - w) for v, n, w in weight if v[j] == x) + 5 * prior[1]
                    reliable[j, x] = (t / (true + 5), f / (total - true + 5))
        out[kind] = share, reliable
    return out


def posterior(kind: str, votes: tuple[int, ...], found: dict) -> float:
    share, reliable = found[kind]
    if votes[0] == 1:
        return 1.0
    odds = math.log(share / (1 - share)) + sum(math.log(max(reliable[j, x][0], 1e-9) / max(reliable[j, x][1], 1e-9)) for j, x in enumerate(votes))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def _features(votes: tuple[int, ...]) -> list[float]:
    return [1.0, *(float(x == y) for x in votes for y in (0, 1))]


def classifier(patterns: list[tuple[str, tuple[int, ...], int]]) -> dict[str, list[float]]:
    """Logistic weights by kind (bias, then vote 0 and vote 1 of each labeler), fitted to EM's labels by Newton steps."""
    found, out = estimate(patterns), {}
    for kind in ALL_KINDS:
        rows = [(_features(v), math.log1p(n), posterior(kind, v, found)) for k, v, n in patterns if k == kind]
        size = 1 + 2 * len(LABELERS)
        w = [0.0] * size
        for _ in range(STEPS):
            gradient = [-RIDGE * x for x in w]
            hessian = [[RIDGE * (i == j) for j in range(size)] for i in range(size)]
            for f, n, y in rows:
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, f, strict=True))))))
                for i in range(size):
                    gradient[i] += n * (y - p) * f[i]
                    for j in range(size):
                        hessian[i][j] += n * p * (1 - p) * f[i] * f[j]
            w = [a + b for a, b in zip(w, _solve(hessian, gradient), strict=True)]
        out[kind] = w
    return out


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """Gaussian elimination of a small positive definite system."""
    rows = [[*r, x] for r, x in zip(a, b, strict=True)]
    for i in range(len(rows)):
        rows[i:] = sorted(rows[i:], key=lambda r, i=i: -abs(r[i]))
        for r in rows[i + 1 :]:
            ratio = r[i] / rows[i][i]
            for j in range(i, len(r)):
                r[j] -= ratio * rows[i][j]
    x = [0.0] * len(rows)
    for i in reversed(range(len(rows))):
        x[i] = (rows[i][-1] - sum(rows[i][j] * x[j] for j in range(i + 1, len(rows)))) / rows[i][i]
    return x


def train(with_candidates: DataFrame) -> dict[str, list[float]]:
    """Classifier of a written table of candidates. Only counts by kind and votes reach the driver: a few hundred rows."""
    each = with_candidates.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes").agg(F.count("*").alias("n"))
    return classifier(sorted((r["kind"], tuple(r["votes"]), r["n"]) for r in each.collect()))


def judged(with_candidates: DataFrame, weights: dict[str, list[float]]) -> DataFrame:
    """(row, found): candidates by kind and start, each with its score (the classifier's probability) and whether it is a span.

    Base candidates are spans. Of the others those are that score THRESHOLD or more and touch no base
    one. In order of starts, one touches an earlier base span if the farthest end of these is beyond
    its start, a later one if the next of these starts before its end.
    """

    def score(c: Column) -> Column:
        by_kind = F.lit(None).cast("double")
        for kind, w in weights.items():
            terms = [F.when(c["votes"][j] == x, w[1 + 2 * j + x]).otherwise(0.0) for j in range(len(LABELERS)) for x in (0, 1)]
            by_kind = F.when(c["kind"] == kind, reduce(lambda a, b: a + b, terms, F.lit(w[0]))).otherwise(by_kind)
        return 1 / (1 + F.exp(-by_kind))

    order = F.create_map(*(x for i, k in enumerate(ALL_KINDS) for x in (F.lit(k), F.lit(i))))
    keyed = F.transform("candidates", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), order[c["kind"]].alias("o"), c["kind"].alias("kind"), c["base"].alias("base"), score(c).alias("score")))
    got = with_candidates.select("row", F.sort_array(keyed).alias("c"))
    none, beyond = F.lit(-1).cast("bigint"), F.lit((1 << 62)).cast("bigint")
    ended = _scan(F.transform("c", lambda c: F.when(c["base"], c["end"]).otherwise(none)), F.greatest, none)
    starts = F.reverse(_scan(F.reverse(F.transform("c", lambda c: F.when(c["base"], c["start"]).otherwise(beyond))), F.least, beyond))

    def one(x: Column) -> Column:
        c = x["c"]
        own = c["base"] | ((c["score"] >= THRESHOLD) & (x["ended"] <= c["start"]) & (x["starts"] >= c["end"]))
        return F.struct(c["o"].alias("o"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["base"].alias("base"), own.alias("span"), c["score"].alias("score"))

    found = F.transform(F.arrays_zip(F.col("c"), ended.alias("ended"), starts.alias("starts")), one)
    return got.select("row", F.sort_array(F.when(F.size("c") > 0, found).otherwise(F.array().cast("array<struct<o:int,start:bigint,end:bigint,kind:string,base:boolean,span:boolean,score:double>>"))).alias("found"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added, rejected.

    n_added counts the spans that the classifier adds; rejected lists the candidates that it turns
    down, as kind:start:end:score with three decimals. Null and empty texts have no spans. Repeated rows
    are documents of their own; ties of start go by end. Other columns are ignored, whatever their
    names. An empty table gives an empty result.
    """
    thin = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    got = common.written(candidates(thin).select(F.struct("row.doc_id").alias("row"), "candidates"), "candidates")
    of = judged(got, train(got)).select(F.col("row.doc_id").alias("doc_id"), "found")
    base, spans, rejected = F.filter("found", lambda s: s["base"]), F.filter("found", lambda s: s["span"]), F.filter("found", lambda s: ~s["span"])
    counted = [F.size(_of_kind(base, k)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    added = F.size(F.filter("found", lambda s: s["span"] & ~s["base"])).cast("bigint").alias("n_added")
    turned_down = F.array_join(F.transform(rejected, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"), F.round(s["score"], 3).cast("decimal(4,3)").cast("string"))), ",")
    return of.select("doc_id", *counted, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"), added, turned_down.alias("rejected"))


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """Code points from start to end of a text in blocks of BLOCK; no more than the blocks at both ends are walked."""
    a, b = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    left, right = (start - a * BLOCK).cast("int"), (end - b * BLOCK).cast("int")

    def block(i: Column) -> Column:
        return F.coalesce(F.get(blocks, i), F.lit(""))

    whole = F.array_join(F.slice(blocks, a + 2, F.greatest(b - a - 1, F.lit(0))), "")
    return F.when(a == b, F.substring(block(a), left + 1, right - left)).otherwise(F.concat(F.substring(block(a), left + 1, F.lit(BLOCK)), whole, F.substring(block(b), F.lit(1), right)))


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents with each span replaced by its kind, as <EMAIL>, in their columns; n_chars, if there, follows.

    Of spans that overlap (of several kinds) the stretch that they cover is replaced once, by the
    kind that starts first (of one start the longest). A null text stays null. Columns may have any
    names; repeated rows stay repeated.
    """
    got = common.written(candidates(docs, text), "candidates")
    t = F.col(f"row.`{text}`")
    spans = F.sort_array(F.transform(F.filter("found", lambda s: s["span"]), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    some = judged(got, train(got)).select("row", spans.alias("spans"))
    some = some.select("row", "spans", F.regexp_extract_all(F.when(F.size("spans") > 0, t), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks"))
    at = _scan(F.transform("spans", lambda s: -s["back"]), F.greatest, F.lit(0).cast("bigint"))
    parts = F.arrays_zip(F.col("spans").alias("s"), at.alias("at"))
    fresh = F.filter(parts, lambda x: x["s"]["start"] >= x["at"])
    end = F.array_max(F.transform("spans", lambda s: -s["back"]))
    some = some.withColumns({"fresh": fresh, "end": end})
    pieces = F.transform("fresh", lambda x: F.concat(_cut(F.col("blocks"), x["at"], x["s"]["start"]), F.lit("<"), F.upper(x["s"]["kind"]), F.lit(">")))
    new = F.when(F.size("spans") > 0, F.concat(F.array_join(pieces, ""), _cut(F.col("blocks"), F.col("end"), F.char_length(t).cast("bigint")))).otherwise(t)
    some = some.select("row", "spans", new.alias("new"))
    fields = {text: F.col("new")}
    if n_chars in docs.columns:
        fields[n_chars] = F.when(F.size("spans") > 0, F.length("new").cast(docs.schema[n_chars].dataType)).otherwise(F.col(f"row.`{n_chars}`"))
    return some.select(*(fields.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
