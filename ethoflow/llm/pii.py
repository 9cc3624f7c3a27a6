"""Personal data: fixed patterns, and spans that weakly supervised labelers add. DataFrame functions only.

Base kinds (email, ip, card, phone) are found by pattern and check. For what the patterns miss, candidate
spans (number groups, spelled-out addresses, assignments, names) get votes of five labelers: shape,
digits, gazetteer, context for, context against. Expectation-maximisation over the counts of vote patterns
(counted over all documents) estimates how reliable each labeler is; its posteriors train a logistic span
classifier over the votes and over features that the labelers don't see: length, share of digits, and what
stands before and after the span. Candidates of probability 0.5 or more that overlap no base span are added.
Only the table of votes and features comes to the driver; its values are bucketed, so it has at most
``TABLE_ROWS`` rows at any input size.

All work on a text is linear in its length, or nearly: arrays are bound once (``let``), and running sums go
by chunks (``scan``).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

BASE = ("email", "ip", "card", "phone")
ADDED = ("mail", "name", "number", "secret")
# Possessive forms of the contract's patterns: what follows a repeat is never in its class, so matches are
# the same. \G or a look-behind lets a run be tried once, not from each of its places.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Sr|Sra|Mme"
_GIVEN = "Anna|Maria|John|James|Robert|Michael|David|William|Thomas|Peter|Paul|Mary|Elizabeth|Susan|Sarah|Laura|Julia|Emma|Sofia|Hans|Klaus|Karl|Stefan|Jean|Pierre|Marie|Claire|Carlos|Juan|Pedro|Luis|Carmen"
_WORD = r"\p{Lu}[\p{L}'-]++"
# Runs of any length; a look-behind lets each be tried once. Number groups have 6 to 19 digits.
_CANDIDATES = (
    r"(?:\G|(?<![A-Za-z0-9._-]))[A-Za-z0-9._-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z]{2,}+)++"
    r"|(?:\G|(?<![A-Za-z_]))[A-Za-z_]{2,}+\"? ?[=:] ?\"[^\"\n]{4,}+\""
    rf"|\b(?:{_TITLES})\.? {_WORD}(?: {_WORD})?"
    rf"|\b(?:{_GIVEN}) {_WORD}"
    r"|(?<![0-9A-Za-z+.-])\(?[0-9](?:[().\x20-]{0,2}[0-9]){5,18}(?![0-9A-Za-z])"
)
_SPELLED = r"[\[(](at|AT)[\])]"
_ASSIGNED = r"^[A-Za-z_]+\"? ?[=:] ?\""
_CUES = r"(?i)\b(phone|tel|telefon|call|mobile|fax|contact|ssn|social|passport|account|iban|id|mail|email|born)\b"
_KEYS = r"(?i)^[A-Za-z_]*(token|secret|passw|pwd|api|key|auth|credential|user|login)"
_AGAINST = r"(?i)([%$€£]|\b(page|vol|version|isbn|year|fig|chapter|kg|km|section|line|no)\b)"
_PERSONAL_SHAPES = (
    r"^[(]?[0-9]{3}[)]?[ .-][0-9]{3}[ .-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$|" + _SPELLED + r"|\"[A-Za-z0-9+/_=-]{8,}\"$|^\p{Lu}\p{L}+[.]? \p{Lu}\p{L}+ \p{Lu}"
)
_DATE = r"^[(]?([12][0-9]{3}[ .-][0-9]{2}[ .-][0-9]{2}|[0-9]{2}[ .-][0-9]{2}[ .-][12][0-9]{3})$"
_OTHER_SHAPES = r"^[12][0-9]{3}-[0-9]{2}-[0-9]{2}|^[0-9]{1,3}([.][0-9]{3})+$|^[0-9 ]+$"
#: Characters of context that labelers see before and after a span.
BEFORE, AFTER = 24, 16
LABELERS = ("shape", "digits", "gazetteer", "cue", "against")
FEATURES = ("kind", *LABELERS, "long", "share", "before", "after")
TABLE_ROWS = 4 * (3 * 3 * 3 * 2 * 2) * 4 * 3 * 4 * 4
_CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often, or in whatever lambda, body uses it."""
    return F.transform(F.array(value), body)[0]


def scan(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative op over an array of ints, by chunks: no array is copied for each element."""
    none = F.array().cast("array<int>")
    last = lambda a: F.get(a, F.size(a) - 1)
    plain = lambda v: F.aggregate(v, none, lambda a, x: F.concat(a, F.array(F.when(F.size(a) == 0, x).otherwise(op(last(a), x)))))

    def whole(v):
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _CHUNK).cast("int")), lambda c: plain(F.slice(v, c * _CHUNK + 1, F.lit(_CHUNK))))
        carried = lambda cs, ends: F.flatten(F.transform(cs, lambda c, i: F.transform(c, lambda x: F.when(i == 0, x).otherwise(op(F.get(ends, i - 1), x)))))
        return let(chunks, lambda cs: let(plain(F.transform(cs, last)), lambda ends: carried(cs, ends)))

    return let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(none))


_FOUND = "array<struct<start:int,stop:int,hit:string,left:string,right:string>>"


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, stop, hit, BEFORE characters before, AFTER after), code points."""

    def placed(hits, gaps):
        ends = scan(F.transform(hits, lambda h, i: F.length(h) + F.length(gaps[i])), lambda a, b: a + b)
        one = lambda h, i, stop: F.struct((stop[i] - F.length(h)).alias("start"), stop[i].alias("stop"), h.alias("hit"), F.right(gaps[i], F.lit(BEFORE)).alias("left"), F.left(gaps[i + 1], F.lit(AFTER)).alias("right"))
        return let(ends, lambda stop: F.transform(hits, lambda h, i: one(h, i, stop)))

    none = F.array().cast(_FOUND)
    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(every, lambda hits: F.when(F.size(hits) > 0, let(F.split(text, pattern, -1), lambda gaps: placed(hits, gaps))).otherwise(none))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    at = lambda i: F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
    term = lambda i: F.when(i % 2 == 0, at(i)).when(at(i) > 4, 2 * at(i) - 9).otherwise(2 * at(i))
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + term(i)) % 10 == 0


_CHECKS = {
    "email": lambda hit: F.lit(True),
    "ip": lambda hit: F.forall(F.split(hit, "[.]"), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False))),
    # the digits of a match that is too long aren't summed
    "card": lambda hit: let(_digits(hit), lambda d: F.length(d).between(16, 19) & _luhn(F.left(d, F.lit(19)))),
    "phone": lambda hit: F.length(_digits(hit)).between(8, 15),
}


def _touched(start: Column, stop: Column, spans: Column) -> Column:
    """Whether [start, stop) overlaps one of spans, which are sorted and disjoint: a binary search."""
    steps = F.sequence(F.lit(1), F.length(F.bin(F.size(spans).cast("long"))))
    middle = lambda b: F.shiftright(b["low"] + b["high"], 1)
    pair = lambda low, high: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))
    halve = lambda b, _: F.when(b["low"] >= b["high"], b).when(spans[middle(b)]["stop"] <= start, pair(middle(b) + 1, b["high"])).otherwise(pair(b["low"], middle(b)))
    first = F.aggregate(steps, pair(F.lit(0), F.size(spans)), halve, lambda b: b["low"])  # the first span that ends after start
    return (F.size(spans) > 0) & F.coalesce(let(first, lambda i: F.get(spans, i)["start"]) < stop, F.lit(False))


def _side(c: Column) -> Column:
    """What stands beside a span: 0 the edge of text or line, 1 a space, 2 a letter or digit, 3 anything else."""
    return F.when((c == "") | (c == "\n"), 0).when(c == " ", 1).when(c.rlike(r"[\p{L}\p{N}]"), 2).otherwise(3)


def _voted(x: Column) -> Column:
    """A candidate with its kind, votes of -1, 0, 1 and features."""
    hit, left, right = x["hit"], x["left"], x["right"]
    named = rf"^({_TITLES}|{_GIVEN})\b"

    def told(n):
        kind = F.when(hit.rlike(_SPELLED) & ~hit.rlike(_ASSIGNED), "mail").when(hit.rlike(_ASSIGNED), "secret").when(hit.rlike(r"^\p{Lu}"), "name").otherwise("number")
        return F.struct(
            x["start"].alias("start"),
            x["stop"].alias("stop"),
            kind.alias("kind"),
            F.when(hit.rlike(_PERSONAL_SHAPES), 1).when(hit.rlike(_OTHER_SHAPES), -1).otherwise(0).alias("shape"),
            F.when(n.between(7, 15) & ~hit.rlike(_DATE), 1).when(hit.rlike(_DATE) | n.between(1, 6) & ~hit.rlike("[A-Za-z]"), -1).otherwise(0).alias("digits"),
            F.when(hit.rlike(_KEYS) & hit.rlike(_ASSIGNED) | hit.rlike(named), 1).when(hit.rlike(_ASSIGNED), -1).otherwise(0).alias("gazetteer"),
            F.when(left.rlike(_CUES), 1).otherwise(0).alias("cue"),
            F.when(F.concat(F.right(left, F.lit(8)), F.lit(" "), F.left(right, F.lit(8))).rlike(_AGAINST), -1).otherwise(0).alias("against"),
            F.when(F.length(hit) < 10, 0).when(F.length(hit) < 16, 1).when(F.length(hit) < 32, 2).otherwise(3).alias("long"),
            F.when(n == 0, 0).when(2 * n < F.length(hit), 1).otherwise(2).alias("share"),
            _side(F.right(left, F.lit(1))).alias("before"),
            _side(F.left(right, F.lit(1))).alias("after"),
        )

    return let(F.length(_digits(hit)), told)


def found(docs: DataFrame) -> DataFrame:
    """doc_id, mark, one array of spans for each base kind, and candidates with their votes and features."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    guards = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    none = F.array().cast("array<struct<start:int,stop:int>>")

    def base(k):
        good = F.transform(F.filter(located(F.col("text"), _PATTERNS[k]), lambda x: _CHECKS[k](x["hit"])), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))
        return (F.when(guards[k], good).otherwise(none) if k in guards else good).alias(k)

    def free(spans):
        apart = lambda x: ~(_touched(x["start"], x["stop"], spans[BASE[0]]) | _touched(x["start"], x["stop"], spans[BASE[1]]) | _touched(x["start"], x["stop"], spans[BASE[2]]) | _touched(x["start"], x["stop"], spans[BASE[3]]))
        more = F.transform(F.filter(located(F.col("text"), _CANDIDATES), apart), _voted)
        return F.struct(*(spans[k].alias(k) for k in BASE), more.alias("more"))

    told = let(F.struct(*map(base, BASE)), free)
    return own.select("doc_id", F.xxhash64("text").alias("mark"), told.alias("told")).select("doc_id", "mark", "told.*")


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def estimate(patterns: list[tuple], rounds: int = 60):
    """EM over (votes, count) with votes of -1, 0, 1 by labeler: P(true | votes) of each pattern.

    Labelers are independent given the truth; a vote's likelihoods are smoothed. Starts from the mean vote.
    """
    if not patterns:
        return {}
    m = len(patterns[0][0])
    post = {v: _sigmoid(1.5 * sum(v)) for v, _ in patterns}
    for _ in range(rounds):
        total = [1.0, 1.0]
        like = [[{x: 1.0 for x in (-1, 0, 1)} for _ in range(m)] for _ in range(2)]
        for v, c in patterns:
            for y, p in ((1, post[v]), (0, 1 - post[v])):
                total[y] += c * p
                for j, x in enumerate(v):
                    like[y][j][x] += c * p
        new = {}
        for v, _ in patterns:
            score = math.log(total[1] / total[0])
            for j, x in enumerate(v):
                score += math.log(like[1][j][x] / sum(like[1][j].values())) - math.log(like[0][j][x] / sum(like[0][j].values()))
            new[v] = _sigmoid(score)
        moved = max(abs(new[v] - post[v]) for v in new)
        post = new
        if moved < 1e-9:
            break
    return post


def train(rows: list[tuple], rounds: int = 300):
    """Logistic weights {(feature, value): w} and "bias" from (features, target, count), by gradient descent."""
    known = sorted({f for row in rows for f in row[0]}, key=str)
    at = {f: i for i, f in enumerate(known)}
    x = np.zeros((len(rows), len(known) + 1))
    x[:, -1] = 1
    for i, (features, _, _) in enumerate(rows):
        x[i, [at[f] for f in features]] = 1
    target, count = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    count /= count.sum() or 1
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 2.0 * (x.T @ ((p - target) * count) + 1e-4 * w)
    return {"bias": float(w[-1]), **{f: float(w[i]) for f, i in at.items()}}


def _logit(weights: dict, x: Column) -> Column:
    total = F.lit(weights.get("bias", 0.0))
    for name in FEATURES:
        terms = [(v, w) for (k, v), w in ((k, w) for k, w in weights.items() if k != "bias") if k == name]
        if terms:
            case = F
            for v, w in terms:
                case = case.when(x[name] == v, F.lit(w))
            total = total + case.otherwise(F.lit(0.0))
    return total


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, mark (xxhash64 of the text), base and all spans (kind, start, stop) of every row of docs.

    Positions are code points, stop exclusive; spans are sorted by kind as listed in BASE and ADDED, then
    start. A null text is empty; empty texts have no spans. Repeated rows are told row by row. Other columns
    are ignored.
    """
    told = written(found(docs), "pii")
    counts = told.select(F.explode("more").alias("x")).select("x.*").groupBy(*FEATURES).agg(F.count("*").alias("n")).collect()  # TABLE_ROWS at most
    votes: dict = {}
    for r in counts:
        v = tuple(r[k] for k in LABELERS)
        votes[v] = votes.get(v, 0) + r.n
    post = estimate(sorted(votes.items()))
    weights = train([([(k, r[k]) for k in FEATURES], post[tuple(r[k] for k in LABELERS)], r.n) for r in counts]) if counts else {}
    kinded = lambda k, kind: F.transform(k, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    base = F.concat(*(kinded(k, k) for k in BASE))
    added = F.filter("more", lambda x: _logit(weights, x) >= 0)
    # the names of ADDED are in order
    added = F.array_sort(F.transform(added, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"))))
    out = told.select("doc_id", "mark", *BASE, base.alias("base"), added.alias("added"))
    return out.select("doc_id", "mark", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), "base", F.concat("base", "added").alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:stop of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def _piece(blocks: Column, start: Column, stop: Column) -> Column:
    """Characters [start, stop) of a text cut into blocks of _CHUNK."""
    first, last = F.floor(start / _CHUNK).cast("int"), F.floor(stop / _CHUNK).cast("int")
    block = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
    low, high = start - first * _CHUNK, stop - last * _CHUNK
    across = F.concat(F.substr(block(first), low + 1), F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.left(block(last), high))
    return F.when(first == last, F.substr(block(first), low + 1, high - low)).otherwise(across)


def masked(text: Column, spans: Column) -> Column:
    """The text with each maximal run of overlapping spans replaced by its first span's kind in angle brackets."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), s["kind"].alias("kind"))))

    def replaced(s, reach, blocks):
        before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(reach, i - 1))
        one = lambda x, i: F.when(x["start"] >= before(i), F.concat(_piece(blocks, before(i), x["start"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise(F.lit(""))
        return F.concat(F.array_join(F.transform(s, one), ""), _piece(blocks, F.get(reach, F.size(reach) - 1), F.length(text)))

    cut = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    bound = let(ordered, lambda s: let(scan(F.transform(s, lambda x: -x["back"]), F.greatest), lambda reach: let(cut, lambda blocks: replaced(s, reach, blocks))))
    return F.when(F.size(spans) > 0, bound).otherwise(text)
