"""Personal data by weak supervision.

Candidates are spans found by regular expressions: e-mail addresses, IP addresses, card numbers,
phone numbers, and credentials. Three labelers vote on each candidate (1 private, -1 not, 0 no
opinion): a strict form check, a gazetteer (issuer prefixes, country codes, address ranges,
domains, credential keywords), and the context around the span. Expectation-maximisation over the
counts of vote patterns estimates, per kind, how common private spans are and how reliable
each labeler is. Its posteriors train the final span classifier, a logistic regression over kind,
votes and shape of the span.

Votes and shapes take few values, so all that leaves the cluster is a table of pattern counts
(bounded by ``len(KINDS) * 27 * 8`` rows); the classifier goes back as literals. All work on texts is
in built-in functions.

The contract's base spans (form check passed) always stay. The classifier adds candidates of the
kind ``secret``, and near misses of the other kinds, from ``SURE`` on.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import checkpoint
from .registry import query, table
from .spans import match_spans

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
SURE = 0.9
ROUNDS = 50

# Patterns with the same matches as the plain ones, in time linear in the text: a run is entered at its
# start only (or where the last match ended), and nothing is given back that can't match otherwise.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|(?i:password|passwd|token|secret|api[_-]?key)\x20{0,2}[=:]\x20{0,2}[\x22']?[A-Za-z0-9_/+-]{8,}+",
}
NEEDS = {"email": "@", "phone": "+"}  # without it there is no match
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

# fixed values: what the gazetteer knows
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at|be|ca|us"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65"
COUNTRIES = "1|33|34|39|41|43|44|49|31|32|351|45|46|47|48|52|55|61|81|86|91"
NO_HOST = r"0\.|127\.|255\.255\.255\.255"
CUES = r"(?i)(mail|contact|write to|call|phone|tel|fax|mobile|card|visa|paid|account|address|host|server|login|user|password|secret|token|key)\W{0,3}$"
COUNTER_CUES = r"(?i)(version|release|build|section|chapter|isbn|license|figure|table)\W{0,3}$"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a valid check digit."""

    def term(i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), lambda acc, i: acc + term(i)) % 10 == 0


def strict(kind: str, m: Column) -> Column:
    """The form check; for the base kinds, the contract's."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.regexp_like(m, F.lit(rf"^{PART}(?:\.{PART}){{3}}$"))
    if kind == "card":
        n = F.length(digits(m))
        return F.when((n >= 16) & (n <= 19), luhn(digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        n = F.length(digits(m))
        return (n >= 8) & (n <= 15)
    return F.regexp_like(m, F.lit(r"^A[KS]IA|[0-9a-f]{16,}|(?=.*[0-9]).*[A-Za-z0-9_/+-]{12,}"))


def gazetteer(kind: str, m: Column) -> Column:
    yes = {
        "email": F.regexp_like(m, F.lit(rf"(?i)\.(?:{DOMAINS})$")), "ip": ~F.regexp_like(m, F.lit(rf"^(?:{NO_HOST})")),
        "card": F.regexp_like(m, F.lit(rf"^(?:{ISSUERS})")), "phone": F.regexp_like(m, F.lit(rf"^\+(?:{COUNTRIES})(?![0-9]{{12}})")),
        "secret": F.regexp_like(m, F.lit(r"^(?:A[KS]IA|(?i:password|passwd|token|secret|api))")),
    }[kind]
    return F.when(yes, 1).otherwise(-1)


def _worth_a_look(kind: str, m: Column) -> Column:
    """Matches that are candidates at all: any two digits match the card pattern."""
    if kind == "card":
        n = F.length(digits(m))
        return (n >= 14) & (n <= 19)
    return F.lit(True)


def candidates(text: Column, kind: str) -> Column:
    """Array of candidates with votes and shape; its base spans are those whose form vote is 1."""

    def describe(x: Column) -> Column:
        left, right = x["left"], x["right"]
        inside = F.regexp_like(left, F.lit(r"[\p{L}\p{N}_]$")) | F.regexp_like(right, F.lit(r"^[\p{L}\p{N}_]"))
        context = F.when(inside | F.regexp_like(left, F.lit(COUNTER_CUES)), -1).when(F.regexp_like(left, F.lit(CUES)), 1).otherwise(0)
        shape = F.regexp_like(left, F.lit(r"(^|\s)$")).cast("int") + 2 * F.regexp_like(right, F.lit(r"^(\s|$)")).cast("int") + 4 * F.regexp_like(x["m"], F.lit(r"[\x20()\x22'-]")).cast("int")
        return F.struct(
            F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.when(strict(kind, x["m"]), 1).otherwise(-1).alias("form"),
            gazetteer(kind, x["m"]).alias("known"), context.alias("context"), shape.alias("shape"),
        )

    found = F.filter(match_spans(text, PATTERNS[kind], 24, 1), lambda x: _worth_a_look(kind, x["m"]))
    none = F.array().cast("array<struct<kind:string,s:int,e:int,form:int,known:int,context:int,shape:int>>")
    if kind in NEEDS:
        found = F.when(F.contains(text, F.lit(NEEDS[kind])), found)
    return F.coalesce(F.transform(found, describe), none)


# -- learning on pattern counts --------------------------------------------------------------


def expectation_maximisation(rows: Sequence[tuple[tuple[int, ...], float]], rounds: int = ROUNDS) -> list[float]:
    """Posterior of "private" for each (votes, count); two-state model, labelers independent given the state.

    Starts from labelers that are mostly right; counts are smoothed by one.
    """
    if not rows:
        return []
    k = len(rows[0][0])
    prior = 0.5
    hit = [[0.15, 0.15, 0.7] for _ in range(k)]  # shares of votes -1, 0, 1 on private spans
    miss = [[0.7, 0.15, 0.15] for _ in range(k)]
    post: list[float] = []
    for _ in range(rounds):
        post = []
        for votes, _n in rows:
            a = math.log(prior) + sum(math.log(hit[j][v + 1]) for j, v in enumerate(votes))
            b = math.log(1 - prior) + sum(math.log(miss[j][v + 1]) for j, v in enumerate(votes))
            post.append(1 / (1 + math.exp(max(-50.0, min(50.0, b - a)))))
        total = sum(n for _, n in rows)
        mass = sum(p * n for p, (_, n) in zip(post, rows))
        prior = (mass + 1) / (total + 2)
        for j in range(k):
            for v in range(3):
                mine = [(p, n) for p, (votes, n) in zip(post, rows) if votes[j] + 1 == v]
                hit[j][v] = (sum(p * n for p, n in mine) + 1) / (mass + 3)
                miss[j][v] = (sum((1 - p) * n for p, n in mine) + 1) / (total - mass + 3)
    return post


def features(votes: tuple[int, ...], shape: int) -> list[str]:
    return [f"{j}:{v}" for j, v in enumerate(votes)] + [f"left:{shape & 1}", f"right:{shape >> 1 & 1}", f"marks:{shape >> 2 & 1}"]


def logistic(rows: Sequence[tuple[list[str], float, float]], steps: int = 300, penalty: float = 1e-3) -> dict[str, float]:
    """Weights of indicator features from (features, target, weight); the empty name is the intercept."""
    w: dict[str, float] = {"": 0.0}
    total = sum(n for *_, n in rows) or 1.0
    for _ in range(steps):
        grad: dict[str, float] = {}
        for names, target, n in rows:
            z = w[""] + sum(w.get(x, 0.0) for x in names)
            g = (1 / (1 + math.exp(max(-50.0, min(50.0, -z)))) - target) * n / total
            for x in ("", *names):
                grad[x] = grad.get(x, 0.0) + g
        for x, g in grad.items():
            w[x] = w.get(x, 0.0) - 1.0 * (g + penalty * w.get(x, 0.0))
    return w


def learn(found: DataFrame) -> dict[str, dict[str, float]]:
    """Classifier weights per kind from the candidates of ``found`` (column ``cands``)."""
    c = found.select(F.explode("cands").alias("c"))
    counts = c.groupBy("c.kind", "c.form", "c.known", "c.context", "c.shape").agg(F.count(F.lit(1)).alias("n")).collect()
    weights = {}
    for kind in KINDS:
        mine = sorted(((r.form, r.known, r.context), r["shape"], float(r.n)) for r in counts if r.kind == kind)
        post = expectation_maximisation([(v, n) for v, _, n in mine])
        weights[kind] = logistic([(features(v, s), p, n) for (v, s, n), p in zip(mine, post)]) if mine else {"": 0.0}
    return weights


def probability(c: Column, weights: dict[str, dict[str, float]]) -> Column:
    """The classifier's probability of one candidate."""
    def z(w: dict[str, float]) -> Column:
        out = F.lit(w.get("", 0.0))
        for j, name in enumerate(("form", "known", "context")):
            for v in (-1, 0, 1):
                if f"{j}:{v}" in w:
                    out = out + F.when(c[name] == v, w[f"{j}:{v}"]).otherwise(0.0)
        for bit, name in enumerate(("left", "right", "marks")):
            on = F.shiftright(c["shape"], bit).bitwiseAND(F.lit(1)) == 1
            out = out + F.when(on, w.get(f"{name}:1", 0.0)).otherwise(w.get(f"{name}:0", 0.0))
        return out

    total = F.lit(0.0)
    for kind in KINDS:
        total = F.when(c["kind"] == kind, z(weights[kind])).otherwise(total)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def find_private(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """``docs`` without text: ``base`` and ``found``, arrays of (kind, s, e) in the order of KINDS, then position.

    Null and empty texts have none. ``found`` has all of ``base`` and what the classifier adds.
    Columns named base or found are replaced. Repeated rows are looked at one by one; an empty table gives an
    empty result.
    """
    keep = [c for c in docs.columns if c not in ("text", "base", "found", "cands")]
    d = docs.select(*keep, F.concat(*[candidates(F.col("text"), k) for k in KINDS]).alias("cands"))
    d = checkpoint(d)
    weights = learn(d)
    span = lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"))
    is_base = lambda c: c["kind"].isin(*BASE) & (c["form"] == 1)
    added = lambda c: is_base(c) | (probability(c, weights) >= sure)
    return d.select(*keep, F.transform(F.filter("cands", is_base), span).alias("base"), F.transform(F.filter("cands", added), span).alias("found"))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


@query()
def op1_private(spark, d):
    """Personal data of every document: counts, digest of the base spans, and all spans."""
    out = find_private(table(spark, d, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return out.select("doc_id", *[n(k) for k in BASE], F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("found").alias("spans"))
