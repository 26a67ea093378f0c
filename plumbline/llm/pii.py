"""Personal data by weak supervision, in DataFrame functions only.

Regular expressions find candidates of several kinds. Labelers vote on every candidate: its strict form, a
gazetteer of words that announce such data, a gazetteer of values that are never personal, its neighbours, and its
issuer or domain. Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is
and the posterior of every pattern; a linear classifier trained on the posteriors decides candidates. Spans of
strict form are always kept, the classifier adds others.

Candidates of a kind are found by ``split`` and ``regexp_extract_all`` with one expression: the pieces between
matches give positions and context. Expressions use possessive quantifiers and look-behinds so that long runs of
digits or letters take linear time; they match exactly what the plain forms match.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import settle

BASE = ("email", "ip", "card", "phone")
_LOCAL = r"[A-Za-z0-9._%+-]"
#: kind, expression, what the text must contain (of several, one). Kinds after the first four are the method's own.
KINDS = (
    ("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "digit"),
    ("card", r"[0-9](?:[ -]?[0-9])++", "digit"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+"),
    ("email_words", r"(?:\G|(?<![A-Za-z0-9._-]))[A-Za-z0-9._-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?[\[(.](?:dot[\])] ?)?[A-Za-z0-9-]++)++", "at"),
    ("phone_local", r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9.-])", "digit"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "digit"),
    ("secret", r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?:password|passwd|token|secret|api_key)(?: ?[=:] ?)\"?[0-9A-Za-z]{8,}+\"?", ("AKIA", "=", ":")),
)
NAMES = tuple(kind for kind, _, _ in KINDS)
#: Words before a value that announce it. Fixed values.
ANNOUNCE = r"(?i)(?:e-?mail|mail|contact|kontakt|correo|phone|call|tel|telefon|tel[eé]fono|t[eé]l[eé]phone|mobile|fax|card|karte|tarjeta|carte|visa|ssn|social security|ip|address|host|login|account|password|token|key)[^A-Za-z]{0,6}$"
#: Bytes of 0 to 255 with any leading zeros.
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
#: Characters of context that labelers see on either side.
CONTEXT = 40
LABELERS = ("strict", "announced", "reserved", "neighbours", "issuer")
ROUNDS = 40


def luhn(digits: Column) -> Column:
    """Whether a string of 1 to 19 digits has a valid check digit."""
    value = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), lambda c, i: F.when(
        i % 2 == 1, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(value, F.lit(0), lambda s, x: s + x) % 10 == 0


def strict(kind: Column, match: Column) -> Column:
    """The form that a kind requires. Kinds of the method's own are never strict."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    return F.when(kind == "email", True).when(kind == "ip", match.rlike(OCTETS)).when(
        kind == "card", F.when(n.between(12, 19), luhn(digits)).otherwise(False)).when(
        kind == "phone", n.between(9, 15)).otherwise(False)


def votes(kind: Column, match: Column, before: Column, after: Column) -> list[Column]:
    """1 for personal, -1 against, 0 for nothing to say, in the order of LABELERS."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    form = F.when(strict(kind, match), 1).when(kind.isin(*BASE), -1).otherwise(0)
    announced = F.when(before.rlike(ANNOUNCE) | kind.isin("secret", "email_words"), 1).otherwise(0)
    reserved = F.when((kind == "ip") & match.rlike(r"^0*(?:0|127|255)\."), -1).when(
        digits.rlike(r"^([0-9])\1*$"), -1).when((kind == "ssn") & digits.rlike("^(?:000|666|9)"), -1).otherwise(0)
    glued = before.rlike(r"[A-Za-z0-9_]$") | after.rlike("^[A-Za-z0-9_]")
    neighbours = F.when(glued, -1).otherwise(1)
    issuer = F.when((kind == "card") & (F.length(digits) >= 12), F.when(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), 1).otherwise(-1)).when(
        (kind == "email"), F.when(match.rlike(r"(?i)\.[a-z]{2,10}$"), 1).otherwise(-1)).when(
        kind.isin("phone", "phone_local"), F.when(F.length(digits).between(10, 13), 1).otherwise(-1)).otherwise(0)
    return [form, announced, reserved, neighbours, issuer]


@dataclass(frozen=True)
class Labels:
    """What was learned: per kind and labeler a weight for a vote of 1 and one for -1, and a constant."""
    constant: dict[str, float]
    weights: dict[str, tuple[tuple[float, float], ...]]

    def probability(self, kind: Column, vote: list[Column]) -> Column:
        z = F.lit(0.0)
        for name in NAMES:
            part = F.lit(self.constant.get(name, -5.0))
            for v, (up, down) in zip(vote, self.weights.get(name, ((0.0, 0.0),) * len(LABELERS))):
                part = part + F.when(v == 1, up).when(v == -1, down).otherwise(0.0)
            z = F.when(kind == name, part).otherwise(z)
        return 1.0 / (1.0 + F.exp(-z))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def learn(patterns: list[tuple]) -> Labels:
    """From rows (kind, votes, count), at most 3 ** len(LABELERS) per kind.

    Labelers have rates of +1, -1 and 0 given that a candidate is personal or not, shared by all kinds; kinds have
    priors. The maximisation starts from the majority of the votes.
    """
    rows = [(kind, tuple(v), n) for kind, v, n in patterns]
    posterior = [_sigmoid(1.5 * sum(v) - 0.5) for _, v, _ in rows]
    many = len(LABELERS)
    for _ in range(ROUNDS):
        prior = {}
        for kind in {k for k, _, _ in rows}:
            mass = sum(n for k, _, n in rows if k == kind)
            prior[kind] = (sum(p * n for (k, _, n), p in zip(rows, posterior) if k == kind) + 1) / (mass + 2)
        rates = []
        for j in range(many):
            sides = []
            for sign in (True, False):
                mass = {-1: 1.0, 0: 1.0, 1: 1.0}
                for (_, v, n), p in zip(rows, posterior):
                    mass[v[j]] += n * (p if sign else 1 - p)
                total = sum(mass.values())
                sides.append({s: m / total for s, m in mass.items()})
            rates.append(sides)
        posterior = [_sigmoid(math.log(prior[k] / (1 - prior[k])) + sum(
            math.log(rates[j][0][v[j]] / rates[j][1][v[j]]) for j in range(many))) for k, v, _ in rows]

    # The final classifier: logistic regression per kind on the posteriors, by gradient steps on the counts.
    constant, weights = {}, {}
    for kind in sorted({k for k, _, _ in rows}):
        own = [([1.0] + [float(v[j] == s) for j in range(many) for s in (1, -1)], p, n)
               for (k, v, n), p in zip(rows, posterior) if k == kind]
        total = sum(n for _, _, n in own)
        w = [0.0] * (1 + 2 * many)
        for _ in range(400):
            slope = [0.002 * x for x in w]
            for x, p, n in own:
                error = (_sigmoid(sum(a * b for a, b in zip(x, w))) - p) * n / total
                for i, a in enumerate(x):
                    slope[i] += error * a
            w = [a - 1.0 * g for a, g in zip(w, slope)]
        constant[kind] = w[0]
        weights[kind] = tuple((w[1 + 2 * j], w[2 + 2 * j]) for j in range(many))
    return Labels(constant, weights)


def _pieces(text: Column, expression: str, needs: str | tuple[str, ...]) -> tuple[Column, Column]:
    """Matches, and the pieces around them. Texts without what a match needs are one piece."""
    if needs == "digit":
        possible = text.rlike("[0-9]")
    else:
        possible = F.lit(False)
        for part in (needs,) if isinstance(needs, str) else needs:
            possible = possible | F.contains(text, F.lit(part))
    matches = F.when(possible, F.regexp_extract_all(text, F.lit(f"({expression})"), F.lit(1))).otherwise(F.expr("CAST(array() AS array<string>)"))
    pieces = F.when(possible, F.split(text, expression, -1)).otherwise(F.expr("CAST(array() AS array<string>)"))
    return matches, pieces


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, row, found): one row per row of *docs* with its candidates (kind, i, gap, match, before,
    after) by kind and place; gap is the number of characters between a match and the one of its kind before
    it. Written to the shared folder, because several steps read it."""
    body = F.coalesce(F.col(text), F.lit(""))
    thin = docs.select(F.col(key).alias("key"), body.alias("_text"))
    columns = []
    for kind, expression, needs in KINDS:
        matches, pieces = _pieces(F.col("_text"), expression, needs)
        columns += [matches.alias(f"m_{kind}"), pieces.alias(f"p_{kind}")]
    found = thin.select("key", *columns)

    def described(kind: str) -> Column:
        pieces = F.col(f"p_{kind}")
        return F.transform(f"m_{kind}", lambda m, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(pieces, i)).alias("gap"), m.alias("match"),
            F.right(F.get(pieces, i), F.lit(CONTEXT)).alias("before"),
            F.left(F.get(pieces, i + 1), F.lit(CONTEXT)).alias("after")))

    lists = [described(kind) for kind in NAMES]
    return settle(found.select("key", F.concat(*lists).alias("found"))
                  .withColumn("row", F.monotonically_increasing_id()), "candidates")


def _exploded(found: DataFrame) -> DataFrame:
    return found.select("row", F.explode("found").alias("c")).select("row", "c.*")


def fit(found: DataFrame) -> Labels:
    vote = votes(F.col("kind"), F.col("match"), F.col("before"), F.col("after"))
    named = [v.alias(name) for v, name in zip(vote, LABELERS)]
    counts = _exploded(found).select("kind", *named).groupBy("kind", *LABELERS).count().orderBy("kind", *LABELERS)
    return learn([(r["kind"], [r[x] for x in LABELERS], r["count"]) for r in counts.collect()])


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans): one row per row of *docs*; spans are structs (start, kind_no, kind, end, base) by start
    and then kind, in code points, end exclusive.

    ``base`` spans are the leftmost non-overlapping matches of their kind that have its strict form. Others are
    candidates to which the classifier gives a probability of at least one half, unless they overlap a base span.
    A null text is an empty one; a null key is kept. Repeated rows have a row each. Other columns are not read.
    """
    found = candidates(docs, key, text)
    model = fit(found)
    kind, match = F.col("kind"), F.col("match")
    by_kind = Window.partitionBy("row", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.length("match")).over(by_kind)
    vote = votes(kind, match, F.col("before"), F.col("after"))
    is_base = vote[0] == 1
    number = F.array_position(F.array(*map(F.lit, NAMES)), kind).cast("int")
    placed = _exploded(found).withColumn("end", end).withColumn("base", is_base).filter(
        F.col("base") | (model.probability(kind, vote) >= 0.5)).select("row", F.struct(
            (F.col("end") - F.length("match")).alias("start"), number.alias("kind_no"), "kind", "end", "base").alias("span"))
    spans = placed.groupBy("row").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    spans = spans.select("row", F.expr("""filter(spans, s -> s.base OR NOT exists(spans, b ->
        b.base AND b.start < s.end AND s.start < b.end))""").alias("spans"))
    empty = "CAST(array() AS array<struct<start:bigint,kind_no:int,kind:string,end:bigint,base:boolean>>)"
    return found.select("key", "row").join(settle(spans, "spans"), "row", "left").select(
        "key", F.coalesce("spans", F.expr(empty)).alias("spans"))


def op2_personal_data(docs: DataFrame) -> DataFrame:
    found = find_personal_data(docs)
    joined = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    counts = [F.expr(f"CAST(size(filter(spans, s -> s.base AND s.kind = '{kind}')) AS bigint)").alias(f"n_{kind}") for kind in BASE]
    return found.select(
        F.col("key").alias("doc_id"), *counts,
        F.sha2(F.expr(joined.format("filter(spans, s -> s.base)")), 256).alias("base_sha256"),
        F.expr(joined.format("spans")).alias("spans"))


def _replaced(kind: str, model: Labels):
    """The piece before a match, and the match or what takes its place."""

    def put(m: Column, i: Column) -> Column:
        before, after = F.right(F.get("_p", i), F.lit(CONTEXT)), F.left(F.get("_p", i + 1), F.lit(CONTEXT))
        vote = votes(F.lit(kind), m, before, after)
        found = (vote[0] == 1) | (model.probability(F.lit(kind), vote) >= 0.5)
        return F.concat(F.get("_p", i), F.when(found, f"<{kind.upper()}>").otherwise(m))

    return put


def redact(docs: DataFrame) -> DataFrame:
    """*docs* with personal data in ``text`` replaced by the name of its kind, and ``n_chars`` counted
    anew. A null text stays null. Kinds are replaced one after the other, so what one has replaced is no match
    for the next."""
    model = fit(candidates(docs))
    names = docs.columns
    at = {name: f"c{i}" for i, name in enumerate(names)}  # whatever the columns are called
    out, text = docs.toDF(*at.values()), F.col(at["text"])
    for kind, expression, needs in KINDS:
        matches, pieces = _pieces(text, expression, needs)
        whole = F.concat(F.array_join(F.transform("_m", _replaced(kind, model)), ""), F.element_at("_p", -1))
        out = out.withColumns({"_m": matches, "_p": pieces}).withColumn(
            at["text"], F.when(F.size("_m") > 0, whole).otherwise(text)).drop("_m", "_p")
    if "n_chars" in names:
        out = out.withColumn(at["n_chars"], F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.toDF(*names)
