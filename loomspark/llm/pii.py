"""Personal data by weak supervision, in DataFrame operations alone.

Patterns propose spans: the strict ones of each kind (the base), and looser
ones for addresses spelt out, addresses of version 6, and for numbers that the
strict ones lose because they run on into the digits that follow. Labelers
vote on each proposal: the strict pattern with its check, the form, a
gazetteer, words around it that speak for the kind and words that speak
against it. Matches of a strict pattern that fail its check are proposals too,
so labelers meet what isn't personal data. Expectation-maximisation over the
counts of vote patterns estimates each labeler's reliability and the share of
true spans; a logistic classifier over votes and shape is trained on the
resulting soft labels. Proposals that it accepts are added to the base, whose
spans always stay.

Patterns run over a text once: the proposals are written, then counted for the
fit and filtered for the result. Votes and shapes take few values, so the
driver sees at most some thousand rows of counts, whatever the size of the
corpus. A text's spans are placed by running sums over pieces of the root of
their number, and what surrounds them is read from segments of the text, so a
text with many spans costs little more than its length.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import Scratch, free_name, table, texts, written

KINDS = ("email", "ip", "card", "phone")

# Fixed values. The base patterns are the contract's; those that could be tried
# anew at every place of a long run begin only where the last match ended or a
# run begins, and repeat without going back, which finds the same matches.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:(?:[0-9]{4}[\x20-]){3}[0-9]{2,7}|[0-9]{14,19})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: What a text must hold before a pattern is tried on it.
GUARD = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: t.contains("+"),
}
LOOSE_GUARD = {
    "email": lambda t: (t.contains("at)") | t.contains("at]") | t.contains(" at ")) & (t.contains("dot)") | t.contains("dot]") | t.contains(" dot ")),
    "ip": lambda t: t.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"),
    "card": GUARD["card"],
    "phone": lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
}
#: Gazetteers: top-level domains; a card's first digits; networks that aren't anyone's; area codes that don't exist.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "uk", "eu", "ch", "at", "nl")
WORDS = {
    "email": r"(?i)mail|contact|write to|reach",
    "ip": r"(?i)\bip\b|host|server|address|login|from",
    "card": r"(?i)card|visa|amex|payment|credit|iban|account",
    "phone": r"(?i)phone|\btel|call|mobile|cell|fax|contact",
}
AGAINST = r"(?i)version|isbn|issn|doi|invoice|serial|checksum|token|sha\d|md5"
AROUND = 24
#: Characters of a segment of a text.
SEGMENT = 512
LABELERS = ("pattern", "form", "gazetteer", "for", "against")
#: How reliable a labeler is taken to be before counts speak: a check of the form more than a word nearby.
FIRST = {"pattern": 0.9, "form": 0.9, "gazetteer": 0.7, "for": 0.75, "against": 0.8}
ROUNDS = 60


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def luhn(value: Column) -> Column:
    """Whether the digits among ``value`` pass the check of card numbers."""

    def passes(digits: Column) -> Column:
        n = F.length(digits)
        # Digits of odd places from the right count as 2d, less 9 from 5 on.
        digit = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
        worth = lambda i, d: F.when(i % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)
        return (n > 0) & (F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + worth(i, digit(i))) % 10 == 0)

    return let(F.regexp_replace(value, "[^0-9]", ""), passes)


def digit_count(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def parts_fit(value: Column) -> Column:
    """Whether every part of a dotted address is 255 at most, leading zeros aside."""
    part = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(F.expr("0") + F.when(F.length(part(p)) > 0, F.substring(part(p), 1, 3).cast("int")).otherwise(0), F.lit(0)) <= 255))


#: Whether a match of the base pattern is a base span.
PASSES = {
    "email": lambda v: F.lit(True),
    "ip": parts_fit,
    "card": lambda v: digit_count(v).between(14, 19) & luhn(v),
    "phone": lambda v: digit_count(v).between(10, 15),
}


def running(values: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """``op`` over each place of an array and all before it.

    Appending copies what is there, so the array is cut to pieces of the root
    of its length: n values cost n to the power 1.5 at most.
    """
    nothing = F.filter(F.array(zero), lambda _: F.lit(False))

    def upto(x: Column, first: Column) -> Column:
        def add(acc: Column, v: Column) -> Column:
            return let(op(acc["last"], v), lambda y: F.struct(y.alias("last"), F.concat(acc["all"], F.array(y)).alias("all")))

        return F.aggregate(x, F.struct(first.alias("last"), nothing.alias("all")), add, lambda acc: acc["all"])

    def pieces(cut: Column) -> Column:
        sums = F.concat(F.array(zero), upto(F.transform(cut, lambda x: F.aggregate(x, zero, op)), zero))
        return let(sums, lambda before: F.flatten(F.transform(cut, lambda x, i: upto(x, F.get(before, i)))))

    def whole(held: Column) -> Column:
        n = F.size(held)
        step = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
        cut = F.transform(F.sequence(F.lit(0), n - 1, step), lambda i: F.slice(held, i + 1, step))
        return F.when(n == 0, nothing).otherwise(let(cut, pieces))

    return let(values, whole)


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def smaller(a: Column, b: Column) -> Column:
    return F.least(a, b)


def segments(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SEGMENT}}}"), F.lit(0))


def cut(held: Column, start: Column, size: Column) -> Column:
    """``size`` characters from ``start`` of the text whose segments are ``held``; what lies outside is left out."""
    first = (start / SEGMENT).cast("int")
    last = ((start + size - 1) / SEGMENT).cast("int")
    part = F.array_join(F.slice(held, first + 1, last - first + 1), "")
    return F.when(size > 0, F.substring(part, start - first * SEGMENT + 1, size)).otherwise(F.lit(""))


SPAN = "struct<start:int,end:int,value:string>"


def located(df: DataFrame, out: str, pattern: str, guard: Column) -> DataFrame:
    """``df`` with the array ``out`` of (start, end, value) of the pattern's matches in ``text``, in code points."""
    m, ends = f"{out}_m", f"{out}_ends"
    nothing = F.expr("cast(array() as array<string>)")
    df = df.withColumn(m, F.when(guard, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(nothing))
    # A match ends after all that lies between the matches up to it, and after the matches.
    gaps = F.slice(F.split("text", pattern, -1), F.lit(1), F.size(m))
    steps = F.zip_with(gaps, F.col(m), lambda g, x: F.length(g) + F.length(x))
    found = F.when(F.size(m) > 0, running(steps, F.lit(0), lambda a, b: a + b))
    df = df.withColumn(ends, found)
    span = lambda e, x: F.struct((e - F.length(x)).alias("start"), e.alias("end"), x.alias("value"))
    return df.withColumn(out, F.when(F.size(m) > 0, F.zip_with(ends, m, span)).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))).drop(m, ends)


def proposed(df: DataFrame) -> DataFrame:
    """``df`` (with ``text``) and ``spans``: every proposal with its kind, whether it is a base span, votes and shape."""
    text = F.col("text")
    names = []
    for kind in KINDS:
        for name, patterns, guards in (("base", BASE, GUARD), ("loose", LOOSE, LOOSE_GUARD)):
            names.append(f"{name}_{kind}")
            df = located(df, names[-1], patterns[kind], guards[kind](text))
    some = F.lit(False)
    for n in names:
        some = some | (F.size(n) > 0)
    df = df.withColumn("held", F.when(some, segments(text)))
    parts = [_voted(F.col(f"{name}_{kind}"), kind, order, name == "base") for order, kind in enumerate(KINDS) for name in ("base", "loose")]
    return df.withColumn("spans", F.when(some, F.sort_array(F.concat(*parts))).otherwise(F.expr(f"cast(array() as array<{PROPOSAL}>)"))).drop(*names, "held")


PROPOSAL = "struct<start:int,order:int,end:int,kind:string,base:boolean,pattern:int,form:int,gazetteer:int,for:int,against:int,parted:boolean,length:int>"


def _voted(found: Column, kind: str, order: int, strict: bool) -> Column:
    """Votes: 1 for, 0 against, -1 no opinion."""

    def judge(x: Column) -> Column:
        v = x["value"]
        begin = F.greatest(F.lit(0), x["start"] - AROUND)
        if kind == "email":
            last = F.lower(F.element_at(F.split(v, r"\.|\x20dot\x20|\x20?[\[(]dot[\])]\x20?"), -1))
            form, known = last.rlike("^[a-z]{2,}$"), last.isin(*DOMAINS)
        elif kind == "ip":
            form = parts_fit(v) if strict else v.rlike("[1-9A-Fa-f]") & v.rlike("[0-9A-Fa-f]{3}")
            known = ~v.rlike(r"^(?:0|127|255)\.|^(?:0+:)+0*1$") & ~v.rlike(r"\.\d{4,}")
        elif kind == "card":
            form, known = let(digit_count(v).between(14, 19) & luhn(v), lambda y: y), v.rlike("^[3-6]")
        else:
            form, known = digit_count(v).between(10, 15), ~v.rlike(r"^\(?(?:000|123)")

        def put(passes: Column, near: Column) -> Column:
            return F.struct(
                x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind"), passes.alias("base"),
                F.when(passes, 1).otherwise(0).alias("pattern"), form.cast("int").alias("form"), known.cast("int").alias("gazetteer"),
                F.when(near.rlike(WORDS[kind]), 1).otherwise(-1).alias("for"), F.when(near.rlike(AGAINST), 0).otherwise(-1).alias("against"),
                v.rlike(r"[\x20().-]").alias("parted"), F.least(F.lit(3), (F.length(v) / 8).cast("int")).alias("length"),
            )

        near = cut(F.col("held"), begin, x["end"] + AROUND - begin)
        return let(PASSES[kind](v) if strict else F.lit(False), lambda passes: let(near, lambda near: put(passes, near)))

    return F.transform(found, judge)


@dataclass
class Classifier:
    """Weights by feature name; a span's features are its kind, its votes and its shape."""

    weights: dict[str, float]
    reliability: dict[str, float]

    def accepts(self, x: Column) -> Column:
        score = F.lit(self.weights.get("bias", 0.0)) + self._look(F.concat(F.lit("kind="), x["kind"]))
        for name in LABELERS:
            score = score + self._look(F.concat(F.lit(f"{name}="), x[name].cast("string")))
        score = score + self._look(F.concat(F.lit("parted="), x["parted"].cast("string"))) + self._look(F.concat(F.lit("length="), x["length"].cast("string")))
        return score >= 0

    def _look(self, key: Column) -> Column:
        pairs = [F.lit(z) for k, w in sorted(self.weights.items()) for z in (k, float(w))] or [F.lit(""), F.lit(0.0)]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(0.0))


def fit(proposals: DataFrame) -> Classifier:
    """Reliabilities and classifier from the counts of vote patterns over the ``spans`` of all documents."""
    rows = proposals.where(F.size("spans") > 0).select(F.explode("spans").alias("x"))
    names = ["kind", *LABELERS, "parted", "length"]
    counted = [r.asDict() for r in rows.select(*(F.col(f"x.{n}").alias(n) for n in names)).groupBy(*names).agg(F.count("*").alias("n")).collect()]
    return train(counted)


def train(counted: list[dict]) -> Classifier:
    """EM over (kind, votes) counts, then logistic regression on the soft labels; both over bounded lists."""
    right = {(j, y): FIRST[j] for j, y in product(LABELERS, (0, 1))}
    share = dict.fromkeys(KINDS, 0.5)
    soft = [0.5] * len(counted)
    for _ in range(ROUNDS):
        for i, r in enumerate(counted):
            odds = math.log(share[r["kind"]] / (1 - share[r["kind"]]))
            for j in LABELERS:
                if r[j] == 1:
                    odds += math.log(right[j, 1] / (1 - right[j, 0]))
                elif r[j] == 0:
                    odds += math.log((1 - right[j, 1]) / right[j, 0])
            soft[i] = 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))
        for kind in KINDS:  # priors keep what few spans say from being taken as certain
            own = [(r["n"], p) for r, p in zip(counted, soft, strict=True) if r["kind"] == kind]
            share[kind] = (5 + sum(n * p for n, p in own)) / (10 + sum(n for n, _ in own))
            share[kind] = min(0.99, max(0.01, share[kind]))
        for j in LABELERS:
            said = [(r["n"], r[j], p) for r, p in zip(counted, soft, strict=True) if r[j] >= 0]
            one = (sum(n * p for n, v, p in said if v == 1), sum(n * p for n, _, p in said))
            nil = (sum(n * (1 - p) for n, v, p in said if v == 0), sum(n * (1 - p) for n, _, p in said))
            right[j, 1] = min(0.98, max(0.52, (10 * FIRST[j] + one[0]) / (10 + one[1])))
            right[j, 0] = min(0.98, max(0.52, (10 * FIRST[j] + nil[0]) / (10 + nil[1])))
    features = [["bias", f"kind={r['kind']}", *(f"{j}={r[j]}" for j in LABELERS), f"parted={str(r['parted']).lower()}", f"length={r['length']}"] for r in counted]
    weights = dict.fromkeys((f for fs in features for f in fs), 0.0)
    total = sum(r["n"] for r in counted)
    for step in range(400):
        grad = dict.fromkeys(weights, 0.0)
        for fs, r, p in zip(features, counted, soft, strict=True):
            g = r["n"] / total * (1 / (1 + math.exp(-max(-40.0, min(40.0, sum(weights[f] for f in fs))))) - p)
            for f in fs:
                grad[f] += g
        for f in weights:
            weights[f] -= 0.8 * (grad[f] + 1e-4 * weights[f])
    return Classifier(weights, {j: (right[j, 1] + right[j, 0]) / 2 for j in LABELERS})


def accepted(df: DataFrame, model: Classifier) -> DataFrame:
    """``df`` with ``spans`` cut down to the base and to what the classifier accepts and no base span overlaps, in order of start, then kind."""
    slim = lambda x: F.struct(x["start"].alias("start"), x["order"].alias("order"), x["end"].alias("end"), x["kind"].alias("kind"), x["base"].alias("base"))
    df = df.withColumn("spans", F.transform(F.filter("spans", lambda x: x["base"] | model.accepts(x)), slim))
    mixed = F.size("spans") > 1
    most, least = F.lit(0), F.lit(2**31 - 1)
    # The furthest end of a base span up to each place, and the next beginning of one from there on.
    ends = running(F.transform("spans", lambda x: F.when(x["base"], x["end"]).otherwise(most)), most, larger)
    starts = F.reverse(running(F.reverse(F.transform("spans", lambda x: F.when(x["base"], x["start"]).otherwise(least))), least, smaller))
    ends_, starts_ = free_name(df, "base_ends"), free_name(df, "base_starts")
    df = df.withColumn(ends_, F.when(mixed, ends)).withColumn(starts_, F.when(mixed, starts))

    def stays(x: Column, i: Column) -> Column:
        before = F.get("spans", i - 1)
        same = (i > 0) & (before["start"] == x["start"]) & (before["end"] == x["end"]) & (before["kind"] == x["kind"])
        return x["base"] | ((F.get(ends_, i) <= x["start"]) & (F.get(starts_, i) >= x["end"]) & ~F.coalesce(same, F.lit(False)))

    return df.withColumn("spans", F.when(mixed, F.filter("spans", stays)).otherwise(F.col("spans"))).drop(ends_, starts_)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): for every row its spans (start, order, end, kind, base).

    Null and empty texts have no spans. Repeated rows and ids are looked at
    each on its own, very long texts whole. An empty table gives no rows.
    Columns other than the two named are ignored. Offsets count code points.
    """
    found = written(proposed(texts(docs, id_col, text_col)).select("doc_id", "spans"), "proposals")
    return accepted(found, fit(found))


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in brackets; ``chars_col``, where present, follows.

    Rows, columns and their types stay, whatever their names; a null text stays
    null, an empty one empty, and repeated rows are redacted each and alike.
    Very long texts are redacted whole. An empty table gives no rows.
    """
    with Scratch(docs.sparkSession, "redact") as s:
        named = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
        place = f"c{docs.columns.index(text_col)}"
        found = s.written(proposed(named.withColumn("text", F.coalesce(F.col(place), F.lit("")))).drop("text"), "proposals")
        df = accepted(found, fit(found)).withColumn("held", F.when(F.size("spans") > 0, segments(F.col(place))))
        reached = F.when(F.size("spans") > 0, running(F.transform("spans", lambda x: x["end"]), F.lit(0), larger))
        df = df.withColumn("reached", reached)

        def put(x: Column, i: Column) -> Column:
            """What lies before a span and its kind; nothing for one that begins within what was replaced already."""
            before = F.when(i > 0, F.get("reached", i - 1)).otherwise(0)
            return F.when(x["start"] < before, F.lit("")).otherwise(F.concat(cut(F.col("held"), before, x["start"] - before), F.lit("["), F.upper(x["kind"]), F.lit("]")))

        last = F.element_at("reached", -1)
        clean = F.concat(F.array_join(F.transform("spans", put), ""), cut(F.col("held"), last, F.length(place) - last))
        df = df.withColumn("clean", F.when(F.size("spans") > 0, clean).otherwise(F.col(place)))
        kinds = dict(docs.dtypes)

        def column(i: int, c: str) -> Column:
            if c == text_col:
                return F.col("clean").alias(c)
            if c == chars_col:
                return F.when(F.size("spans") > 0, F.length("clean").cast(kinds[c])).otherwise(F.col(f"c{i}")).alias(c)
            return F.col(f"c{i}").alias(c)

        return written(df.select(*(column(i, c) for i, c in enumerate(docs.columns))), "redacted")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of all documents; the counts are of base spans, like ``base_sha256``."""
    found = personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )
