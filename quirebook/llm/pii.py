"""Personal data by aggregated weak supervision, in DataFrame functions only.

Candidates come from patterns: four base kinds (email, ip, card, phone), which always count, and further kinds (local
phone numbers, social security numbers, IBANs, names after a title), which a classifier decides. Labelers vote on each
candidate, yes, no or not at all: a stricter regex, a checksum or structure rule, gazetteers, words before it, and what
it touches. The votes of all candidates are counted by pattern (of which there are at most len(KINDS) * 3^5), and
expectation-maximisation over the patterns estimates how reliable each labeler is and how likely each pattern is true.
A logistic regression trained on those estimates, weighted by count, is the span classifier; as it is a few
coefficients, it becomes part of the plan. Texts are never shuffled, written or sent to Python.

A match's place is the length of what splitting at the pattern leaves before it, so spans are in code points, end
exclusive. Lengths are summed by blocks, so that a text may hold very many matches. Patterns are possessive and tied to the start of a run of their characters (or the last match's end), which
finds the same matches in time linear in the text.

Defined cases: a null text is an empty one; repeated rows are scanned alike; where there is no candidate to learn from,
a span of a further kind counts if two more labelers vote for it than against; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirebook.llm.common import let, read

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "local", "ssn", "iban", "name")
LABELERS = ("regex", "structure", "gazetteer", "context", "touching")
FOUND = "array<struct<kind:int,start:int,end:int,votes:array<int>>>"

PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # with the number of digits, so that tables of other numbers make no matches
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9]){8,14}+(?![\x20().-]*+[0-9])",
}
#: Of the further kinds, in the order in which they are tried.
MORE = {
    "ssn": r"(?<![0-9A-Za-z])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
    "local": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "name": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++)?",
}
#: Fixed lists: top-level domains, country codes of IBANs, given names, words before personal data and before other numbers.
DOMAINS = "com org net edu gov io de fr es uk eu info biz".split()
COUNTRIES = "AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split()
GIVEN = "Anna Maria Peter Paul Hans Thomas Michael Sarah Laura Jean Pierre Marie Jose Carmen Juan Carlos Elena John James Mary Robert Linda David Julia".split()
BEFORE = r"(?:e-?mail|mail to|contact|tel|phone|fax|mobile|call|ssn|social security|tax id|iban|account|konto|card|visa|credit|name|dear|address|ip)[^\p{L}\p{N}]{0,4}(?:\p{L}{1,8}[^\p{L}\p{N}]{0,3})?$"
OTHER = r"(?:order|invoice|isbn|version|item|lot|serial|part|page|chapter|section|figure|no\.?|nr\.?)[^\p{L}\p{N}]{0,4}$"
EM_ROUNDS, BLOCK = 25, 256


def running(values: Column, combine: Callable[[Column, Column], Column], zero: Column) -> Column:
    """What combine makes of the values up to each one. A step of an aggregation copies what it has gathered, so the
    values are gathered in blocks of about the root of their number, and then what stands before each block."""
    nothing = F.filter(F.array(zero), lambda x: F.lit(False))

    def gathered(items: Column, step: Callable[[Column, Column], Column]) -> Column:
        start = F.struct(zero.alias("at"), nothing.alias("out"))
        return F.aggregate(items, start, lambda s, x: let(step(s["at"], x), lambda at: F.struct(at.alias("at"), F.concat(s["out"], F.array(at)).alias("out"))), lambda s: s["out"])

    def of(all_: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(all_))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), (F.size(all_) - 1).cast("int"), width), lambda i: gathered(F.slice(all_, i + 1, width), combine))

        def shifted(made: Column) -> Column:
            ends = gathered(made, lambda at, block: combine(at, F.element_at(block, -1)))
            return F.flatten(F.transform(made, lambda block, i: let(F.when(i > 0, F.get(ends, i - 1)).otherwise(zero), lambda at: F.transform(block, lambda v: combine(at, v)))))

        return F.when(F.size(all_) > 0, let(blocks, shifted)).otherwise(nothing)

    return let(values, of)


def matches(text: Column, pattern: str) -> Column:
    """All matches as (start, end, m), from the pieces between them."""

    def of(found: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        ends = running(F.zip_with(pieces, found, lambda gap, m: F.length(gap) + F.length(m)), lambda a, b: a + b, F.lit(0))
        return F.zip_with(ends, found, lambda end, m: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("m")))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), of)


def blocks(text: Column) -> Column:
    """text in blocks of BLOCK characters, as the way to a place in a string grows with the place."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), 0)


def cut(parts: Column, start: Column, end: Column) -> Column:
    """The characters of a text in blocks from start to end."""
    first = F.floor(start / BLOCK).cast("int")
    n = F.greatest(F.floor((end - 1) / BLOCK).cast("int"), first) - first + 1

    def piece(part: Column, i: Column) -> Column:
        from_ = F.greatest(start - (first + i) * BLOCK, F.lit(0))
        return F.substr(part, from_ + 1, F.least(end - (first + i) * BLOCK, F.lit(BLOCK)) - from_)

    return F.array_join(F.transform(F.slice(parts, first + 1, n), piece), "")


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substr(number, F.length(number) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """The check number of an IBAN: letters as two digits, the first four characters last."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def _valid(kind: str, m: Column) -> Column:
    """Whether a match of a base kind counts."""
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return luhn(digits(m))
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1, -1 or, where neither holds, 0."""
    return F.when(yes, 1).when(~yes if no is None else no, -1).otherwise(0)


def _votes(kind: str, parts: Column, x: Column) -> Column:
    m = x["m"]
    any_of = lambda words: "(?:" + "|".join(words) + ")"
    none = F.lit(0)
    regex, structure, gazetteer = {
        "email": (_vote(m.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")), _vote(~m.rlike(r"\.\.|\.@")), _vote(m.rlike(rf"(?i)\.{any_of(DOMAINS)}$"), F.lit(False))),
        "ip": (_vote(m.rlike(r"^(?:[1-9][0-9]{0,2}|0)(?:\.(?:[1-9][0-9]{0,2}|0)){3}$")), _vote(~m.rlike(r"^(?:0|255)\.")), _vote(m.rlike(r"^(?:10|192\.168|127)\."), F.lit(False))),
        "card": (_vote(m.rlike(r"^[0-9]{4}([ -]?)[0-9]{4,6}\1[0-9]{4,5}(?:\1[0-9]{4})?$"), F.lit(False)), _vote(F.length(digits(m)).isin(15, 16), F.lit(False)), _vote(m.rlike("^(?:4|5[1-5]|3[47]|6)"), F.lit(False))),
        "phone": (_vote(m.rlike(r"^\+[0-9]{1,3}[ -]?\(?[0-9]+\)?(?:[ -][0-9]+)*$")), _vote(F.length(digits(m)) >= 10, F.lit(False)), _vote(m.rlike(r"^\+(?:1|3[0-9]|4[0-9])"), F.lit(False))),
        "local": (_vote(m.rlike(r"^(?:\([0-9]{3}\) |[0-9]{3}([-. ]))[0-9]{3}[-.][0-9]{4}$")), _vote(m.rlike(r"^\(?[2-9][0-9]{2}\)?.[2-9]")), none),
        "ssn": (_vote(m.rlike(r"^[0-8]")), _vote(~m.rlike(r"^(?:000|666|9)|-00-|-0000$")), none),
        "iban": (_vote(m.rlike(r"^[A-Z]{2}[0-9]{2}(?:[0-9A-Z]+|(?: [0-9A-Z]{4})+(?: [0-9A-Z]{1,3})?)$")), _vote(mod97(m)), _vote(m.rlike(rf"^{any_of(COUNTRIES)}"))),
        "name": (none, _vote(m.rlike(r"\p{Ll}{2,}$")), _vote(m.rlike(rf"\b{any_of(GIVEN)}\b"), F.lit(False))),
    }[kind]
    before = F.lower(cut(parts, F.greatest(x["start"] - 40, F.lit(0)), x["start"]))
    sides = F.concat(cut(parts, F.greatest(x["start"] - 1, F.lit(0)), x["start"]), F.lit(" "), cut(parts, x["end"], x["end"] + 1))
    return F.array(regex, structure, gazetteer, _vote(before.rlike(BEFORE), before.rlike(OTHER)), _vote(~sides.rlike(r"[\p{L}\p{N}_/@=]")))


def apart(taken: Column, others: Column) -> Column:
    """Those of others that touch no span of taken. All are put in order once: before a span lies the furthest end of
    taken spans, after it their nearest start."""
    mark = lambda c, i: F.struct(c["start"].alias("start"), c["end"].alias("end"), i.alias("other"))
    marks = F.array_sort(F.concat(F.transform(taken, lambda c: mark(c, F.lit(-1))), F.transform(others, mark)))
    far = (1 << 31) - 1

    def of(m: Column) -> Column:
        before = running(F.transform(m, lambda c: F.when(c["other"] < 0, c["end"]).otherwise(0)), F.greatest, F.lit(0))
        after = F.reverse(running(F.reverse(F.transform(m, lambda c: F.when(c["other"] < 0, c["start"]).otherwise(far))), F.least, F.lit(far)))
        sides = F.arrays_zip(m.alias("m"), before.alias("before"), after.alias("after"))
        free = F.filter(sides, lambda c: (c["m"]["other"] >= 0) & (c["before"] <= c["m"]["start"]) & (c["after"] >= c["m"]["end"]))
        return F.transform(free, lambda c: F.get(others, c["m"]["other"]))

    return let(marks, of)


def candidates(text: Column) -> Column:
    """All candidates of a text: base kinds in order, each by start, then the others that touch no base span."""
    nothing = F.array().cast(FOUND)

    def made(kind: str, parts: Column, x: Column) -> Column:
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), _votes(kind, parts, x).alias("votes"))

    def voted(found: Column, of: Callable[[Column, Column], Column]) -> Column:
        """Only where something is found is the text cut."""
        return let(found, lambda f: F.when(F.size(f) > 0, let(blocks(text), lambda parts: F.transform(f, lambda x: of(parts, x)))).otherwise(nothing))

    def of(kind: str) -> Column:
        return voted(F.filter(matches(text, PATTERNS[kind]), lambda x: _valid(kind, x["m"])), lambda parts, x: made(kind, parts, x))

    gates = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.rlike(r"\+[0-9]")}
    base = F.concat(*(F.when(gates[k], of(k)).otherwise(nothing) for k in BASE))
    every = "|".join(f"(?:{p})" for p in MORE.values())

    def more(parts: Column, x: Column) -> Column:
        rest = made("name", parts, x)
        for kind in ("iban", "local", "ssn"):
            # within a match the text around is gone, so look-arounds hold by themselves
            rest = F.when(x["m"].rlike(f"^(?:{MORE[kind]})$"), made(kind, parts, x)).otherwise(rest)
        return rest

    def both(found: Column) -> Column:
        order = lambda c: F.struct(c["kind"], c["start"], c["end"], c["votes"])
        return let(matches(text, every), lambda rest: F.concat(found, F.array_sort(F.transform(voted(apart(found, rest), more), order)).cast(FOUND)))

    return let(base, lambda found: F.when(text.rlike(every), both(found)).otherwise(found))


def expectation_maximisation(patterns: Sequence[tuple[int, tuple[int, ...], int]], rounds: int = EM_ROUNDS) -> list[float]:
    """The probability that each pattern (kind, votes, count) is personal data. Each labeler has its own chance of
    voting yes, no or not at all on true and on other candidates; each kind has its own share of true ones."""
    likely = [1 / (1 + math.exp(-sum(v))) for _, v, _ in patterns]
    for _ in range(rounds):
        share: dict[int, list[float]] = {}
        table = [[{-1: 1.0, 0: 1.0, 1: 1.0} for _ in LABELERS] for _ in range(2)]
        for (kind, votes, n), p in zip(patterns, likely):
            for z, w in ((0, n * (1 - p)), (1, n * p)):
                share.setdefault(kind, [1.0, 1.0])[z] += w
                for labeler, v in enumerate(votes):
                    table[z][labeler][v] += w
        sums = [[sum(t.values()) for t in table[z]] for z in range(2)]
        now = []
        for kind, votes, _ in patterns:
            log = [math.log(share[kind][z]) + sum(math.log(table[z][i][v] / sums[z][i]) for i, v in enumerate(votes)) for z in range(2)]
            now.append(1 / (1 + math.exp(max(-700.0, min(700.0, log[0] - log[1])))))
        likely = now
    return likely


def train(docs: DataFrame) -> list[float]:
    """Coefficients of the span classifier, learned from all candidates of docs (text, ...): an intercept, one for each
    labeler's vote and one for each kind."""
    found = docs.select("text").select(F.explode(_of_text(docs.sparkSession.sparkContext.applicationId)).alias("c"))
    counts = found.groupBy("c.kind", "c.votes").agg(F.count("*").alias("n")).collect()  # len(KINDS) * 3^5 rows at most
    patterns = sorted((r["kind"], tuple(r["votes"]), r["n"]) for r in counts)
    if not patterns:
        return [-1.5, *(1.0 for _ in LABELERS), *(0.0 for _ in KINDS)]
    rows = []
    for (kind, votes, n), p in zip(patterns, expectation_maximisation(patterns)):
        features = (*map(float, votes), *(float(kind == k) for k in range(len(KINDS))))
        rows += [(1.0, n * p + 1e-9, *features), (0.0, n * (1 - p) + 1e-9, *features)]
    names = [f"f{i}" for i in range(len(LABELERS) + len(KINDS))]
    table = docs.sparkSession.createDataFrame(rows, ", ".join(f"{c} double" for c in ("label", "weight", *names)))
    fit = LogisticRegression(maxIter=50, regParam=0.01, standardization=False, weightCol="weight")
    model = fit.fit(VectorAssembler(inputCols=names, outputCol="features").transform(table).coalesce(1))
    return [model.intercept, *map(float, model.coefficients)]


@lru_cache(4)
def _of_text(application: str) -> Column:
    """The candidates of the column text. The expression is large, so it is put together once for a session."""
    return candidates(F.coalesce("text", F.lit("")))


def spans(spark: SparkSession, model: list[float]) -> Column:
    """The candidates of the column text that count: all of base kinds, and those that the classifier takes."""
    bias, votes, kinds = model[0], model[1 : 1 + len(LABELERS)], model[1 + len(LABELERS) :]

    def taken(c: Column) -> Column:
        score = sum((F.get(c["votes"], F.lit(i)) * w for i, w in enumerate(votes)), F.lit(bias)) + F.element_at(F.array(*map(F.lit, kinds)), c["kind"] + 1)
        return (c["kind"] < len(BASE)) | (score >= 0)

    return F.filter(_of_text(spark.sparkContext.applicationId), taken)


def told(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda c: F.concat_ws(":", F.element_at(names, c["kind"] + 1), c["start"], c["end"])), ",")


def merged(found: Column) -> Column:
    """Spans (start, end, kind) in order; those that overlap are one, of the first one's kind."""

    def firsts(s: Column, ends: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(ends, i - 1)))
        one = lambda f, i, at: F.struct(F.get(s, i)["start"].alias("start"), F.get(ends, F.coalesce(F.get(f, at + 1), F.size(s)) - 1).alias("end"), F.get(s, i)["kind"].alias("kind"))
        return let(first, lambda f: F.transform(f, lambda i, at: one(f, i, at)))

    ordered = F.array_sort(F.transform(found, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
    of = lambda s: let(running(F.transform(s, lambda c: c["end"]), F.greatest, F.lit(0)), lambda ends: firsts(s, ends))
    return let(ordered, lambda s: F.when(F.size(s) > 0, of(s)).otherwise(F.array().cast("array<struct<start:int,end:int,kind:int>>")))


def redact(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """docs with each span of personal data (spans that overlap count as one) replaced by its kind in brackets, and
    n_chars, if there, set anew. Other rows and columns stay as they are."""
    model = model or train(docs)
    text = F.coalesce("row.text", F.lit(""))

    def rebuilt(s: Column, parts: Column) -> Column:
        names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
        before = lambda x, i: cut(parts, F.when(i > 0, F.get(s, i - 1)["end"]).otherwise(0), x["start"])
        pieces = F.transform(s, lambda x, i: F.concat(before(x, i), F.element_at(names, x["kind"] + 1)))
        return F.concat(F.array_join(pieces, ""), cut(parts, F.element_at(s, -1)["end"], F.length(text)))

    # in two steps, as one alone nests deeper than the analyser goes
    wrapped = docs.select(F.struct("*").alias("row"), spans(docs.sparkSession, model).alias("found"))
    clean = let(merged(F.col("found")), lambda s: F.when(F.size(s) > 0, let(blocks(text), lambda parts: rebuilt(s, parts))).otherwise(F.col("row.text")))
    wrapped = wrapped.select("row", clean.alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return wrapped.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_pii: see the README for its columns."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs)
    found = docs.select("doc_id", let(spans(spark, model), lambda s: F.struct(s.alias("spans"), F.filter(s, lambda c: c["kind"] < len(BASE)).alias("base"))).alias("f"))
    counts = [F.size(F.filter("f.base", _is(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(told(F.col("f.base")), 256).alias("base_sha256"), told(F.col("f.spans")).alias("spans"))


def _is(kind: int):
    return lambda c: c["kind"] == kind
