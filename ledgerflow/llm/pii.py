"""Personal data by weak supervision over candidate spans.

Candidates are the base matches (email, ip, card, phone) and looser finds: obfuscated
addresses, card-like numbers that fail the base rule, local phone numbers and national
ids.  Five labelers vote yes, no or abstain on each candidate:

* shape: a strict regular expression of the kind;
* gazetteer: known top-level domains, card issuer prefixes, country codes, reserved nets;
* cue: a word of the kind's vocabulary shortly before the span;
* doubt: a word or sign shortly before the span that speaks for another reading
  (version, order number, amount, ...), votes no or abstains;
* edges: the span stands alone or is glued to letters and digits.

Expectation-maximisation estimates, per kind, how often each labeler is right, from the
counts of vote patterns over all documents (at most 3^5 patterns a kind).  The posterior
of each candidate then trains the span classifier, a naive Bayes model over features of
the span's form and surroundings; looser finds become spans where it says yes.  Base
spans always stay.

Only built-in functions are used; what comes back to the driver are the model's numbers,
whose count depends on kinds, labelers and features alone.  Defined results: null and
empty texts have no spans; repeated rows and null ids give a row each; extra columns are
ignored; without any candidate no model is trained.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ledgerflow.llm.common import cut, table, text_of
from ledgerflow.llm.spans import apart, count_kind, digits, joined, luhn, places

KINDS = ("email", "ip", "card", "phone", "id")
LABELERS = ("shape", "gazetteer", "cue", "doubt", "edges")
ROUNDS = 12
CONTEXT = 32  # characters before a span that a labeler sees

# The base patterns, with possessive loops and run guards.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Looser finds.
EMAIL_AT = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]++)++"
CARD_LIKE = r"(?<![0-9A-Za-z])[0-9](?:[\x20-]?[0-9]){12,18}+(?![0-9A-Za-z])"
PHONE_LOCAL = r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"
NATIONAL_ID = r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"

TLDS = "com|org|net|edu|gov|int|mil|info|biz|io|eu|de|fr|es|it|uk|us|ca|ch|at|nl|be|pl|pt|se|no|dk|fi|jp|cn|in|br|mx|au|nz"
SHAPES = (
    r"^[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9].*[A-Za-z]{2,}$",
    r"^(?:[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
    r"^(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})$",
    r"^(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{2,4}){2,4}$",
    r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
)
GAZETTEERS = (
    rf"(?i)\.(?:{TLDS})$",
    r"^(?!0\.|10\.|127\.|169\.254\.|192\.168\.|2(?:2[4-9]|[3-5][0-9])\.)",
    r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9])",
    r"^(?!9)[0-9]",
)
CUES = (
    r"(?i)(?:e-?mail|mail|contact|write|correo|courriel|kontakt|address)\W*$",
    r"(?i)(?:\bip|host|server|address|adresse|direcci.n|login|from)\W*$",
    r"(?i)(?:card|visa|credit|debit|tarjeta|carte|karte|payment)\W*$",
    r"(?i)(?:phone|tel|call|fax|mobile|cell|m.vil|telefon|t.l.phone|tel.fono)\W*$",
    r"(?i)(?:ssn|social security|national id|identity)\W*$",
)
DOUBT = r"(?i)(?:version|release|build|\bv|order|invoice|isbn|issn|serial|part|item|\bno\.?|#|\$|€|£)\W{0,2}$"


def valid_ip(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
        F.split(m, r"\."), lambda p: F.coalesce(F.substring(F.regexp_replace(p, "^0+(?=[0-9])", ""), 1, 4).cast("int"), F.lit(0)) <= 255)


def base_spans(text: Column) -> Column:
    ip = F.filter(places(text, IP, 1, context=CONTEXT), lambda x: valid_ip(x["m"]))
    card = F.filter(places(text, CARD, 2, context=CONTEXT), lambda x: F.length(digits(x["m"])).between(16, 19) & luhn(digits(x["m"])))
    phone = F.filter(places(text, PHONE, 3, context=CONTEXT), lambda x: F.length(digits(x["m"])).between(8, 15))
    return F.concat(places(text, EMAIL, 0, context=CONTEXT), ip, card, phone)


def looser_spans(text: Column) -> Column:
    return F.concat(places(text, EMAIL_AT, 0, context=CONTEXT), places(text, CARD_LIKE, 2, context=CONTEXT),
                    places(text, PHONE_LOCAL, 3, context=CONTEXT), places(text, NATIONAL_ID, 4, context=CONTEXT))


def _by_kind(kind: Column, patterns: tuple[str, ...], value: Column) -> Column:
    out = F.lit(False)
    for i, p in enumerate(patterns):
        out = F.when(kind == i, F.regexp_like(value, F.lit(p))).otherwise(out)
    return out


def describe(x: Column) -> Column:
    """Votes (one number, base 3: 0 abstains, 1 yes, 2 no) and features of a candidate."""
    before, after = x["before"], x["after"]
    kind, m = x["kind"], x["m"]
    n = F.length(digits(m))
    glued = F.regexp_like(before, F.lit(r"[A-Za-z0-9]$")) | F.regexp_like(after, F.lit(r"^[A-Za-z0-9]"))
    shape = _by_kind(kind, SHAPES, m) & ((kind != 2) | luhn(digits(m)))
    votes = [
        F.when(shape, 1).otherwise(2),
        F.when(_by_kind(kind, GAZETTEERS, m), 1).otherwise(2),
        F.when(_by_kind(kind, CUES, before), 1).otherwise(0),
        F.when(F.regexp_like(before, F.lit(DOUBT)), 2).otherwise(0),
        F.when(glued, 2).otherwise(1),
    ]
    code = F.lit(0)
    for v in reversed(votes):
        code = code * 3 + v
    form = F.substring(F.regexp_replace(F.regexp_replace(m, "[0-9]", "9"), "[A-Za-z]", "a"), 1, 6)
    last = F.regexp_extract(before, r"(.)$", 1)
    sign = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "9"), r"\p{L}", "a"), r"\s", "_")
    features = F.array(
        F.concat(F.lit("len "), F.least(F.length(m), F.lit(40)).cast("string")),
        F.concat(F.lit("digits "), F.least(n, F.lit(20)).cast("string")),
        F.concat(F.lit("form "), F.pmod(F.xxhash64(form), F.lit(256)).cast("string")),
        F.concat(F.lit("before "), F.pmod(F.xxhash64(sign(last)), F.lit(64)).cast("string")),
        F.concat(F.lit("after "), F.pmod(F.xxhash64(sign(after)), F.lit(64)).cast("string")),
        F.concat(F.lit("luhn "), luhn(digits(m)).cast("string")))
    return F.struct(kind.alias("kind"), x["s"].alias("s"), x["e"].alias("e"), code.alias("votes"), features.alias("features"))


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, base and loose candidates; a loose find that touches a base span is no candidate."""
    rows = docs.select("doc_id", text_of(text_col).alias("_text"))
    rows = rows.select("doc_id", base_spans(F.col("_text")).alias("base"), looser_spans(F.col("_text")).alias("loose"))
    rows = rows.select("doc_id", "base", apart(F.col("loose"), F.col("base")).alias("loose"))
    return rows.select("doc_id", F.transform("base", describe).alias("base"), F.transform("loose", describe).alias("loose"))


def vote_of(code: Column, j: int) -> Column:
    return F.floor(code / 3 ** j) % 3


def posterior(kind: Column, code: Column, model: dict) -> Column:
    """P(personal data | votes) under ``model``: {kind: (prior, [labeler][class][vote])}."""
    logit = F.lit(0.0)
    for k, (prior, tables) in model.items():
        one = F.lit(math.log(prior / (1 - prior)))
        for j, (no, yes) in enumerate(tables):
            ratios = F.array(*[F.lit(math.log(yes[v] / no[v])) for v in range(3)])
            one = one + F.element_at(ratios, (vote_of(code, j) + 1).cast("int"))
        logit = F.when(kind == k, one).otherwise(logit)
    return 1 / (1 + F.exp(-logit))


def fit_votes(patterns: DataFrame, rounds: int = ROUNDS) -> dict:
    """Expectation-maximisation over (kind, votes, n), a table of bounded size."""
    model = None
    for _ in range(rounds):
        if model is None:  # begin with the majority of the votes
            lean = sum((F.when(vote_of(F.col("votes"), j) == 1, 1).when(vote_of(F.col("votes"), j) == 2, -1).otherwise(0)
                        for j in range(len(LABELERS))), F.lit(0))
            weight = 1 / (1 + F.exp(-lean.cast("double")))
        else:
            weight = posterior(F.col("kind"), F.col("votes"), model)
        sums = [F.sum(F.when(vote_of(F.col("votes"), j) == v, F.col("n") * w).otherwise(0.0)).alias(f"c{c}_{j}_{v}")
                for c, w in enumerate((1 - F.col("w"), F.col("w"))) for j in range(len(LABELERS)) for v in range(3)]
        rows = patterns.withColumn("w", weight).groupBy("kind").agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.col("w")).alias("yes"), *sums).collect()
        model = {}
        for r in sorted(rows, key=lambda r: r["kind"]):
            tables = [[[(r[f"c{c}_{j}_{v}"] + 1) / (sum(r[f"c{c}_{j}_{u}"] for u in range(3)) + 3) for v in range(3)]
                       for c in (0, 1)] for j in range(len(LABELERS))]
            model[r["kind"]] = ((r["yes"] + 1) / (r["n"] + 2), tables)
    return model


def fit_classifier(spans: DataFrame, votes_model: dict) -> tuple[dict, dict]:
    """Naive Bayes over the features, trained on posteriors: ({kind: bias}, {kind feature: weight})."""
    each = spans.select("kind", "features", posterior(F.col("kind"), F.col("votes"), votes_model).alias("w"))
    each = each.select("kind", "w", F.explode(F.concat(F.array(F.lit("")), "features")).alias("f"))
    rows = each.groupBy("kind", "f").agg(F.sum("w").alias("yes"), F.sum(1 - F.col("w")).alias("no")).collect()
    total = {r["kind"]: (r["yes"], r["no"]) for r in rows if r["f"] == ""}
    bias = {k: math.log((y + 1) / (n + 1)) for k, (y, n) in total.items()}
    weights = {}
    for r in rows:
        if r["f"]:
            yes, no = total[r["kind"]]
            weights[f"{r['kind']} {r['f']}"] = math.log((r["yes"] + 0.5) / (yes + 1)) - math.log((r["no"] + 0.5) / (no + 1))
    return bias, weights


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, base (array of spans), added (array of spans) per row of ``docs``."""
    rows = cut(candidates(docs, text_col))
    spans = rows.select(F.explode(F.concat("base", "loose")).alias("x")).select("x.*")
    patterns = cut(spans.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).coalesce(1))
    model = fit_votes(patterns)
    slim = lambda x: F.struct(x["kind"], x["s"], x["e"])
    base = F.transform("base", slim)
    if not model:
        return rows.select("doc_id", base.alias("base"), base.alias("added"))
    bias, weights = fit_classifier(spans, model)
    table_of = F.create_map(*[F.lit(v) for kv in sorted(weights.items()) for v in kv])
    bias_of = F.create_map(*[F.lit(v) for kv in sorted(bias.items()) for v in kv])

    def says_yes(x: Column) -> Column:
        start = F.coalesce(F.try_element_at(F.col("_bias"), x["kind"]), F.lit(-99.0))
        return F.aggregate(x["features"], start, lambda a, f: a + F.coalesce(
            F.try_element_at(F.col("_weights"), F.concat_ws(" ", x["kind"].cast("string"), f)), F.lit(0.0))) > 0

    added = F.transform(F.filter("loose", says_yes), slim)
    return rows.withColumn("_weights", table_of).withColumn("_bias", bias_of).select(
        "doc_id", base.alias("base"), added.alias("added"))


def op10_pii(spark, sf_dir):
    found = find(table(spark, sf_dir, "documents"))
    counts = [count_kind("base", i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base"), KINDS, False), 256).alias("base_sha256"),
                        joined(F.concat("base", "added"), KINDS, False).alias("spans"),
                        F.size("added").cast("long").alias("n_added"))
