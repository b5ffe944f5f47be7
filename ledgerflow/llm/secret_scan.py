"""Secret scan: fixed patterns, plus tokens that a battery of randomness tests picks out.

Base spans are the matches of three patterns (assignment, access key, long hex).  Besides
them every run of 20 or more key characters is a candidate.  A run ends before an '=' that
other key characters follow.  A run that mixes '/' or '+' with '_' or '-' fits no alphabet:
its parts between '/' and '+' are candidates, and those between '_' and '-'; found parts
that overlap are reported as one span.  For each candidate:

* the encoding (and so the alphabet) is inferred from its characters;
* chi-squared test: how evenly the alphabet is used.  Under the null, ordinary text, the
  statistic is non-central with a mean that grows with the length, and the p-value is the
  lower tail, so short tokens cannot look convincing;
* runs test (symbols of the upper and lower half of the alphabet) and lag-1 serial
  correlation: a random string passes both, a patterned one (counters, repeated units,
  alternating classes) does not and gets p = 1;
* false-discovery control: Benjamini-Hochberg within each (encoding, length class) over
  all candidates of the corpus.  p-values are counted in fixed bins of 1/20 decade with
  the bin's upper edge as p, so the table of counts has a bounded size and the rule is
  conservative.

Only built-in functions are used.  Defined results: null and empty texts have no spans;
repeated rows and null ids give a row each; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerflow.llm.common import cut, table, text_of
from ledgerflow.llm.spans import apart, count_kind, joined, merged, places, upper_tail

KINDS = ("assign", "access", "hex", "random")
# The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
LEAST = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{14,}+(?:=++(?![A-Za-z0-9+/_-]))?+"  # with its padding at least LEAST
PARTS = (r"[A-Za-z0-9_-]{14,}+=*+", r"[A-Za-z0-9+/]{14,}+=*+")

#: (pattern, alphabet, non-uniformity of ordinary text in it), first match wins.  The last
#: value is k * sum(q^2) - 1 over the k symbols for letter frequencies of European text.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef", 1.0),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF", 1.0),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.1),
    ("base64", "^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 3.2),
    ("base64url", "^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 3.2),
)
FDR = 0.01
GATE = 0.001
BIN = 0.05
MAX_BIN = 6000


def base_spans(text: Column) -> Column:
    assign = F.filter(places(text, ASSIGN, 0, 2), lambda x: F.length(x["m"]) >= 8)
    return F.transform(F.concat(assign, places(text, ACCESS, 1), places(text, HEX, 2)),
                       lambda x: F.struct(x["kind"], x["s"], x["e"]))


def battery(token: Column) -> Column:
    """(enc, p) of a token: the inferred encoding's index, null if none fits, and its p-value."""
    def tests(i: int) -> Column:
        _, _, alphabet, spread = ENCODINGS[i]
        k = len(alphabet)
        body = F.regexp_replace(token, "=+$", "")
        at = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
        return F.transform(F.array(at), lambda v: _p_value(v, k, spread))[0]

    enc = F.lit(None).cast("int")
    p = F.lit(1.0)
    for i in reversed(range(len(ENCODINGS))):
        fits = F.regexp_like(token, F.lit(ENCODINGS[i][1]))
        enc = F.when(fits, F.lit(i)).otherwise(enc)
        p = F.when(fits, tests(i)).otherwise(p)
    return F.struct(enc.alias("enc"), p.alias("p"))


def _p_value(v: Column, k: int, spread: float) -> Column:
    n = F.size(v).cast("double")
    counts = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda s: F.size(F.filter(v, lambda x: x == s)).cast("double"))
    chi = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c) * k / n - n
    mean, sd = (k - 1) + n * spread, F.sqrt(2.0 * (k - 1) + 4.0 * spread * n)
    even = upper_tail((mean - chi) / sd)

    pairs = F.arrays_zip(F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))).alias("a"), F.slice(v, 2, F.size(v)).alias("b"))
    high = F.size(F.filter(v, lambda x: x >= k // 2)).cast("double")
    low = n - high
    changes = F.size(F.filter(pairs, lambda x: (x["a"] >= k // 2) != (x["b"] >= k // 2))).cast("double") + 1
    runs_mean = 2 * high * low / n + 1
    runs_var = (runs_mean - 1) * (runs_mean - 2) / F.greatest(n - 1, F.lit(1.0))
    runs_z = F.when(runs_var > 0, F.abs(changes - runs_mean) / F.sqrt(F.greatest(runs_var, F.lit(1e-9)))).otherwise(F.lit(99.0))

    avg = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x) / n - avg * avg
    cov = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x["a"] * x["b"]) / F.greatest(n - 1, F.lit(1.0)) - avg * avg
    serial_z = F.when(var > 0, F.abs(cov / F.greatest(var, F.lit(1e-9))) * F.sqrt(n)).otherwise(F.lit(99.0))
    passes = (2 * upper_tail(runs_z) >= GATE) & (2 * upper_tail(serial_z) >= GATE)
    return F.when(passes, even).otherwise(F.lit(1.0))


def candidates(text: Column) -> Column:
    """Spans to test, as (kind, s, e, m)."""
    def parts(x: Column, i: int) -> Column:
        return F.transform(places(x["m"], PARTS[i], 3), lambda y: F.struct(
            y["kind"].alias("kind"), (y["s"] + x["s"]).alias("s"), (y["e"] + x["s"]).alias("e"), y["m"].alias("m")))

    def split(x: Column) -> Column:
        mixed = F.regexp_like(x["m"], F.lit("[+/]")) & F.regexp_like(x["m"], F.lit("[_-]"))
        return F.when(mixed, F.concat(parts(x, 0), parts(x, 1))).otherwise(F.array(x))

    return F.filter(F.flatten(F.transform(places(text, CANDIDATE, 3), split)), lambda x: F.length(x["m"]) >= LEAST)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, base (array of spans), added (array of spans) per row of ``docs``."""
    text = text_of(text_col)

    def candidate(x: Column) -> Column:
        t = battery(x["m"])
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), t["enc"].alias("enc"),
                        F.least(F.floor(F.log2(F.length(x["m"]))), F.lit(12)).cast("int").alias("len_class"),
                        F.least(F.floor(-F.log10(F.greatest(t["p"], F.lit(1e-300))) / BIN), F.lit(MAX_BIN)).cast("int").alias("bin"))

    rows = docs.select("doc_id", text.alias("_text"))
    rows = rows.select("doc_id", base_spans(F.col("_text")).alias("base"), candidates(F.col("_text")).alias("runs"))
    rows = rows.select("doc_id", "base", F.transform(apart(F.col("runs"), F.col("base")), candidate).alias("runs"))
    rows = cut(rows.withColumn("runs", F.filter("runs", lambda x: x["enc"].isNotNull())))

    # Benjamini-Hochberg: at most encodings x length classes x bins rows
    bins = rows.select(F.explode("runs").alias("x")).groupBy("x.enc", "x.len_class", "x.bin").count()
    klass = W.partitionBy("enc", "len_class")
    bins = (bins.withColumn("m", F.sum("count").over(klass))
            .withColumn("upto", F.sum("count").over(klass.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0))))
    p_edge = F.pow(F.lit(10.0), -F.col("bin") * BIN)
    limits = bins.filter((F.col("bin") > 0) & (p_edge <= F.col("upto") / F.col("m") * FDR)).groupBy("enc", "len_class").agg(F.min("bin").alias("least"))
    keyed = limits.select(F.struct((F.col("enc") * 100 + F.col("len_class")).alias("key"), "least").alias("x"))
    least = keyed.agg(F.map_from_entries(F.collect_list("x")).alias("m")).scalar()

    def found(x: Column) -> Column:
        return x["bin"] >= F.coalesce(F.try_element_at(F.col("_least"), x["enc"] * 100 + x["len_class"]), F.lit(MAX_BIN + 1))

    added = F.transform(merged(F.filter("runs", found)), lambda x: F.struct(F.lit(3).alias("kind"), x["s"], x["e"]))
    return rows.withColumn("_least", least).select("doc_id", "base", added.alias("added"))


def op3_secrets(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", count_kind("base", 0).alias("n_assign"), count_kind("base", 1).alias("n_access"),
        count_kind("base", 2).alias("n_hex"), F.sha2(joined(F.col("base"), KINDS, True), 256).alias("base_sha256"),
        joined(F.concat("base", "added"), KINDS, True).alias("spans"), F.size("added").cast("long").alias("n_random"))
