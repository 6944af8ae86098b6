"""Secret scans with DataFrame functions only.

Fixed rules find keyed assignments, access keys and long hexadecimal runs. On top, two first-order Markov
models over characters, one of random strings and one of ordinary identifiers, are trained from labelled
samples and compared by log-likelihood ratio; long tokens outside the rule spans that look random become
spans of kind `model`. Everything is a map over rows: texts are never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed rules. A shorter run cannot start a longer one in the last two, so their length bound is in the pattern.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_MIN = 12
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
ORDINARY = r"[A-Za-z_]{12,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_-."
KINDS = ("assign", "access", "hex", "model")
SPAN = "array<struct<start:int,no:int,end:int,value:string>>"
SAMPLE_DOCS = 20_000
SMOOTH = 0.1


def spans(text: Column, pattern: str, no: int, value_group: int = 0) -> Column:
    """All leftmost non-overlapping matches: start and end (code points, end exclusive) and a group's value."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    parts = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("match"), values.alias("value"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        one = F.array(F.struct(start.alias("start"), F.lit(no).alias("no"), end.alias("end"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.concat(acc["out"], one).cast(SPAN).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(parts, zero, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def rule_spans(text: Column) -> tuple[Column, Column, Column]:
    return F.filter(spans(text, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= ASSIGN_MIN), spans(text, ACCESS, 1), spans(text, HEX, 2)


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(token, random): values that the fixed rules find (1) and long plain words (0), from about `sample_docs` documents.

    The documents are drawn by a hash of id and text, so the sample is bounded and the same in every run.
    """
    share = min(1.0, sample_docs / max(1, docs.count()))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("secrets")), F.lit(1 << 30)) / float(1 << 30)
    rows = docs.filter(draw < share).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), draw.alias("draw"))
    rules = F.flatten(F.array(*rule_spans(F.col("text"))))
    random = rows.select(F.explode(F.transform(rules, lambda s: s["value"])).alias("token"), F.lit(1).alias("random"))
    plain = rows.filter(F.col("draw") < share / 10).select(F.explode(F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0))).alias("token"), F.lit(0).alias("random"))
    return random.unionByName(plain)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each pair of characters, `(a * (n + 1) + b)`; 0 stands for any other character.

    Each pair starts at SMOOTH; without samples of a label all its pairs are equally likely. The counts that
    reach the driver are at most 2 * (n + 1)**2.
    """
    n = len(ALPHABET) + 1
    place = lambda i: F.position(F.substring(F.col("token"), i, F.lit(1)), F.lit(ALPHABET))
    steps = samples.filter(F.length("token") > 1).select("random", "token", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("i"))
    counts = steps.groupBy("random", place(F.col("i")).alias("a"), place(F.col("i") + 1).alias("b")).count().collect()
    table = [[SMOOTH] * (n * n), [SMOOTH] * (n * n)]
    for r in counts:
        table[r["random"]][r["a"] * n + r["b"]] += r["count"]
    rows = [[sum(t[a * n : a * n + n]) for a in range(n)] for t in table]
    return [math.log(table[1][i] / rows[1][i // n]) - math.log(table[0][i] / rows[0][i // n]) for i in range(n * n)]


def log_ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of random string against ordinary identifier."""
    n = len(ALPHABET) + 1
    table = F.from_json(F.lit("[" + ",".join(f"{x:.6f}" for x in model) + "]"), "array<double>")
    places = F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.position(F.substring(token, i, F.lit(1)), F.lit(ALPHABET)))
    zero = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, 0.0).otherwise(F.get(table, acc["last"] * n + p))).alias("sum"))
    return F.aggregate(places, zero, step, lambda acc: acc["sum"])


def scan(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text", least: float = 10.0) -> DataFrame:
    """One row per input row: id and `spans`, an array of (start, end, kind, value), by start, then kind.

    A candidate token of 20 or more characters becomes a `model` span if its log-likelihood ratio is at
    least `least` and it does not overlap a rule span. Null texts are empty; texts are read whole. Null and
    repeated ids are ordinary rows; other columns are ignored. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    assign, access, hexes = rule_spans(F.col("text"))
    rows = rows.select("doc_id", F.array_sort(F.flatten(F.array(assign, access, hexes))).alias("base"), spans(F.col("text"), CANDIDATE, 3).alias("long"))
    clear = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    odd = F.filter(F.filter("long", clear), lambda s: log_ratio(s["value"], model) >= least)
    kinds = F.array(*map(F.lit, KINDS))
    out = F.transform(F.array_sort(F.concat("base", odd)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(kinds, s["no"]).alias("kind"), s["value"].alias("value")))
    return rows.select("doc_id", out.alias("spans"))
