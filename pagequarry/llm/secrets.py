"""Secret scan: three known forms by pattern, and a battery of randomness tests for what has no known form.

Known forms: assignments (`password = ...`), access keys (`AKIA...`) and long hexadecimal runs. Beside them, every run of
20 or more characters of [A-Za-z0-9+/_=-] is a candidate. Its encoding is inferred from the characters that it holds
(hexadecimal, base 32, digits, one case with and without digits, letters with and without digits, base 64), then three tests ask whether it
looks like uniform draws from that alphabet:

* chi-squared over the counts of the alphabet's characters;
* runs above and below the alphabet's middle (Wald-Wolfowitz);
* serial correlation of neighbours at lag one.

The evidence against written text is the likelihood of the uniform draws against that of two models of writing (letters
after letters, letters alone; both with the moves between lower case, capitals, digits and signs, so that words, paths,
identifiers and constants are cheap). Under either model the ratio exceeds x with a chance of 1/x at most, at any length,
so its inverse, times the models and encodings tried, is a p-value. Numbers are written as evenly as they are drawn, so
runs of digits alone have no such evidence. Candidates with a digit have a second one: written text over the same alphabet
has a divergence of at least DELTA a character, so its chi-squared is non-central with n * DELTA; the chance that text of
this length comes out as even as the candidate. The lesser of the two counts, doubled. Benjamini-Hochberg over the
candidates of the document holds the false-discovery rate at FDR, and a discovery must not fail the two order tests (each
at ORDER_LEVEL) nor be less even than uniform draws are (chi-squared, at ORDER_LEVEL).

All of it is column expressions over one row's text; nothing is shuffled. Positions are code points, end exclusive.
A null text counts as empty: no spans, and the digest of the empty string. Rows are scanned one by one: repeated rows alike,
null ids like others; extra columns are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import let

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"  # a run of 24 or more is found whole, as [0-9a-f]+ would find it
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Alphabets by inferred encoding, in the order tried: the first that holds all characters of a candidate.
ALPHABETS = [
    "0123456789",
    "0123456789abcdef",
    "0123456789ABCDEF",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "0123456789abcdefghijklmnopqrstuvwxyz",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/=_-",
]
DELTA = 1.2
#: Matches whose places are summed up at a time.
PIECE = 128
FDR, ORDER_LEVEL = 0.01, 0.001
# Half bits (A is 0) of a letter alone, and after each letter of a to z; of prose in four languages and of source code.
LETTERS = "HMJJFLMKIQPJLHILOOIIHJOONN"
AFTER = (
    "LMJJJNMOIQQIJGLMPHGGHNQOMR IPMMDPPOKKSFOMFORLLMJRRRJR IQNOIPQEESLKOMGORLMIMRRRQS HONMDKQNHRRMPLFORLKIKRPOPS IOKJIMNNIRQIMGLMNFHILNPKPM HNNNIKONFSQJNMFORFKJJPRROQ "
    "FMNNDPMJJSPKMKJNRIIKLPPRQP GLMODQNKISOLOKINQKJIMNNRQO KNILGKMOLRQKJEHMPKIHONRORN CQNMGPQOLRRNOMJORMJMKNRRQS KPMMCMOOISRKNLMNRMJLMPKRPR GPNLEJPOHRRGOMIOQMJJJQQRJS "
    "GMONDPOOGSRMLKJHRMKLLRRRPS HMJGGNHMJQOLMLILOKIFLNPRPP KMKKKKNOJPPKKELLPGHJGOMQRR EONLFIQNKSRIPMHKRILJLQRRIS MQOOKQQOMSSLPMNPRMMMBRRRRS GMLMEPMMHQMMMJINQHJILOPRNQ "
    "JNHMFOMJIOOLMMJLNLIFJQPROR HOMNFOPFGSQMMMINRHKKKPPQKL JMLNEMONKSQIKGLKPIJINORHRQ FPNODQPOFSSONMIPRMMMORRRRS GPNNHPPEFSRNNKIORIKMORORRS HPINFNQOISSKLMJFMJMFOMROPR "
    "JMMLIOKMKSRJNKJDRLHGOQLQPQ ILKMFPMMKONLLMKNNLLKDORRQO"
).split()
# Chances to move from lower case, capital, digit and sign to each of them, and of the signs, in written runs.
MOVES = [[0.86, 0.035, 0.02, 0.085], [0.38, 0.50, 0.035, 0.085], [0.09, 0.04, 0.73, 0.14], [0.74, 0.10, 0.08, 0.08]]
SIGNS = {"_": 0.4, "-": 0.25, "/": 0.25, "=": 0.08, "+": 0.02}
SAME_SIGN = 0.6


def text_costs(pairs: bool) -> list[int]:
    """Sixteenths of bits that written text takes for each character of the largest alphabet after each other one.

    pairs: a letter's chance is that after the letter before it, else that of the letter alone.
    """
    shares = lambda row: (lambda w: [x / sum(w) for x in w])([2.0 ** ((65 - ord(c)) / 2) for c in row])
    alone, after = shares(LETTERS), [shares(r) for r in AFTER]
    kind = lambda c: 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3

    def chance(a: str, b: str) -> float:
        if kind(b) == 2:
            return 0.1
        if kind(b) == 3:
            return SIGNS[b] if kind(a) != 3 else (1 - SAME_SIGN) * SIGNS[b] + SAME_SIGN * (a == b)
        return (after[ord(a.lower()) - 97] if pairs and kind(a) < 2 else alone)[ord(b.lower()) - 97]

    return [round(-16 * math.log2(MOVES[kind(a)][kind(b)] * chance(a, b))) for a in ALPHABETS[-1] for b in ALPHABETS[-1]]


def text_evidence(token: Column, k: Column) -> Column:
    """p-value of written text against uniform draws from k characters; the first character counts for neither."""
    every = ALPHABETS[-1]
    costs = [F.split(F.lit(",".join(map(str, text_costs(pairs)))), ",").cast("array<int>") for pairs in (True, False)]
    places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(every), c) - 1)
    steps = lambda at: F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at)), lambda a, b: a * len(every) + b)
    sums = lambda at: F.aggregate(steps(at), F.array(F.lit(0), F.lit(0)), lambda s, i: F.array(*[s[j] + F.get(c, i) for j, c in enumerate(costs)]))
    bits = F.array_min(let(places, sums)) / 16 - (F.length(token) - 1) * F.log2(k)
    return F.when(k == 10, F.lit(1.0)).otherwise(F.least(F.lit(1.0), len(costs) * len(ALPHABETS) * F.pow(F.lit(2.0), -bits)))


def normal_tail(z: Column) -> Column:
    """P(Z > z) for a standard normal variable (Zelen and Severo's polynomial, error under 1e-7)."""

    def of(x):
        poly = x["t"] * (0.319381530 + x["t"] * (-0.356563782 + x["t"] * (1.781477937 + x["t"] * (-1.821255978 + x["t"] * 1.330274429))))
        return let(F.exp(-x["z"] * x["z"] / 2) * 0.3989422804014327 * poly, lambda tail: F.when(x["z"] >= 0, tail).otherwise(1 - tail))

    return let(let(z, lambda v: F.struct(v.alias("z"), (1 / (1 + 0.2316419 * F.abs(v))).alias("t"))), of)


def spans_of(text: Column, pattern: str, least: Column | None = None) -> Column:
    """Array of (start, end, match) of all leftmost non-overlapping matches of a pattern that never matches nothing.

    What lies between the matches comes from split, the matches themselves from regexp_extract_all. Places are running sums
    of their lengths, taken within pieces of PIECE matches first and then over the pieces, as appending to an array copies it.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<s:int,e:int,m:string>>")
    pairs = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), found, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))

    def step(a, x):
        s = a["at"] + x["g"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.array_append(a["out"], F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"))).alias("out"))

    def in_pieces(all_):
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / PIECE).cast("int")), lambda k: F.slice(all_, k * PIECE + 1, PIECE))
        return F.transform(pieces, lambda piece: F.aggregate(piece, F.struct(F.lit(0).alias("at"), empty.alias("out")), step))

    def joined(pieces):
        begins = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, p: F.struct((a["at"] + p["at"]).alias("at"), F.array_append(a["out"], a["at"]).alias("out")))["out"]
        return F.flatten(F.zip_with(pieces, begins, lambda p, b: F.transform(p["out"], lambda x: F.struct((x["s"] + b).alias("s"), (x["e"] + b).alias("e"), x["m"].alias("m")))))

    return F.when(F.rlike(text, F.lit(pattern)), let(let(pairs, in_pieces), joined)).otherwise(empty)


def battery(token: Column) -> Column:
    """Struct of a candidate: n, p_text (evidence against written text), p_even, p_runs and p_serial (against uniform draws)."""
    alphabet = F.coalesce(*[F.when(F.rlike(token, F.lit(f"^[{a.replace('-', '')}{'-' if '-' in a else ''}]+$")), F.lit(a)) for a in ALPHABETS])

    def sums(x):
        """Everything that the tests need, each worked out once."""
        t, a = x["t"], x["a"]
        n, k = F.length(t).cast("double"), F.length(a).cast("double")
        counts = F.transform(F.split(a, ""), lambda c: F.length(t) - F.length(F.replace(t, c, F.lit(""))))
        half = F.floor(F.length(a) / 2).cast("int")
        bits = F.call_function("translate", t, a, F.concat(F.repeat(F.lit("0"), half), F.repeat(F.lit("1"), F.length(a) - half)))
        values = F.transform(F.split(t, ""), lambda c: F.instr(a, c) - 1 - (k - 1) / 2)
        products = lambda v: F.aggregate(F.zip_with(v, F.slice(v, 2, F.length(t)), lambda u, w: u * F.coalesce(w, F.lit(0.0))), F.lit(0.0), lambda s, y: s + y)
        return F.struct(
            t.alias("t"), n.alias("n"), k.alias("k"), F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c).alias("squares"), let(values, products).alias("products"),
            let(bits, lambda b: F.struct((n - F.length(F.replace(b, F.lit("1"), F.lit("")))).alias("ones"), F.length(F.regexp_replace(b, "0+|1+", "x")).cast("double").alias("runs"))).alias("b"),
        )

    def tests(x):
        n, k, ones, runs = x["n"], x["k"], x["b"]["ones"], x["b"]["runs"]
        chi = x["squares"] * k / n - n
        # Text's chi-squared is about normal with this mean and variance (non-central, k - 1 degrees, n * DELTA).
        mean, var = k - 1 + n * DELTA, 2 * (k - 1) + 4 * n * DELTA
        p_flat = F.when(F.rlike(x["t"], F.lit("[0-9]")), normal_tail((mean - chi) / F.sqrt(var))).otherwise(F.lit(1.0))
        p_text = F.least(F.lit(1.0), 2 * F.least(p_flat, text_evidence(x["t"], k)))
        p_even = normal_tail((chi - (k - 1)) / F.sqrt(2 * (k - 1)))
        want = 2 * ones * (n - ones) / n + 1
        spread = F.sqrt(F.greatest((want - 1) * (want - 2) / (n - 1), F.lit(1e-9)))
        p_runs = F.when((ones == 0) | (ones == n), F.lit(0.0)).otherwise(2 * normal_tail(F.abs(runs - want) / spread))
        serial = x["products"] / (F.sqrt(n - 1) * (k * k - 1) / 12)
        return F.struct(n.alias("n"), p_text.alias("p_text"), p_even.alias("p_even"), p_runs.alias("p_runs"), (2 * normal_tail(F.abs(serial))).alias("p_serial"))

    return let(let(F.struct(token.alias("t"), alphabet.alias("a")), sums), tests)


def discoveries(candidates: Column, fdr: float = FDR, level: float = ORDER_LEVEL) -> Column:
    """Those of an array of (s, e, m) that the battery takes for random, by Benjamini-Hochberg over the array."""
    tested = F.transform(candidates, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), battery(c["m"]).alias("b")))

    def select(all_):
        ranked = F.array_sort(F.transform(all_, lambda x: x["b"]["p_text"]))
        m = F.size(all_).cast("double")
        cut = F.aggregate(F.transform(ranked, lambda p, i: F.when(p <= (i + 1) * F.lit(fdr) / m, p).otherwise(F.lit(-1.0))), F.lit(-1.0), lambda a, p: F.greatest(a, p))
        return let(cut, lambda c: F.filter(all_, lambda x: (x["b"]["p_text"] <= c) & (x["b"]["p_even"] >= level) & (x["b"]["p_runs"] >= level) & (x["b"]["p_serial"] >= level)))

    return F.when(F.size(candidates) == 0, F.array().cast("array<struct<s:int,e:int,b:struct<n:double,p_text:double,p_even:double,p_runs:double,p_serial:double>>>")).otherwise(let(tested, select))


def scan(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, and arrays of spans (s, e) by kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = lambda spans: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    long_enough = lambda spans: F.filter(spans, lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6)
    keys = lambda spans: F.filter(spans, lambda x: F.length(x["m"]) >= 20)
    found = docs.select(
        "doc_id",
        bare(let(spans_of(text, ASSIGN), long_enough)).alias("assign"),
        bare(let(spans_of(text, ACCESS), keys)).alias("access"),
        bare(spans_of(text, HEX)).alias("hex"),
        spans_of(text, CANDIDATE).alias("candidates"),
    )
    return found.select("doc_id", "assign", "access", "hex", bare(let(F.col("candidates"), discoveries)).alias("random"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as one string."""

    def joined(kinds):
        tagged = lambda i: lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e"))
        rows = [F.transform(F.col(k), tagged(i)) for i, k in kinds]
        names = F.array(*[F.lit(k) for k in KINDS])
        return F.array_join(F.transform(F.array_sort(F.concat(*rows)), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")

    numbered = list(enumerate(KINDS))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return scanned.select("doc_id", *counts, F.sha2(joined(numbered[:3]).cast("binary"), 256).alias("base_sha256"), joined(numbered).alias("spans"), F.size("random").cast("long").alias("n_random"))
