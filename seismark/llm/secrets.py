"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control. DataFrame functions only.

Base spans are the leftmost, non-overlapping matches of three patterns. What is left of every run of 20 or more characters of
``[A-Za-z0-9+/_=-]`` when base spans are cut out of it is a candidate where it still has 20. Its encoding (the smallest alphabet of
ENCODINGS that holds it) is inferred, and its symbols are tested

* for uniformity over the alphabet (chi-squared), for the number of runs above and below the alphabet's middle, and for serial correlation
  at lag one: a random key is expected to pass all three at ``ALPHA`` / 3;
* against text: a Markov chain of letters, digits, case and signs as prose, words of compound languages, names in programs and paths
  have them gives the candidate the probability P; a uniform random string of its alphabet has it with probability Q. By Markov's inequality
  P / Q is a p-value of "this is text", whatever the length. Strings of digits alone say nothing to that chain: for them the p-value is the
  lower tail of chi-squared, which under text grows with n * (A * c2 - 1), c2 being the chance that two digits of a number agree.

Those p-values go through Benjamini-Hochberg within each class of encoding and length (powers of two), over all documents. Ranks come from a
histogram (tenths of a decade, p rounded up, so the control is kept), combined before the shuffle: nothing is sorted and the
driver sees at most a row for each class.

Matches are put between marks and texts are split there, so positions are sums of lengths and no text is searched once for each span. The
tested candidates are written to a table before the thresholds are drawn from it, so texts are scanned once.

Defined cases: null or empty texts have no spans; the three noncharacters that serve as marks count as one ordinary character each, and come back as
U+FFFD from a text that is redacted; repeated rows are scanned each; an empty table gives an empty result. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import field, materialize, row_of

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Noncharacters that mark the three kinds of base spans in a text; the last one fills base spans in.
MARKS, FILL = "\ufdd0\ufdd1\ufdd2", "\ufdd3"
#: The patterns of keys and hexadecimal runs in a text that has marks already.
ACCESS_MARKED = r"A\x{fdd0}*K\x{fdd0}*I\x{fdd0}*A[A-Z0-9\x{fdd0}]{16,}"
HEX_MARKED = r"(?<![0-9a-f])[0-9a-f][0-9a-f\x{fdd0}\x{fdd1}]{23,}"

UPPER, LOWER, DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings from the smallest alphabet: (name, pattern, alphabet in order).
ENCODINGS = [
    ("digits", "[0-9]+", DIGIT),
    ("hex", "[0-9a-f]+", DIGIT + "abcdef"),
    ("HEX", "[0-9A-F]+", DIGIT + "ABCDEF"),
    ("lower", "[a-z]+", LOWER),
    ("UPPER", "[A-Z]+", UPPER),
    ("base32", "[A-Z2-7]+", UPPER + "234567"),
    ("lower36", "[0-9a-z]+", DIGIT + LOWER),
    ("UPPER36", "[0-9A-Z]+", DIGIT + UPPER),
    ("base62", "[0-9A-Za-z]+", DIGIT + UPPER + LOWER),
    ("base64", "[0-9A-Za-z+/]+", UPPER + LOWER + DIGIT + "+/"),
    ("base64url", "[0-9A-Za-z_-]+", UPPER + LOWER + DIGIT + "-_"),
    ("mixed", "[0-9A-Za-z+/_=-]+", UPPER + LOWER + DIGIT + "+/-_="),
]
#: Chance that two, and three, digits of a number in a text agree.
SAME2, SAME3 = 0.2, 0.045
#: Fixed values: -4 log of the chance that a letter (row) is followed by another (column), a = 0 to z = 25, rounded down. Means over English, German,
#: French, Spanish, Italian, Dutch, Swedish, Polish and Finnish (messages and manuals of free programs), smoothed.
NEXT_LETTER = """
nommrsountnimhupvilinpstur jruwgtuwhowistjvyjorkxxxmw kwptkvwfkqkpuuhsynrkoxxytn iutqdvvwhwurtpisyopqnvuxsr psnnnqotnspkngsqwhikqrtpvr
ltupiktvewwmuthsympmmxwxux kuusfwooixwnqkkrykmojwwyxv hxtqewxthsrosrkvyotknwvysx mqlnipmvrqokngkrunjkspvuxs hsvnetuwmwpruohpyupsjsuyxs
irqtfsotjxpptqiqyokkluuytw ituoftswhvritqjsyuomluwurx gmusfvuwiyvrlpjkytprnvxxtx junjipkvixqsunjuxtlhnqwyqt ronmpqpsouplkgolxhkmnrowxt
huqsisstkytltshlyhpllvwysu rsuupvvwrxvpuqstvqrnbvjytw isnmgtoqjsprnpjtxollnqsyqo luluhttpivoptslnwpkfmuuyoq hvruguvnhyssusjtykolmvsxns
npopkppvlrpllhpnyjjiqrruwu guvvewvwhyxvutiuyrqtqvxxvy gvsqhvrmgxuqtoirxnmtrxrvow momqjpvuixsrotrhysqfqvvomr mrlsntrrqsqoiknhypihqvqurw
hsssevuthwvqpqkvuspqkwpvnp
""".split()
#: Chance that a lower-case letter, capital, digit or sign (row) is followed by each of them in words, names of programs and paths.
NEXT_KIND = [(0.84, 0.05, 0.03, 0.08), (0.40, 0.48, 0.04, 0.08), (0.10, 0.10, 0.70, 0.10), (0.50, 0.20, 0.20, 0.10)]
SYMBOLS = LOWER + UPPER + DIGIT + "+/_-="
#: Level of the three tests for randomness together, and the false-discovery rate within a class.
ALPHA, RATE = 0.003, 0.01
#: Symbols that a candidate has at least, without the signs that pad its end.
LEAST = 16
MOST_BIN = 300
#: Entries of an array that are summed in one go.
_BLOCK = 128


def _text_costs(hexes: bool = False) -> str:
    """-log of the chance that a symbol of text follows another, for all pairs of SYMBOLS in order; ``hexes``: in words of a to f, all alike."""
    kind = [0 if c in LOWER else 1 if c in UPPER else 2 if c in DIGIT else 3 for c in SYMBOLS]

    def cost(i: int, j: int) -> float:
        if kind[j] < 2:
            own = math.log(6) if hexes else LOWER.index(NEXT_LETTER[i % 26][j % 26]) / 4 if kind[i] < 2 else math.log(26)
        else:
            own = math.log(10 if kind[j] == 2 else 5)
        return own - math.log(NEXT_KIND[kind[i]][kind[j]])

    every = range(len(SYMBOLS))
    return " ".join(f"{cost(i, j):.2f}" for i in every for j in every)


def _running(lengths: Column) -> Column:
    """For each of an array's lengths the sum of those before it. Blocks are summed apart, so that no long array is copied for each entry."""

    def within(block: Column, base: Column) -> Column:
        start = F.struct(base.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(block, start, lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    many = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((many - 1) / _BLOCK).cast("int")), lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("at"), F.array().cast("array<array<bigint>>").alias("out"))
    total = lambda block: F.aggregate(block, zero, lambda a, v: a + v)
    return F.aggregate(blocks, start, lambda acc, b: F.struct((acc["at"] + total(b)).alias("at"), F.concat(acc["out"], F.array(within(b, acc["at"]))).alias("out")), lambda acc: F.flatten(acc["out"]))


def _let(value: Column, fn) -> Column:
    """fn(value), with value computed once however often fn uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _cut(text: Column, pattern: str, mark: str) -> Column:
    """The text split before and after each match: every second piece, from the second on, is one."""
    return F.split(F.regexp_replace(text, pattern, f"{mark}$0{mark}"), mark, -1)


def _plain(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), MARKS + FILL, "\ufffd" * 4)


_SPAN = "array<struct<start:bigint,end:bigint,token:string>>"


def _spans(pieces: Column, keep) -> Column:
    """array<struct<start, end, token>> of the matches among pieces that pass ``keep``."""
    at = _running(F.transform(pieces, lambda p: F.char_length(p).cast("long")))
    found = F.transform(F.arrays_zip(pieces.alias("token"), at.alias("start")), lambda x, i: F.struct(x["token"].alias("token"), x["start"].alias("start"), (i % 2 == 1).alias("hit")))
    hits = F.filter(found, lambda x: x["hit"] & keep(x["token"]))
    spans = F.transform(hits, lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.char_length(x["token"])).alias("end"), x["token"].alias("token")))
    return F.when(F.size(pieces) > 1, spans).otherwise(F.array().cast(_SPAN))


def _matches(text: Column, pattern: str, keep) -> Column:
    return _let(_cut(text, pattern, MARKS[0]), lambda pieces: _spans(pieces, keep))


def _assigns(piece: Column) -> Column:
    return F.char_length(F.regexp_extract(piece, ASSIGN, 2)) >= 6


def base_spans(text: Column) -> Column:
    """array<struct<start, end, kind, token>> by start, then kind in the order assign, access, hex."""
    whole, every = _plain(text), lambda piece: F.lit(True)
    kinds = [("assign", ASSIGN, _assigns), ("access", ACCESS, every), ("hex", HEX, every)]
    names = F.array(*[F.lit(k) for k, _, _ in kinds])

    def tag(spans: Column, order: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), s["token"].alias("token")))

    tagged = [tag(_matches(whole, pattern, keep), i) for i, (_, pattern, keep) in enumerate(kinds)]
    return F.transform(F.array_sort(F.concat(*tagged)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(names, s["order"] + 1).alias("kind"), s["token"].alias("token")))


def _filling(keep):
    return lambda piece, i: F.when((i % 2 == 1) & keep(piece), F.regexp_replace(piece, f"[^{MARKS}]", FILL)).otherwise(piece)


def filled(text: Column) -> Column:
    """The text with every character of a base span replaced by FILL. The three kinds are marked in one text, each kind's pattern
    reading over the marks of those before it; then each kind's matches are filled in turn, which leaves the marks of the others."""
    bare = lambda piece: F.translate(piece, MARKS, "")
    keeps = [lambda p: _assigns(bare(p)), lambda p: F.char_length(bare(p)) >= 20, lambda p: F.char_length(bare(p)) >= 24]
    out = _plain(text)
    for pattern, mark in zip((ASSIGN, ACCESS_MARKED, HEX_MARKED), MARKS, strict=True):
        out = F.regexp_replace(out, pattern, f"{mark}$0{mark}")
    for mark, keep in zip(MARKS, keeps, strict=True):
        out = F.array_join(F.transform(F.split(out, mark, -1), _filling(keep)), "")
    return out


def candidates(text: Column) -> Column:
    """The candidates of a text whose base spans are filled."""
    return _matches(text, CANDIDATE, lambda piece: F.lit(True))


def _upper_tail(z: Column) -> Column:
    """P(N > z), from above for z >= 0 (Mills' ratio at most 2 / (z + sqrt(z^2 + 8 / pi)))."""
    a = F.abs(z)
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * 2 / (a + F.sqrt(a * a + 2.5464790894703255))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _choose(code: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), code)


def tested(spans: Column) -> Column:
    """The candidates with their encoding, length class and p-value bin; bin -1 if a test speaks against randomness."""
    costs, hex_costs = (F.split(F.lit(_text_costs(h)), " ").cast("array<double>") for h in (False, True))

    def coded(s: Column) -> Column:
        body = F.regexp_replace(s["token"], "=+$", "")
        code = F.coalesce(*[F.when(body.rlike(f"^{p}$"), F.lit(i + 1)) for i, (_, p, _a) in enumerate(ENCODINGS)])
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["token"].alias("token"), body.alias("body"), F.coalesce(code, F.lit(len(ENCODINGS))).alias("code"))

    def indexed(s: Column) -> Column:
        alphabet = _choose(s["code"], [e[2] for e in ENCODINGS])
        symbols = F.filter(F.split(s["body"], ""), lambda c: c != "")
        x = F.transform(symbols, lambda c: F.instr(alphabet, c).cast("double"))
        small = F.when(s["body"].rlike("[a-z]"), s["body"]).otherwise(F.lower(s["body"]))  # capitals throughout read as small letters
        y = F.transform(F.filter(F.split(small, ""), lambda c: c != ""), lambda c: F.instr(F.lit(SYMBOLS), c))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["token"].alias("token"), s["code"].alias("code"), x.alias("x"), y.alias("y"), _choose(s["code"], [float(len(e[2])) for e in ENCODINGS]).alias("a"))

    def summed(s: Column) -> Column:
        x, zero = s["x"], F.lit(0.0)
        pairs = F.aggregate(
            F.array_sort(x),
            F.struct(zero.alias("last"), zero.alias("run"), zero.alias("sum")),
            lambda acc, v: F.when(acc["last"] == v, F.struct(v.alias("last"), (acc["run"] + 1).alias("run"), (acc["sum"] + 2 * acc["run"] + 1).alias("sum"))).otherwise(F.struct(v.alias("last"), F.lit(1.0).alias("run"), (acc["sum"] + 1).alias("sum"))),
            lambda acc: acc["sum"],
        )
        mid = (s["a"] + 1) / 2
        walk = F.aggregate(
            x,
            F.struct(*[zero.alias(n) for n in ("last", "n", "s1", "s2", "lag", "high", "runs")]),
            lambda acc, v: F.struct(
                v.alias("last"),
                (acc["n"] + 1).alias("n"),
                (acc["s1"] + (v - mid)).alias("s1"),
                (acc["s2"] + (v - mid) * (v - mid)).alias("s2"),
                (acc["lag"] + F.when(acc["n"] > 0, (v - mid) * (acc["last"] - mid)).otherwise(0.0)).alias("lag"),
                (acc["high"] + F.when(v > mid, 1.0).otherwise(0.0)).alias("high"),
                (acc["runs"] + F.when((acc["n"] == 0) | ((v > mid) != (acc["last"] > mid)), 1.0).otherwise(0.0)).alias("runs"),
            ),
        )
        text = F.aggregate(
            s["y"],
            F.struct(F.lit(0).alias("last"), zero.alias("cost")),
            lambda acc, v: F.struct(v.alias("last"), (acc["cost"] + F.when(acc["last"] > 0, F.element_at(F.when(s["code"].isin(2, 3), hex_costs).otherwise(costs), (acc["last"] - 1) * len(SYMBOLS) + v)).otherwise(0.0)).alias("cost")),
            lambda acc: acc["cost"],
        )
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["token"].alias("token"), s["code"].alias("code"), s["a"].alias("a"), pairs.alias("squares"), walk.alias("w"), text.alias("text"))

    def judged(s: Column) -> Column:
        n, a, w = F.greatest(s["w"]["n"], F.lit(1.0)), s["a"], s["w"]
        chi = a / n * s["squares"] - n
        # Wilson and Hilferty: the cube root of chi-squared over its degrees of freedom is nearly normal
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / (a - 1), F.lit(1 / 3)) - (1 - 2 / (9 * (a - 1)))) / F.sqrt(2 / (9 * (a - 1)))
        low = n - w["high"]
        mean_runs = 2 * w["high"] * low / n + 1
        var_runs = (mean_runs - 1) * (mean_runs - 2) / F.greatest(n - 1, F.lit(1.0))
        z_runs = F.when(var_runs > 0, F.abs(w["runs"] - mean_runs) / F.sqrt(var_runs)).otherwise(F.lit(99.0))
        spread = w["s2"] - w["s1"] * w["s1"] / n
        mean = w["s1"] / n
        z_serial = F.when(spread > 0, F.abs((w["lag"] - n * mean * mean) / spread) * F.sqrt(n)).otherwise(F.lit(99.0))
        random = (_upper_tail(z_chi) >= ALPHA / 3) & (2 * _upper_tail(z_runs) >= ALPHA / 3) & (2 * _upper_tail(z_serial) >= ALPHA / 3)
        excess, kappa = a * SAME2 - 1, F.greatest(a * a * (SAME3 - SAME2 * SAME2), F.lit(0.0))
        z_text = (a - 1 + n * excess - chi) / F.sqrt(2 * (a - 1) + 4 * n * kappa)
        p_text = F.exp(F.least((n - 1) * F.log(a) - s["text"], F.lit(0.0)))
        p = F.greatest(F.when(s["code"] == 1, _upper_tail(z_text)).otherwise(p_text), F.lit(1e-30))
        bin_ = F.least(F.floor(-10 * F.log10(p)), F.lit(MOST_BIN)).cast("int")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["token"].alias("token"), (s["code"] * 64 + F.floor(F.log2(n)).cast("int")).alias("cls"), F.when(random & (w["n"] >= LEAST), F.greatest(bin_, F.lit(0))).otherwise(F.lit(-1)).alias("bin"))

    return F.transform(F.transform(F.transform(F.transform(spans, coded), indexed), summed), judged)


def scanned(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the document's columns), ``base`` spans, and all candidates, tested, ``cand``."""
    found = docs.select(row_of(docs, keep), field(text_col).alias("text"), base_spans(field(text_col)).alias("base"))
    found = found.select("row", "base", F.when(F.size("base") > 0, filled(F.col("text"))).otherwise(_plain(F.col("text"))).alias("rest"))
    return found.select("row", "base", tested(candidates(F.col("rest"))).alias("cand"))


def thresholds(found: DataFrame, rate: float = RATE) -> dict[int, int]:
    """For each class the least bin that Benjamini-Hochberg rejects "text" from; over all documents."""
    counts = found.select(F.explode("cand").alias("c")).groupBy("c.cls", "c.bin").agg(F.count("*").alias("n"))
    by = Window.partitionBy("cls")  # a row for each bin of the class
    down = by.orderBy(F.col("bin").desc())
    ranked = counts.select("cls", "bin", F.sum("n").over(by).alias("m"), F.sum("n").over(down).alias("k")).filter("bin >= 0")
    meets = F.col("m") * F.pow(F.lit(10.0), -F.col("bin") / 10.0) <= rate * F.col("k")
    least = ranked.filter(meets).groupBy("cls").agg(F.min("bin").alias("bin"))
    return {r["cls"]: r["bin"] for r in least.collect()}  # a row for each class: at most 64 lengths for each encoding


def discovered(cand: Column, limits: dict[int, int]) -> Column:
    """array<boolean>: which candidates lie beyond their class's threshold."""
    if not limits:
        return F.transform(cand, lambda s: F.lit(False))
    least = F.create_map(*[F.lit(x) for kv in sorted(limits.items()) for x in kv])
    return F.transform(cand, lambda s: F.coalesce(s["bin"] >= least[s["cls"]], F.lit(False)))


def secrets(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row``, ``base`` and ``random`` spans (start, end, kind, token), and ``hits``, the candidates in order that are random."""
    found = materialize(scanned(docs, text_col, keep), "tested-candidates")
    with_hits = found.select("row", "base", "cand", discovered(F.col("cand"), thresholds(found)).alias("hits"))
    chosen = F.filter(F.transform(F.arrays_zip("cand", "hits"), lambda x: x), lambda x: x["hits"])
    spans = F.transform(chosen, lambda x: F.struct(x["cand"]["start"].alias("start"), x["cand"]["end"].alias("end"), F.lit("random").alias("kind"), x["cand"]["token"].alias("token")))
    return with_hits.select("row", "base", spans.alias("random"), "hits")


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, hits: Column, mark: str = "[secret]") -> Column:
    """The text with its base spans and the candidates that ``hits`` names cut out, and ``mark`` in the place of each run of such
    characters (spans that touch give one mark). A text without a secret comes back as it is."""

    def cut(rest: Column) -> Column:
        fill = lambda p, i: F.when((i % 2 == 1) & F.coalesce(F.try_element_at(hits, F.floor((i + 1) / 2).cast("int")), F.lit(False)), F.lit(FILL)).otherwise(p)
        return F.when(F.exists(hits, lambda h: h), F.array_join(F.transform(_cut(rest, CANDIDATE, MARKS[0]), fill), "")).otherwise(rest)

    done = lambda whole: F.when(F.instr(whole, FILL) > 0, F.regexp_replace(whole, f"{FILL}+", mark)).otherwise(text)
    return F.when(text.isNotNull(), _let(_let(filled(text), cut), done))
