"""Secret scans: fixed patterns, and a randomness test battery, with SQL functions only.

Patterns give the base spans. The method looks at the other long runs of
``[A-Za-z0-9+/_-]`` (of ``CLASSES[0]`` characters or more; shorter ones are too
short for the tests): it infers each run's encoding (hex, base 32, base 64 or
letters and digits), and tests whether its characters look like uniform draws
from that alphabet: chi-squared uniformity and the share of capitals,
Wald-Wolfowitz runs (of characters above the alphabet's middle) and lag-one
serial correlation. The squared z-scores add up to one statistic, in bins: how
far a run is from random.

Secrets are the discoveries, so the null is that a run is ordinary. What the
statistic is for ordinary runs is measured, for each length class by itself: on
all words of every document, joined as identifiers are and cut without gaps into
runs of the classes by turns (so each word lies in one run), and on identifiers
made by a rule, for corpora with few words. A run's p-value is the
share of those that look as random as it does; Benjamini-Hochberg within the
length class, over all runs of the corpus, bounds the share of ordinary runs
among those that are added as ``random``.

Edge cases: null text is empty and has no spans. Repeated rows each get theirs.
Empty tables give none. Spans are in code points, end exclusive; spans that
start together are in the order of KINDS. Texts are scanned whole, however long.
Columns that are neither kept nor ``text`` are not read; kept columns may have
any name but ``base``, ``spans`` and ``runs``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsflow.llm.common import let, running, stage, table

#: Kinds as listed, with pattern and the test of a match.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
RUN = r"[A-Za-z0-9+/_-]{24,}"
#: A run as above, or (group 1) a word outside of those.
WORD = RUN + "|([A-Za-z0-9]+)"
KINDS = ("assign", "access", "hex", "random")
#: The order of characters within each encoding's alphabet.
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = {
    "hex": ("^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    "base32": ("^[A-Z2-7]+$", UPPER + "234567"),
    "lower": ("^[a-z0-9]+$", DIGITS + LOWER),
    "alnum": ("^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    "base64": (".", UPPER + LOWER + DIGITS + "+/"),
}
#: Length classes: lower ends.
CLASSES = (24, 32, 48, 64, 128)
#: A stretch of joined words that gives one run to each length class; what is left over makes the last one longer, or one of its own.
STRETCH = f".{{{sum(CLASSES)}}}(?:.{{1,{CLASSES[0] - 1}}}$)?|.+"
#: Histogram of the statistic: steps of a tenth in -log10 of its tail, all beyond the last in the last.
STEPS, LAST = 10, 300
#: Identifiers made by a rule for each length class.
MADE = 1000
#: Pairs of a run and a base span that are compared one by one.
FEW = 4096


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as (start, end, value), in code points.

    Matches and the pieces between them alternate, so places are running sums of lengths.
    """
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))

    def spans(p: Column) -> Column:
        found = p["found"]
        sizes = F.zip_with(F.slice(p["gaps"], F.lit(1), F.size(found)), found, lambda gap, value: F.length(gap) + F.length(value))
        return F.zip_with(running(sizes), found, lambda end, value: F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value")))

    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    return F.when(text.rlike(pattern), let(parts, spans)).otherwise(none)


def base_spans(text: Column) -> Column:
    """The patterns' spans as (start, kind, end), sorted; kind is a place in KINDS."""

    def of(kind: int, found: Column) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    value = lambda m: F.regexp_extract(m["value"], ASSIGN_VALUE, 1)
    assign = F.filter(matches(text, ASSIGN), lambda m: F.length(value(m)) >= 6)
    # A run of fewer characters than asked for fails as a whole, so the count can stand in the pattern.
    access = matches(text, ACCESS.replace("+", "{16,}"))
    hexes = matches(text, HEX.replace("+", "{24,}"))
    return F.array_sort(F.concat(of(0, assign), of(1, access), of(2, hexes)))


def tail_bin(run: Column) -> Column:
    """How far a run is from random: -log10 of the battery's tail in steps of a tenth.

    Four z-scores: uniformity over the alphabet, the share of its capitals, runs
    about its middle, and serial correlation at lag one. Their squares add up to
    a chi-squared of four degrees, whose tail is ``exp(-s/2) * (1 + s/2)``.
    """
    def known(letters: str) -> Column:
        """Of an alphabet, constants: its size, its share of capitals, and each ASCII character's distance from its middle."""
        places = [max(letters.find(chr(i)), 0) - (len(letters) - 1) / 2 for i in range(128)]
        return F.struct(F.lit(float(len(letters))).alias("m"), F.lit(sum(c in UPPER for c in letters) / len(letters)).alias("p"), F.array(*map(F.lit, places)).alias("places"))

    alphabet = known(ENCODINGS["base64"][1])
    for pattern, letters in [*ENCODINGS.values()][-2::-1]:
        alphabet = F.when(run.rlike(pattern), known(letters)).otherwise(alphabet)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)

    def score(lowered: Column, n: Column, of: Column, chars: Column, pairs: Column) -> Column:
        m, p = of["m"], of["p"]
        counts = F.transform(F.array_distinct(chars), lambda c: n - F.length(F.replace(lowered, c, F.lit(""))))
        squares = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x)
        uniform = (squares * m / n - n - (m - 1)) / F.sqrt(2 * (m - 1) * (n - 1) / n)
        crossing = (F.size(F.filter(pairs, lambda x: x < 0)) - (n - 1) / 2) / (F.sqrt(n - 1) / 2)
        serial = total(pairs) / ((m * m - 1) / 12) / F.sqrt(n - 1)
        spread = F.sqrt(n * p * (1 - p))
        capitals = F.when(spread > 0, (n - F.length(F.translate(lowered, UPPER, "")) - n * p) / F.greatest(spread, F.lit(1e-9))).otherwise(0.0)
        log10 = lambda half: (half - F.log1p(half)) / F.lit(2.302585092994046)
        sum_of_squares = F.aggregate(F.array(uniform, crossing, serial, capitals), F.lit(0.0), lambda a, z: a + z * z)
        return F.least(F.floor(let(sum_of_squares / 2, log10) * STEPS), F.lit(LAST)).cast("int")

    # Each step is bound before the next uses it, so that nothing is worked out again for every character.
    first = F.struct(F.when(run.rlike(ENCODINGS["hex"][0]), F.lower(run)).otherwise(run).alias("run"), F.length(run).cast("double").alias("n"), alphabet.alias("of"))
    chars = lambda x: F.struct(x.alias("x"), F.split(x["run"], "").alias("chars"))
    place = lambda y: F.struct(y.alias("y"), let(y["x"]["of"]["places"], lambda at: F.transform(y["chars"], lambda c: F.get(at, F.ascii(c)))).alias("place"))
    pairs = lambda z: F.struct(z["y"].alias("y"), F.zip_with(F.slice(z["place"], F.lit(1), F.size(z["place"]) - 1), F.slice(z["place"], F.lit(2), F.size(z["place"])), lambda a, b: a * b).alias("pairs"))
    return let(let(let(let(first, chars), place), pairs), lambda z: score(z["y"]["x"]["run"], z["y"]["x"]["n"], z["y"]["x"]["of"], z["y"]["chars"], z["pairs"]))


def _size(n: Column) -> Column:
    """The length class of ``n`` characters."""
    return sum(((n >= c).cast("int") for c in CLASSES[1:]), F.lit(0))


def joined_runs(docs: DataFrame) -> DataFrame:
    """(run): all words of every document's ``text`` but those in long runs, joined and cut into runs of the length classes.

    Nothing is left out but the words of a document with fewer than ``CLASSES[0]``
    characters of them, which can't fill a run, and no word is taken twice.
    """
    # By hash, a document is joined in one of three ways, and begins with one of the length classes.
    pick = F.xxhash64("text")
    words = F.array_remove(F.regexp_extract_all("text", F.lit(WORD), F.lit(1)), "")
    way = F.pmod(F.shiftright("pick", 4), F.lit(3))
    rows = docs.select(pick.alias("pick"), words.alias("words"))
    packed = F.array_join("words", "")
    rows = rows.select("pick", F.when(way == 0, F.array_join("words", "_")).when(way == 1, packed).otherwise(F.lower(packed)).alias("all"))
    rows = rows.select("pick", F.explode(F.regexp_extract_all("all", F.lit(STRETCH), F.lit(0))).alias("all"))
    turns = [[*CLASSES[i:], *CLASSES[:i]] for i in range(len(CLASSES))]
    pieces = F.array(*(F.array(*(F.struct(F.lit(sum(t[:i])).alias("start"), F.lit(t[i]).alias("length")) for i in range(len(t)))) for t in turns))
    left = lambda piece: F.length("all") - piece["start"] - piece["length"]
    piece = lambda p: F.substring("all", p["start"] + 1, p["length"] + F.when(left(p) < CLASSES[0], F.greatest(left(p), F.lit(0))).otherwise(0))
    runs = F.transform(F.get(pieces, F.pmod("pick", F.lit(len(CLASSES))).cast("int")), piece)
    return rows.select(F.explode(runs).alias("run")).where(F.length("run") >= CLASSES[0])


def ordinary(docs: DataFrame) -> DataFrame:
    """(size, bin, count) of ordinary runs: those of all documents' words, and identifiers made by a rule."""
    # Syllables from the digits of a hash; every seventh character ends a word, and digits end the whole.
    made = docs.sparkSession.range(MADE * len(CLASSES)).select(F.sha2(F.col("id").cast("string"), 512).alias("h"), F.element_at(F.array(*map(F.lit, CLASSES)), (F.pmod("id", F.lit(len(CLASSES))) + 1).cast("int")).alias("length"), F.pmod(F.col("id"), F.lit(3)).alias("way"))
    digit = lambda i: F.conv(F.substring(F.col("h"), i, F.lit(1)), 16, 10).cast("int") + 1
    letter = lambda i: F.when(i % 7 == 0, F.lit("_")).when(i > F.col("length") - 3, F.substring(F.lit("0123456789012345"), digit(i), F.lit(1))).when(i % 2 == 0, F.substring(F.lit("aeiouaeiouaeioua"), digit(i), F.lit(1))).otherwise(F.substring(F.lit("bcdfghjklmnprstv"), digit(i), F.lit(1)))
    name = F.array_join(F.transform(F.sequence(F.lit(1), F.col("length")), letter), "")
    name = F.when(F.col("way") == 0, name).when(F.col("way") == 1, F.replace(F.initcap(F.replace(name, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit("X"))).otherwise(F.replace(name, F.lit("_"), F.lit("-")))
    rows = joined_runs(docs).union(made.select(name.alias("run")))
    return rows.select(_size(F.length("run")).alias("size"), tail_bin(F.col("run")).alias("bin")).groupBy("size", "bin").count()


def _apart(runs: Column, base: Column) -> Column:
    """The runs that touch no base span.

    A few are compared with each other. Where both are many, a run asks for the
    base spans that start before its end, and for the furthest end of those.
    """
    free = lambda r: ~F.exists(base, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))

    def search(held: Column) -> Column:
        def before(r: Column) -> Column:
            """How many base spans start before the run's end, by halving."""
            low, high = lambda a: a["low"], lambda a: a["high"]
            middle = lambda a: F.shiftright(low(a) + high(a), 1)
            yes = lambda a: held["starts"][middle(a)] < r["end"]
            step = lambda a, _: F.when(low(a) >= high(a), a).when(yes(a), F.struct((middle(a) + 1).alias("low"), high(a).alias("high"))).otherwise(F.struct(low(a).alias("low"), middle(a).alias("high")))
            return F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.struct(F.lit(0).alias("low"), F.size(held["starts"]).alias("high")), step, low)

        return F.filter(runs, lambda r: let(before(r), lambda n: (n == 0) | (held["ends"][F.greatest(n, F.lit(1)) - 1] <= r["start"])))

    held = F.struct(F.transform(base, lambda b: b["start"]).alias("starts"), running(F.transform(base, lambda b: b["end"]), F.greatest).alias("ends"))
    few = F.size(runs).cast("long") * F.size(base) <= FEW
    return F.when(few, F.filter(runs, free)).otherwise(let(held, search))


def _random_upto(runs: dict[int, int], reference: dict[int, int], alpha: float) -> int:
    """Benjamini-Hochberg on histograms: the largest bin whose runs are all called random, or -1."""
    total, known = sum(runs.values()), sum(reference.values())
    most, as_low, found = -1, 0, 0
    for b in range(LAST):
        as_low += reference.get(b, 0)
        found += runs.get(b, 0)
        if found and (as_low + 1) / (known + 1) <= alpha * found / total:
            most = b
    return most


def scan(docs: DataFrame, keep: list[str], alpha: float = 0.01) -> DataFrame:
    """The columns ``keep`` of every document and ``spans``: sorted (start, kind, end)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*keep, base_spans(text).alias("base"), matches(text, RUN).alias("runs"))
    rows = rows.withColumn("runs", _apart(F.col("runs"), F.col("base")))
    rows = rows.withColumn("runs", F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), _size(r["end"] - r["start"]).alias("size"), tail_bin(r["value"]).alias("bin"))))
    rows = stage(rows, "secret-spans")
    # At most len(CLASSES) * (LAST + 1) rows each, whatever the corpus.
    counts = rows.select(F.explode("runs").alias("r")).groupBy("r.size", "r.bin").count().collect()
    reference = ordinary(docs.select(text.alias("text"))).collect()
    of = lambda found, c: {r["bin"]: r["count"] for r in found if r["size"] == c}
    most = F.array(*(F.lit(_random_upto(of(counts, c), of(reference, c), alpha)) for c in range(len(CLASSES))))
    passed = F.filter("runs", lambda r: r["bin"] <= F.element_at(most, r["size"] + 1))
    extra = F.transform(passed, lambda r: F.struct(r["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), r["end"].alias("end")))
    return rows.select(*keep, "base", F.array_sort(F.concat("base", extra)).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"), ["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
