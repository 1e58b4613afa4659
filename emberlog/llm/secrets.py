"""Secret scans: patterns, and sliding-window Shannon entropy over candidate strings.

Defined cases: a null text is an empty one; positions count code points, ends are exclusive; rows
that repeat are scanned each on its own; spans of one start are listed by kind; a text of any length
is scanned whole, in time in proportion to its length; an empty table gives an empty result; columns
other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

#: Candidate strings of the entropy scan: runs of the base64 and URL-safe alphabets.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: The characters of a candidate; a place in it is a character's number.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
WINDOW = 20
#: Character classes in order of choice: (name, pattern of the whole candidate, least bits in some window).
CLASSES = (("hex", r"^[0-9A-Fa-f]+$", 3.0), ("base36", r"^[0-9a-z]+$|^[0-9A-Z]+$", 3.5), ("base64", r"^[A-Za-z0-9+/_-]+$", 3.7))
#: Candidates that are no secrets: no digit, or no letter; UUIDs; sample values.
ALLOWED = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i)example|sample|placeholder|changeme|0123456789|abcdefgh|x{6}",
)
#: Nor are words or numbers joined by hyphens, underscores or slashes (paths, slugs): such a candidate
#: fits the first two of these patterns and not the third. None repeats a group, so none recurses.
JOINED = (r"^/?[A-Za-z0-9][A-Za-z0-9/_-]*[A-Za-z0-9]/?$", r"[A-Za-z0-9][/_-]+[A-Za-z0-9]", r"[A-Za-z][0-9]|[0-9][A-Za-z]")
#: The counts of a window are held in words of so many counters of so many bits.
COUNTERS, COUNTER_BITS = 12, 5


SPANS = "array<struct<start:int,end:int>>"
#: Texts are cut into so many pages to look for base spans near a place.
PAGES = 256


def _matches(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches, each with the length of the gap before it.

    Splitting at the pattern gives the gaps, extracting it the matches.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda gap: F.char_length(gap))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("match"))


def _spans(matches: Column, keep) -> Column:
    """Spans of the matches that ``keep``; the others still use up their characters.

    Positions are running sums of lengths. They are folded in blocks of the square root of the
    matches, and the blocks in turn, so no array that grows is copied at each match.
    """
    n = F.size(matches)
    width = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / width).cast("int") - 1, F.lit(0))), lambda k: F.slice(matches, k * width + 1, width))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.char_length(x["match"])
        span = F.struct(begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(keep(x["match"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, x: Column) -> Column:
        moved = F.transform(x["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end")))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    folded = F.transform(blocks, lambda b: F.aggregate(b, start, step))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out"))
    return F.aggregate(folded, none, block, lambda acc: F.flatten(acc["out"]))


def window_entropy(s: Column, width: int = WINDOW) -> Column:
    """The greatest Shannon entropy, in bits, of any window of ``width`` characters (31 at most) of a
    string over ``ALPHABET``.

    H = log2(n) - sum(c * log2(c)) / n. The state carries the counts of the window's characters, 5
    bits each, and the sum. A step takes one off the count of the character that leaves, adds one to
    that of the character that enters and renews these two terms, so the cost is in proportion to the
    string.
    """
    if width >= 1 << COUNTER_BITS:
        raise ValueError(f"a window has at most {(1 << COUNTER_BITS) - 1} characters")
    size = F.char_length(s)
    n = F.least(size, F.lit(width))
    term = [0.0 if c < 2 else c * math.log2(c) for c in range(width + 2)]
    gain = F.array(*(F.lit(b - a) for a, b in zip(term, term[1:])))  # of a count that goes up by one
    # A character's place: 64 * the word of its counter + the bit at which the counter begins.
    place = lambda c: (i := max(ALPHABET.find(chr(c)), 0)) // COUNTERS * 64 + i % COUNTERS * COUNTER_BITS
    places = F.array(*(F.lit(place(c)) for c in range(ord("+"), ord("z") + 1)))
    codes = F.transform(F.filter(F.split(s, ""), lambda ch: ch != ""), lambda ch: F.get(places, F.ascii(ch) - ord("+")))
    word, bit = (lambda c: F.shiftright(c, 6)), (lambda c: c.bitwiseAND(63))
    count = lambda counts, c: F.call_function("shiftright", F.get(counts, word(c)), bit(c)).bitwiseAND((1 << COUNTER_BITS) - 1).cast("int")
    one = lambda k, c: F.when(k == word(c), F.call_function("shiftleft", F.lit(1).cast("long"), bit(c))).otherwise(F.lit(0).cast("long"))
    state = lambda counts, sum_, least: F.struct(counts.alias("counts"), sum_.alias("sum"), least.alias("least"))

    def enter(acc: Column, c: Column) -> Column:
        return state(F.transform(acc["counts"], lambda x, k: x + one(k, c)), acc["sum"] + F.get(gain, count(acc["counts"], c)), acc["least"])

    def step(acc: Column, move: Column) -> Column:
        out, into = move["out"], move["into"]
        sum_ = acc["sum"] - F.get(gain, count(acc["counts"], out) - 1) + F.get(gain, count(acc["counts"], into))
        counts = F.transform(acc["counts"], lambda x, k: x - one(k, out) + one(k, into))
        return F.when(out == into, acc).otherwise(state(counts, sum_, F.least(acc["least"], sum_)))

    empty = state(F.array(*[F.lit(0).cast("long")] * -(-len(ALPHABET) // COUNTERS)), F.lit(0.0), F.lit(0.0))
    first = F.aggregate(F.slice(codes, F.lit(1), n), empty, enter, lambda acc: state(acc["counts"], acc["sum"], acc["sum"]))
    moves = F.arrays_zip(F.slice(codes, F.lit(1), size - n).alias("out"), F.slice(codes, n + 1, size - n).alias("into"))
    least = F.aggregate(moves, first, step, lambda acc: acc["least"])
    return F.round(F.log2(n.cast("double")) - least / n, 6)


def _suspicious(s: Column) -> Column:
    """Whether a candidate is dense enough for its character class and on no allow-list."""
    allowed = s.rlike(JOINED[0]) & s.rlike(JOINED[1]) & ~s.rlike(JOINED[2])
    for p in ALLOWED:
        allowed = allowed | s.rlike(p)
    need = F.lit(None).cast("double")
    for _, pattern, bits in reversed(CLASSES):
        need = F.when(s.rlike(pattern), F.lit(bits)).otherwise(need)
    # A case expression keeps the windows from being computed for what is allowed.
    return F.when(allowed, F.lit(False)).otherwise(F.coalesce(window_entropy(s) >= need, F.lit(False)))


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans.

    The entropy scan adds spans of kind ``entropy`` for candidates that overlap no base span.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    gated = lambda pattern, gate: F.when(text.rlike(gate), _matches(text, pattern)).otherwise(F.array().cast("array<struct<gap:int,match:string>>"))
    any_match = lambda whole: F.lit(True)
    long_value = lambda whole: F.char_length(F.regexp_extract(whole, ASSIGN, 2)) >= 12
    # A run of 16 hex digits or of AKIA and 14 more holds its whole match, so shorter ones need no visit.
    d = docs.select(
        "doc_id",
        F.char_length(text).alias("chars"),
        gated(ASSIGN, ASSIGN).alias("assign"),
        gated(ACCESS[:-1] + "{14,}", "AKIA[A-Z0-9]{14}").alias("access"),
        gated(HEX[:-1] + "{16,}", "[0-9a-f]{16}").alias("hex"),
        gated(CANDIDATE, CANDIDATE).alias("entropy"),
    )
    kinds = {"assign": long_value, "access": any_match, "hex": any_match, "entropy": _suspicious}
    d = d.select("doc_id", "chars", *(_spans(F.col(k), keep).alias(k) for k, keep in kinds.items()))
    # Base spans by page, where there are candidates to hold against them.
    width = F.greatest(F.ceil(F.col("chars") / PAGES).cast("int"), F.lit(64))
    base = F.concat("assign", "access", "hex")
    on_page = lambda p: F.filter("base", lambda s: (s["start"] < (p + 1) * F.col("page")) & (s["end"] > p * F.col("page")))
    needed = (F.size("entropy") > 0) & (F.size("base") > 0)
    d = d.withColumn("base", base).withColumn("page", width).withColumn("pages", F.when(needed, F.transform(F.sequence(F.lit(0), F.lit(PAGES)), on_page)))

    def free(e: Column) -> Column:
        first, last = (e["start"] / F.col("page")).cast("int"), ((e["end"] - 1) / F.col("page")).cast("int")
        return ~F.exists(F.slice("pages", first + 1, last - first + 1), lambda page: F.exists(page, lambda s: (s["start"] < e["end"]) & (e["start"] < s["end"])))

    d = d.withColumn("entropy", F.when(F.col("pages").isNull() | (F.size("pages") == 0), F.col("entropy")).otherwise(F.filter("entropy", free)))
    rank = {k: n for n, k in enumerate(kinds)}
    tagged = lambda k: F.transform(k, lambda s: F.struct(s["start"].alias("start"), F.lit(rank[k]).alias("kind"), F.concat(F.lit(k + ":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")).alias("name")))
    joined = lambda *of: F.array_join(F.transform(F.sort_array(F.concat(*map(tagged, of))), lambda s: s["name"]), ",")
    return d.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in rank),
        F.sha2(joined("assign", "access", "hex"), 256).alias("base_sha256"),
        joined(*rank).alias("spans"),
    )
