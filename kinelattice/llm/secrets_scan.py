"""Secret scans in DataFrame expressions only.

Base patterns find assigned credentials, access keys and hexadecimal runs. A battery of randomness tests looks at
every other token of 12 characters or more: its encoding is inferred, then three tests are taken, each of which has a
small p-value where the token looks like chance and not like text of that encoding:

* chi-squared for the uniformity of the alphabet, against the least deviation that text has;
* runs of character classes: lower case, upper case, digits and others (base 64), digits and letters (hexadecimal, base
  36), vowels and consonants (letters, base 32), small and large (digits). Words and names change class seldom, vowels
  and consonants alternate; chance does neither. The number of changes is held against a rate that text keeps to;
* serial correlation at lag 1 of three levels: vowels and separators, digits, consonants. In text the levels alternate, so
  it is negative; for digits (even or odd) and hexadecimal (halves) only its size counts.

Their z values are added with the weights ``WEIGHTS`` and their correlation in text (``CORRELATION``) to one z of a token, so each
test can both add to the evidence and outweigh that of the others. The combined p-values go into the false-discovery
control. Short tokens carry little evidence, so the control is length-aware: Benjamini-Hochberg runs over all tokens of
the corpus within each encoding and length band, from counts of binned p-values. A token whose letters are clearly as
uneven as text's (z of uniformity over ``GATE``) is no candidate. Everything else is decided row by row, without a shuffle.

Normal tails have a relative error under 2e-7 at any distance. Work per text grows with its length and, for running sums
over its spans, with their number to the power of 1.5 at most.

Positions are code points, end exclusive. Edge cases: a null or empty text has no spans; repeated rows get equal
answers; an empty table gives no rows; spans of the method that overlap a base span are left to the base span; ties in
p-values are found together or not at all; a very long text is one row and scanned whole; other columns stay (names that
begin with ``_kl_`` are the module's own).
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelattice.session import cut

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
_ACCESS = r"AKIA[A-Z0-9]{14,}"
_HEX, _HEX_LETTERS = r"[0-9a-f]", "0123456789abcdef"
_TOKEN, _TOKEN_LETTERS = r"[A-Za-z0-9+/_=-]", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_="
#: Inferred encodings, the first that fits: pattern, alphabet, least deviation from uniformity per character of text
#: that is not random (k * sum of squared letter shares - 1, for prose or numbers in that alphabet, halved), then the
#: rate of class changes that text stays below (or, negative, above) and the serial correlation that it stays below
#: (0: of either sign and half as large at least). The rates lie between those of text and of chance, measured on
#: words, identifiers, paths and numbers: base 64 0.37 and 0.65, letters 0.65 and 0.3, base 36 0.2 and 0.4.
ENCODINGS = (
    ("digits", r"^[0-9]+$", "0123456789", 0.4, 0.42, 0.0),
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.5, 0.3, 0.0),
    ("letters", r"^([a-z]+|[A-Z]+)$", "abcdefghijklmnopqrstuvwxyz", 0.5, -0.45, -0.25),
    ("base32", r"^[A-Z2-7]+=*$", "abcdefghijklmnopqrstuvwxyz234567=", 0.6, -0.45, -0.25),
    ("base36", r"^([a-z0-9]+|[A-Z0-9]+)$", "0123456789abcdefghijklmnopqrstuvwxyz", 0.8, 0.27, -0.15),
    ("base64", r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_=", 1.5, 0.45, -0.2),
)
_VOWELS = "aeiouyAEIOUY"


def _class(encoding: str, c: str) -> str:
    if encoding == "digits":
        return "a" if c < "5" else "b"
    if encoding in ("letters", "base32"):
        return "a" if c in _VOWELS else "b"
    return "c" if c.isdigit() else "a" if c.islower() else "b" if c.isupper() else "d"


def _level(encoding: str, c: str) -> str:
    if encoding in ("digits", "hex"):
        at = int(c, 16)
        return "2" if (at % 2 if encoding == "digits" else at > 7) else "0"
    return "0" if c in _VOWELS or not c.isalnum() else "1" if c.isdigit() else "2"


#: For each encoding, what stands for the characters of its alphabet in the runs test and in the serial test.
CLASSES, LEVELS = (tuple("".join(f(x[0], c) for c in x[2]) for x in ENCODINGS) for f in (_class, _level))
#: Weights of the tests' z values in the order uniformity, runs, serial, and their correlation in text.
WEIGHTS, CORRELATION, GATE = (1.0, 0.8, 0.4), 0.2, 0.5
P_BINS, P_STEP = 320, 0.05
#: Characters of a segment of a text that is put together again.
SEGMENT = 4096
#: A Chebyshev fit of log(erfc(x) * exp(x * x) / t) in t = 1 / (1 + x / 2): fixed values, from the constant term on.
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


_SPANS = "array<struct<start:int,end:int,hit:string>>"


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, add) -> Column:
    """Running totals (sums, or whatever ``add`` joins) of an array.

    Appending copies an array, so totals are made within blocks of about the square root of its size, then over blocks.
    """

    def within(part: Column) -> Column:
        return F.aggregate(F.slice(part, 2, F.size(part)), F.slice(part, 1, 1), lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x))))

    def of(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        return _let(F.transform(F.sequence(F.lit(1), F.size(v), width), lambda s: within(F.slice(v, s, width))), over)

    def over(blocks: Column) -> Column:
        ends = within(F.transform(blocks, lambda x: F.element_at(x, -1)))
        return _let(ends, lambda e: F.flatten(F.transform(blocks, lambda x, k: F.when(k == 0, x).otherwise(F.transform(x, lambda y: add(F.get(e, k - 1), y))))))

    return _let(values, lambda v: F.when(F.size(v) < 2, v).otherwise(of(v)))


def _found(text: Column, pattern: str, valid=None) -> Column:
    """Spans of the matches of ``pattern``: array of (start, end, hit), leftmost and non-overlapping.

    Each match is taken together with the gap before it; lengths of gaps and matches add up to positions. ``\\z`` ends
    the last gap, so that the text is scanned once.
    """
    whole = F.lit(rf"(?s)(.*?)({pattern}|\z)")
    gaps = F.transform(F.regexp_extract_all(text, whole, F.lit(1)), lambda g: F.length(g))
    pairs = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, whole, F.lit(2)).alias("hit"))

    def spans(pairs: Column) -> Column:
        ends = _running(F.transform(pairs, lambda p: p["gap"] + F.length(p["hit"])), lambda a, b: a + b)
        every = F.zip_with(ends, pairs, lambda e, p: F.struct((e - F.length(p["hit"])).alias("start"), e.alias("end"), p["hit"].alias("hit")))
        return F.filter(every, lambda s: (F.length(s["hit"]) > 0) & (F.lit(True) if valid is None else valid(s["hit"])))

    return _let(pairs, spans)


def _long_runs(text: Column, letter: str, letters: str, least: int) -> Column:
    """Spans of the runs of at least ``least`` of the ``letters``: as ``_found``, in one pass.

    A run is tried at its first letter only. Each run comes with the gap before it and is all that its letters trim off.
    """
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).*?(?:(?<!{letter}){letter}{{{least},}}|\z)"), F.lit(0))

    def spans(pieces: Column) -> Column:
        ends = _running(F.transform(pieces, F.length), lambda a, b: a + b)
        hit = lambda p: F.substring(p, F.length(F.rtrim(p, F.lit(letters))) + 1, F.length(p))
        every = F.zip_with(ends, F.transform(pieces, hit), lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("hit")))
        return F.filter(every, lambda s: F.length(s["hit"]) >= least)

    return _let(pieces, spans)


def _if(could: Column, spans: Column) -> Column:
    """``spans`` where a cheap necessary condition holds."""
    return F.when(could, spans).otherwise(_none(_SPANS))


def phi(z: Column) -> Column:
    """The normal distribution function, to a relative error of 2e-7 in its lower tail."""

    def tail(x: Column) -> Column:  # at -x * sqrt(2), x >= 0
        def of(t: Column) -> Column:
            power = F.lit(_ERFC[-1])
            for c in _ERFC[-2::-1]:
                power = power * t + F.lit(c)
            return t * F.exp(power - x * x) / 2

        return _let(1 / (1 + x / 2), of)

    return F.when(z <= 0, _let(-z / F.sqrt(F.lit(2.0)), tail)).otherwise(1 - _let(z / F.sqrt(F.lit(2.0)), tail))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _uniform(body: Column, letters: Column, n: Column, k: Column, least: Column) -> Column:
    """z of Pearson's statistic among those of texts with the least deviation (non-central), by their cube roots."""
    squares = _sum(F.transform(letters, lambda c: F.pow(n - F.length(F.replace(body, c, F.lit(""))), F.lit(2.0))))
    mean = k - 1 + n * least
    spread = 2.0 / 9 * (k - 1 + 2 * n * least) / (mean * mean)
    return (F.cbrt((k * squares / n - n) / mean) - 1 + spread) / F.sqrt(spread)


def _count(text: Column, part: str) -> Column:
    """Occurrences of a string that can't overlap itself."""
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def _runs(runs: Column, n: Column, rate: Column) -> Column:
    """z of the class changes against a rate that text stays below, or above where it is negative; small for chance."""
    m = F.abs(rate)
    return F.signum(rate) * (m - (F.length(runs) - 1) / (n - 1)) * F.sqrt((n - 1) / (m * (1 - m)))


def _serial(levels: Column, runs: Column, n: Column, least: Column) -> Column:
    """z of the lag-1 correlation of levels 0, 1/2 and 1, from counts of levels and of neighbours; small for chance.

    Equal neighbours are those inside runs, unequal ones those that follow each other when runs are one character.
    """
    value = lambda c: c.cast("double") / 2
    ones, twos = _count(levels, "1"), _count(levels, "2")
    total, squares = ones / 2 + twos, ones / 4 + twos
    products = (ones - _count(runs, "1")) / 4 + twos - _count(runs, "2") + (_count(runs, "12") + _count(runs, "21")) / 2
    mean = total / n
    ends = value(F.substring(levels, 1, 1)) + value(F.substring(levels, -1, 1))
    r = F.coalesce(F.try_divide(products - mean * (2 * total - ends) + (n - 1) * mean * mean, squares - n * mean * mean), F.lit(1.0))
    return F.when(least == 0, F.abs(r + 1 / n) - 0.5).otherwise(least - r) * F.sqrt(n)


def battery(token: Column) -> Column:
    """(encoding, uniform, runs, serial, random): the inferred encoding, from 1, the three tests' z values and the token's p-value.

    Runs and serial are NULL, and the p-value 1, for a token that is no candidate.
    """
    encoding = F.lit(len(ENCODINGS))
    for k in range(len(ENCODINGS) - 2, -1, -1):
        encoding = F.when(token.rlike(ENCODINGS[k][1]), F.lit(k + 1)).otherwise(encoding)
    of = lambda e, values: F.element_at(F.array(*map(F.lit, values)), e)
    number = lambda e, values: of(e, [float(v) for v in values])
    same = F.lit(r"(.)\1+")

    def judged(e: Column) -> Column:
        letters = F.element_at(F.array(*(F.array(*map(F.lit, x[2])) for x in ENCODINGS)), e)
        k, least, rate, serial = (number(e, values) for values in ([len(x[2]) for x in ENCODINGS], *([x[j] for x in ENCODINGS] for j in (3, 4, 5))))
        n = F.length(token).cast("double")

        def tests(body: Column) -> Column:
            shown = lambda names: F.call_function("translate", body, of(e, [x[2] for x in ENCODINGS]), of(e, names))
            answer = lambda u, r, s, p: F.struct(e.alias("encoding"), u.alias("uniform"), r.alias("runs"), s.alias("serial"), p.alias("random"))
            spread = sum(a * b * (1.0 if i == j else CORRELATION) for i, a in enumerate(WEIGHTS) for j, b in enumerate(WEIGHTS)) ** 0.5
            combined = lambda z: phi(sum(w * z[c] for w, c in zip(WEIGHTS, "urs")) / spread)

            def rest(u: Column) -> Column:
                runs = _runs(F.regexp_replace(shown(CLASSES), same, F.lit("$1")), n, rate)
                z = _let(shown(LEVELS), lambda x: F.struct(u.alias("u"), runs.alias("r"), _serial(x, F.regexp_replace(x, same, F.lit("$1")), n, serial).alias("s")))
                return _let(z, lambda z: answer(z["u"], z["r"], z["s"], combined(z)))

            none = F.lit(None).cast("double")
            return _let(_uniform(body, letters, n, k, least), lambda u: F.when(u > GATE, answer(u, none, none, F.lit(1.0))).otherwise(rest(u)))

        return _let(F.when(e == len(ENCODINGS), token).otherwise(F.lower(token)), tests)  # all others are of one case

    return _let(encoding, judged)


def _tested(span: Column) -> Column:
    """(start, end, stratum, bin) of one token."""

    def judged(b: Column) -> Column:
        p = F.greatest(b["random"], F.lit(1e-300))
        at = F.least(F.floor(-F.log10(p) / P_STEP), F.lit(P_BINS - 1)).cast("int")
        stratum = (b["encoding"] * 32 + F.floor(F.log2(F.length(span["hit"]).cast("double")))).cast("int")
        return F.struct(span["start"].alias("start"), span["end"].alias("end"), stratum.alias("stratum"), at.alias("bin"))

    return _let(battery(span["hit"]), judged)


def _free(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no base span: both in one order, compared with what ends before and what follows."""
    event = lambda x, kind, hit: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), hit.alias("hit"))
    both = F.array_sort(F.concat(F.transform(base, lambda b: event(b, 0, F.lit(None).cast("string"))), F.transform(tokens, lambda t: event(t, 1, t["hit"]))))

    def of(events: Column) -> Column:
        reach = _running(F.transform(events, lambda x: F.when(x["kind"] == 0, x["end"]).otherwise(0)), F.greatest)
        after = F.transform(F.slice(events, 2, F.size(events)), lambda x: F.when(x["kind"] == 0, x["start"]))
        rows = F.arrays_zip(events.alias("token"), reach.alias("reach"), after.alias("after"))
        clear = lambda r: (r["token"]["kind"] == 1) & (r["reach"] <= r["token"]["start"]) & F.coalesce(r["after"] >= r["token"]["end"], F.lit(True))
        return F.transform(F.filter(rows, clear), lambda r: F.struct(r["token"]["start"].alias("start"), r["token"]["end"].alias("end"), r["token"]["hit"].alias("hit")))

    return F.when((F.size(base) == 0) | (F.size(tokens) == 0), tokens).otherwise(_let(both, of))


def _kind(spans: Column, k: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with _kl_base, the base spans as array of (start, kind, end) in order, and _kl_tokens, the tested tokens."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = F.lower(text)
    assign = _if(
        plain.contains("passw") | plain.contains("secret") | plain.contains("token") | plain.contains("api"),
        _found(text, _ASSIGN, lambda hit: F.length(F.regexp_extract(hit, _ASSIGN, 2)) >= 12),
    )
    access = _if(text.contains("AKIA"), _found(text, _ACCESS))
    hexes = _if(text.rlike(rf"{_HEX}{{16}}"), _long_runs(text, _HEX, _HEX_LETTERS, 16))
    base = F.array_sort(F.concat(_kind(assign, 1), _kind(access, 2), _kind(hexes, 3)))
    out = docs.withColumn("_kl_base", base).withColumn("_kl_found", _long_runs(text, _TOKEN, _TOKEN_LETTERS, 12))
    return out.withColumn("_kl_tokens", F.transform(_free(F.col("_kl_found"), F.col("_kl_base")), _tested)).drop("_kl_found")


def thresholds(scanned: DataFrame, q: float = 0.05) -> dict[int, int]:
    """For each stratum the least p-bin at which the expected share of false discoveries is at most ``q``, under 0.5."""
    if not 0 < q < 0.5:
        raise ValueError(f"q is {q}; it must be between 0 and 0.5")
    rows = scanned.select(F.explode("_kl_tokens").alias("t")).groupBy("t.stratum", "t.bin").count().collect()  # strata x P_BINS rows at most
    counts: dict[int, list[int]] = defaultdict(lambda: [0] * P_BINS)
    for r in rows:
        counts[r["stratum"]][r["bin"]] += r["count"]
    out = {}
    for stratum, n in counts.items():
        total, above = sum(n), 0
        for b in range(P_BINS - 1, -1, -1):
            above += n[b]
            if above and total * 10.0 ** (-b * P_STEP) <= q * above:
                out[stratum] = b
    return out


def with_spans(scanned: DataFrame, found: dict[int, int]) -> DataFrame:
    """Adds _kl_spans: base and random spans as array of (start, kind, end) in order."""
    more = _none("array<struct<start:int,kind:int,end:int>>")
    if found:
        least = F.create_map(*(F.lit(x) for pair in sorted(found.items()) for x in pair))
        more = _kind(F.filter("_kl_tokens", lambda t: F.coalesce(t["bin"] >= F.try_element_at(least, t["stratum"]), F.lit(False))), 4)
    return scanned.withColumn("_kl_spans", F.array_sort(F.concat("_kl_base", more)))


def _joined(spans: str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = 0.05) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).drop("text")
    rows = cut(rows, "secrets")
    of = lambda k: F.size(F.filter("_kl_base", lambda s: s["kind"] == k)).cast("bigint")
    out = with_spans(rows, thresholds(rows, q))
    return out.select("doc_id", of(1).alias("n_assign"), of(2).alias("n_access"), of(3).alias("n_hex"), F.sha2(_joined("_kl_base"), 256).alias("base_sha256"), _joined("_kl_spans").alias("spans"))


def _piece(segments: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` to ``end`` of a text that is cut into segments."""
    part = lambda k: F.substring(F.get(segments, k), F.greatest(start - k * SEGMENT, F.lit(0)) + 1, F.least(end - k * SEGMENT, F.lit(SEGMENT)) - F.greatest(start - k * SEGMENT, F.lit(0)))
    inside = F.sequence(F.floor(start / SEGMENT).cast("int"), F.floor((F.greatest(end, F.lit(1)) - 1) / SEGMENT).cast("int"))
    return F.when(start >= end, F.lit("")).otherwise(F.array_join(F.transform(inside, part), ""))


def redact(docs: DataFrame, q: float = 0.05, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mark`` (overlapping spans by one) and n_chars to match.

    Every text is scanned once: the rows go to a table with what was found in them. The text is put together from
    pieces, so the work does not grow with spans times length.
    """
    rows = cut(scan(docs), "secret-scan")
    rows = with_spans(rows, thresholds(rows, q))
    text = F.coalesce(F.col("text"), F.lit(""))

    def clean(segments: Column, reach: Column) -> Column:
        steps = F.arrays_zip(F.col("_kl_spans").alias("span"), F.concat(F.array(F.lit(0)), reach).alias("at"))
        fresh = F.filter(steps, lambda x: x["span"]["start"] >= x["at"])
        kept = F.transform(fresh, lambda x: F.concat(_piece(segments, x["at"], x["span"]["start"]), F.lit(mark)))
        return F.array_join(F.concat(kept, F.array(_piece(segments, F.element_at(reach, -1), F.length(text)))), "")

    reach = _running(F.transform("_kl_spans", lambda s: s["end"]), F.greatest)
    whole = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{SEGMENT}}}"), F.lit(0))
    hit = F.size("_kl_spans") > 0
    rows = rows.withColumn("_kl_text", F.when(hit, _let(whole, lambda x: _let(reach, lambda r: clean(x, r)))).otherwise(F.col("text")))
    own = {"text": F.col("_kl_text"), "n_chars": F.when(hit, F.length("_kl_text").cast("bigint")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*(own[c].alias(c) if own.get(c) is not None else F.col(c) for c in docs.columns))
