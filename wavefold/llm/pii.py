"""Personal data in texts, by regular expressions, checksums and context, in column expressions only.

Patterns propose spans; validators confirm them (Luhn for cards, mod 97 for IBANs, ranges and digit counts for the
rest) and drop what fails; words near a span raise its score above that of its kind. Spans are in code points.

The patterns take the same matches as their plain forms, leftmost first, but never scan a run of characters twice and
use no recursion, so that very long runs cost time in proportion; so do very many matches, which are handled in runs.

Edge cases: null texts count as empty and have no spans; kinds may overlap each other, spans of one kind do not; each
row gives one row; columns of ``docs`` are kept, whatever their names, but for the one that is written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Plain forms, in the order of kinds: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+,
#: ip [0-9]+(\.[0-9]+){3}, card [0-9]([ -]?[0-9])+, phone \+[0-9][ ().0-9-]+[0-9], iban [A-Z]{2}[0-9]{2}( ?[A-Z0-9]){11,30}.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
}
#: A kind's pattern is tried only where this occurs.
NEEDS = {"email": "@", "phone": "+"}
#: Scores of confirmed spans, and what a context word within NEAR code points adds.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8}
CONTEXT = {
    "email": "mail|contact|write|reach",
    "ip": "address|server|host|login|client",
    "card": "card|visa|master|credit|debit|pay|cvc|cvv|expir",
    "phone": "phone|tel|call|mobile|fax|sms|whatsapp",
    "iban": "iban|account|bank|transfer|bic|swift",
}
NEAR, ADDS = 40, 0.2
#: No kind has matches of fewer than two code points, so that no more of them lie within NEAR on either side.
AROUND = NEAR // 2
#: Matches are handled in runs of so many, and texts to be masked cut into blocks of so many code points.
CHUNK, BLOCK = 256, 1024
KINDS = list(PATTERNS)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check: from the right, every second digit doubled and summed by digits."""
    at = F.sequence(F.lit(1), F.length(digits))
    value = lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
    term = lambda i: F.when(i % 2 == 0, F.when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2)).otherwise(value(i))
    return F.aggregate(at, F.lit(0), lambda s, i: s + term(i)) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an IBAN without spaces leaves 1: first four characters moved to the end, letters as 10 to 35."""
    moved = F.concat(F.substring(text, 5, 40), F.substring(text, 1, 4))
    code = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda s, c: F.when(c == "", s).otherwise((s * F.when(c >= "A", 100).otherwise(10) + code(c)) % 97)) == 1


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")) <= 3
        small = lambda p: F.when(part(p), F.regexp_replace(p, "^0+(?=[0-9])", "").cast("int") <= 255).otherwise(False)
        return F.forall(F.split(m, r"\."), small)
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(m, " ", ""))
    return F.lit(True)


def _lengths(matches: Column, gaps: Column) -> Column:
    """For each run of CHUNK matches, how many code points come before it."""
    n = F.size(matches)
    size = lambda i: F.element_at(gaps, i)["n"] + F.length(F.element_at(matches, i)["m"])
    run = lambda c: F.aggregate(_run(c, n), F.lit(0), lambda a, i: a + size(i))
    sums = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), run)
    zero = F.struct(F.lit(0).alias("to"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct((acc["to"] + x).alias("to"), F.array_append(acc["out"], acc["to"]).alias("out"))
    return F.aggregate(sums, zero, step, lambda acc: acc["out"])


def _run(c: Column, n: Column) -> Column:
    """Numbers (from 1) of the entries of run ``c``, of n in all."""
    return F.sequence(c * CHUNK + 1, F.least(n, (c + 1) * CHUNK))


def _spans(kind: str, matches: Column, gaps: Column, before: Column) -> Column:
    """Confirmed spans of one kind: array<struct<kind, start, end, score>>, by start. Matches are numbered off in runs of
    CHUNK, each behind the length before it, so that no list grows match by match."""
    none = F.array().cast("array<struct<start:int,end:int,i:int>>")

    def place(c: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["to"] + F.element_at(gaps, i)["n"]
            end = start + F.length(F.element_at(matches, i)["m"])
            span = F.struct(start.alias("start"), end.alias("end"), i.alias("i"))
            return F.struct(end.alias("to"), F.when(F.element_at(matches, i)["ok"], F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        zero = F.struct(F.element_at(before, c + 1).alias("to"), none.alias("out"))
        return F.aggregate(_run(c, F.size(matches)), zero, step, lambda acc: acc["out"])

    # the text around match i: gaps and matches next to it, of which only the ends are kept
    def near(i: Column) -> Column:
        some = lambda lo, hi: F.array_join(F.transform(F.filter(F.sequence(lo, hi), lambda j: j >= 1), lambda j: F.concat(F.coalesce(F.try_element_at(gaps, j)["ends"], F.lit("")), F.coalesce(F.try_element_at(matches, j)["ends"], F.lit("")))), "")
        left = F.concat(some(i - AROUND, i - 1), F.element_at(gaps, i)["ends"])
        return F.lower(F.concat(F.right(left, F.lit(NEAR)), F.lit(" "), F.left(some(i + 1, i + AROUND), F.lit(NEAR))))

    score = lambda i: F.lit(SCORES[kind]) + F.when(near(i).rlike(CONTEXT[kind]), ADDS).otherwise(0.0)
    placed = F.flatten(F.transform(F.sequence(F.lit(0), F.size(before) - 1), place))
    out = F.transform(placed, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score(s["i"]).alias("score")))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    return F.when(F.exists(matches, lambda m: m["ok"]), out).otherwise(empty)


def _ends(x: Column) -> Column:
    """A piece of text of which no more than both ends can be near a match."""
    return F.when(F.length(x) > 2 * NEAR, F.concat(F.left(x, F.lit(NEAR)), F.right(x, F.lit(NEAR)))).otherwise(x)


def find(docs: DataFrame, *, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """``docs`` with an array of (kind, start, end, score), by kind as listed and then by start, end exclusive."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    free = _free(docs.columns)
    cut, run = {}, {}
    for kind in KINDS:
        there = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9]")
        m = F.transform(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), lambda m: F.struct(m.alias("m"), _confirmed(kind, m).alias("ok"), _ends(m).alias("ends")))  # noqa: B023
        g = F.transform(F.split(text, PATTERNS[kind], -1), lambda g: F.struct(F.length(g).alias("n"), _ends(g).alias("ends")))
        cut[free(f"m_{kind}")], cut[free(f"g_{kind}")] = F.when(there, m).otherwise(F.array().cast("array<struct<m:string,ok:boolean,ends:string>>")), F.when(there, g).otherwise(F.array().cast("array<struct<n:int,ends:string>>"))
    for kind in KINDS:
        run[free(f"b_{kind}")] = F.when(F.size(free(f"m_{kind}")) > 0, _lengths(F.col(free(f"m_{kind}")), F.col(free(f"g_{kind}")))).otherwise(F.array().cast("array<int>"))
    found = docs.select("*", *(c.alias(n) for n, c in cut.items())).select("*", *(c.alias(n) for n, c in run.items()))
    spans = reduce(lambda a, b: F.concat(a, b), (_spans(k, F.col(free(f"m_{k}")), F.col(free(f"g_{k}")), F.col(free(f"b_{k}"))) for k in KINDS))
    return found.withColumn(out_col, spans).drop(*cut, *run)


def _free(columns: list[str]):
    """Names for columns in between that ``columns`` doesn't have."""
    mark = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in columns), default=0))
    return lambda name: mark + name


def redact(found: DataFrame, *, text_col: str = "text", pii_col: str = "pii", least: float = 0.5) -> DataFrame:
    """The texts with each span of at least that score replaced by its kind in brackets; overlapping ones are merged.
    The text is cut into blocks once, and each run of CHUNK spans reads only the blocks that it lies in."""
    free = _free(found.columns)
    spans, text, blocks, reach = (F.col(free(x)) for x in ("spans", "text", "blocks", "reach"))
    picked = F.array_sort(F.transform(F.filter(pii_col, lambda s: s["score"] >= least), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.upper(s["kind"]).alias("kind"))))
    rows = found.select("*", picked.alias(free("spans")), F.col(text_col).alias(free("text")))
    cut = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))
    # how far all spans before each run reach
    ends = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / CHUNK).cast("int")), lambda c: F.array_max(F.transform(_run(c, F.size(spans)), lambda i: F.element_at(spans, i)["end"])))
    step = lambda acc, x: F.array_append(acc, F.greatest(F.element_at(acc, -1), x))
    rows = rows.select("*", F.when(F.size(spans) > 0, cut).alias(free("blocks")), F.when(F.size(spans) > 0, F.aggregate(ends, F.array(F.lit(0)), step)).alias(free("reach")))

    def part(c: Column) -> Column:
        """What stands between the spans of a run, and their kinds."""
        begin, run = F.element_at(reach, c + 1), _run(c, F.size(spans))
        first = F.floor(begin / BLOCK).cast("int")
        last = F.floor(F.greatest(begin, F.element_at(spans, F.element_at(run, -1))["start"]) / BLOCK).cast("int")
        window = F.transform(F.array(F.array_join(F.slice(blocks, first + 1, last - first + 1), "")), lambda w: F.aggregate(run, F.struct(begin.alias("to"), F.array().cast("array<string>").alias("out")), lambda acc, i: one(acc, F.element_at(spans, i), w, first * BLOCK), lambda acc: F.array_join(acc["out"], "")))
        return F.element_at(window, 1)

    def one(acc: Column, s: Column, window: Column, at: Column) -> Column:
        piece = F.concat(F.substring(window, acc["to"] - at + 1, s["start"] - acc["to"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.greatest(acc["to"], s["end"]).alias("to"), F.when(s["start"] >= acc["to"], F.array_append(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    parts = F.array_join(F.transform(F.sequence(F.lit(0), F.size(reach) - 2), part), "")
    rest = F.substring(text, F.element_at(reach, -1) + 1, F.length(text))
    whole = F.when(F.size(spans) > 0, F.concat(parts, rest)).otherwise(text)
    return rows.withColumn(text_col, whole).drop(*(free(x) for x in ("spans", "text", "blocks", "reach")))
