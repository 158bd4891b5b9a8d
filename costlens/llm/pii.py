"""Operator 2: personal data, in DataFrame functions only.

Regular expressions propose spans, checksums (Luhn, mod 97) and ranges confirm
them, and words near a span raise or lower its score.  Matches of a pattern
are found once per text: `split` gives the gaps and `regexp_extract_all` the
matches between them, so a running sum of lengths gives every start and end in
code points.

The patterns run in linear time on long runs: loops are possessive, and an
attempt begins only where a run begins or the last match ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens.llm.common import free_name, text_or_empty

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
KEEP = 0.5  # spans of the added kinds below this score are dropped
NEAR = 40  # code points before and after a span that are read for context words

# Lengths of international bank account numbers by country (the IBAN registry).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27,
    "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23,
    "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21,
    "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22,
    "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
_IBAN = "|".join(
    rf"(?:{'|'.join(c for c, n in IBAN_LENGTHS.items() if n == length)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{length - 4}}}"
    for length in sorted(set(IBAN_LENGTHS.values()))
)
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    # runs of fewer than 12 digits can't be cards and are not listed
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # the country code alone is taken, with the whole number ahead as group 1: a wrong one can't hide the next
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=({_IBAN}))[A-Z]{{2}}",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A cheap test that a text may hold the kind at all.
_MAY_HOLD = {"email": "@", "phone": "+"}

PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
WORDS_FOR = {
    "email": r"\b(?:e-?mail|contact|write to|mailto)\b",
    "ip": r"\b(?:ip|address|host|server|login)\b",
    "card": r"\b(?:card|visa|mastercard|amex|credit|payment)\b",
    "phone": r"\b(?:phone|tel|call|mobile|fax|cell)\b",
    "iban": r"\b(?:iban|account|bank|transfer)\b",
    "ssn": r"\b(?:ssn|social security|tax id)\b",
}
#: What may stand between the numbers of a list, which share their context words.
LISTED = r"(?i)^[\s,;:/|&+*.-]*(?:(?:and|or)\b[\s,;:/|&+*.-]*)?$"
WORDS_AGAINST = r"\b(?:version|release|isbn|order|invoice|model|serial)\b"

_SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right Luhn check digit."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        v = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = v * 2 - F.when(v > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether a bank account number (letters and digits, no spaces) leaves 1 on division by 97."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code <= 57, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _taken(kind: str, hit: Column) -> Column:
    """How many code points of a hit the search has gone on by."""
    return F.lit(2) if kind == "iban" else F.length(hit)


def _checked(kind: str, hit: Column) -> Column:
    """Whether a proposed span is confirmed."""
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
        return hit.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        digits = _digits(hit)
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(hit, F.lit(" ")))
    if kind == "ssn":
        return ~hit.rlike("^(?:000|666|9)") & ~hit.rlike("-00-|-0000$")
    return F.lit(True)


def fold(items: Column, kind: str, step, start: Column | None = None) -> Column:
    """struct<pos, out>: runs `step(pos, item) -> (pos, array of results)` over an array column, results end to end.

    `items` must be a plain column; pos begins as `start`, or 0.  Groups of 512
    items are folded one by one and joined at the end, so that no long array is
    copied for every item.
    """
    start = F.lit(0) if start is None else start
    size = 512
    none = F.array().cast(f"array<{kind}>")

    def one(s: Column, x: Column) -> Column:
        pos, out = step(s["pos"], x)
        return F.struct(pos.alias("pos"), F.concat(s["out"], out).alias("out"))

    def group(s: Column, g: Column) -> Column:
        inner = F.aggregate(g, F.struct(s["pos"].alias("pos"), none.alias("out")), one)
        joined = F.transform(
            F.array(inner),
            lambda r: F.struct(r["pos"].alias("pos"), F.concat(s["out"], F.array(r["out"])).alias("out")),
        )
        return joined[0]

    last = F.floor((F.size(items) - 1) / size).cast("int")
    groups = F.transform(F.sequence(F.lit(0), last), lambda g: F.slice(items, g * size + 1, F.lit(size)))
    zero = F.struct(start.alias("pos"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    done = F.aggregate(
        F.when(F.size(items) > 0, groups),
        zero,
        group,
        lambda s: F.struct(s["pos"].alias("pos"), F.flatten(s["out"]).alias("out")),
    )
    return F.coalesce(done, F.struct(start.alias("pos"), none.alias("out")))


def _pairs(text: Column, kind: str) -> Column:
    """array<struct<gap, hit>> of one kind: each match after the text before it; a last gap without a match."""
    pattern, group = PATTERNS[kind], int(kind == "iban")
    may = F.contains(text, F.lit(_MAY_HOLD[kind])) if kind in _MAY_HOLD else F.lit(True)
    return F.when(
        may & text.rlike(pattern),
        F.arrays_zip(
            F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("hit")
        ),
    ).otherwise(F.array().cast("array<struct<gap:string,hit:string>>"))


def _near(pairs: Column, kind: str, after: bool) -> Column:
    """array<boolean>: whether a context word for `kind` is near each match of a plain column of pairs, on one side.

    `after` says which side, and the pairs come last to first for it.  The text
    of that side is read whatever matched there.  The numbers of a list, with
    no more than separators between them, share the words of its first and last.
    """
    state = F.struct(
        F.lit("").alias("side"), F.lit("").alias("gap"), F.lit(0).alias("over"), F.lit(False).alias("near")
    )
    reach = NEAR + max(IBAN_LENGTHS.values()) * 2  # a hit may go on in the gap after it

    def step(s: Column, x: Column) -> tuple[Column, Column]:
        gap, hit = x["gap"], F.coalesce(x["hit"], F.lit(""))
        taken = F.substring(hit, F.lit(1), _taken(kind, hit))
        over = F.length(hit) - F.length(taken)
        if after:
            side, between = F.substring(s["side"], over + 1, F.lit(NEAR)), F.substring(s["gap"], over + 1, F.length(s["gap"]))
        else:
            side = F.right(F.concat(s["side"], gap), F.lit(NEAR))
            between = F.substring(gap, s["over"] + 1, F.length(gap))
        listed = between.rlike(LISTED)
        near = F.lower(side).rlike(WORDS_FOR[kind]) | (s["near"] & listed)
        side = F.left(F.concat(gap, taken, s["side"]), F.lit(reach)) if after else F.concat(side, taken)
        near = F.when(x["hit"].isNull(), False).otherwise(near)
        return F.struct(side.alias("side"), gap.alias("gap"), over.alias("over"), near.alias("near")), F.array(near)

    return fold(pairs, "boolean", step, state)["out"]


def _spans(items: Column, kind: str) -> Column:
    """array<span> of one kind from array<struct<gap, hit, before, after>>."""
    none = F.array().cast(f"array<{_SPAN}>")
    rank = KINDS.index(kind) + 1

    def step(s: Column, x: Column) -> tuple[Column, Column]:
        start = s["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        good = _checked(kind, x["hit"]) & (start >= s["end"])
        # Words against are read since the last match only, as they speak of one number.
        against = F.lower(F.right(x["gap"], F.lit(NEAR))).rlike(WORDS_AGAINST)
        score = (
            F.lit(PRIOR[kind])
            + F.when(x["before"] | x["after"], 0.3).otherwise(0.0)
            - F.when(against, 0.2).otherwise(0.0)
        )
        score = F.round(F.least(F.lit(1.0), score), 2)
        if kind not in BASE:
            good = good & (score >= KEEP)
        span = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"),
            score.alias("score"),
        )
        good = F.when(x["hit"].isNull(), False).otherwise(good)
        at = start + F.coalesce(_taken(kind, x["hit"]), F.lit(0))
        state = F.struct(at.alias("at"), F.when(good, end).otherwise(s["end"]).alias("end"))
        return state, F.when(good, F.array(span)).otherwise(none)

    return fold(items, _SPAN, step, F.struct(F.lit(0).alias("at"), F.lit(0).alias("end")))["out"]


def add_spans(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """`docs` with `out`: array of (start, rank, end, kind, score) by start, then kind.

    Starts and ends are code points of the text, the end exclusive.  Base kinds
    keep every confirmed match whatever its score; added kinds need `KEEP`.  A
    null or empty text has no spans.  Spans of different kinds may overlap.
    """
    names = {k: free_name(docs, {out}, f"_{k}") for k in KINDS}
    t = text_or_empty(text)
    pairs = docs.select("*", *[_pairs(t, k).alias(n) for k, n in names.items()])
    taken = {out, *names.values()}
    back, before, after = ({k: free_name(docs, taken, f"_{k}_{side}") for k in KINDS} for side in ("back", "before", "after"))
    pairs = pairs.select("*", *[F.reverse(F.col(n)).alias(back[k]) for k, n in names.items()])
    pairs = pairs.select(
        "*",
        *[_near(F.col(n), k, False).alias(before[k]) for k, n in names.items()],
        *[F.reverse(_near(F.col(back[k]), k, True)).alias(after[k]) for k in KINDS],
    )

    def with_sides(k: str) -> Column:
        # zip_with takes whole columns: one named in a lambda may be computed anew for every item
        sides = F.zip_with(before[k], after[k], lambda b, a: F.struct(b.alias("before"), a.alias("after")))
        return F.zip_with(
            names[k],
            sides,
            lambda x, s: F.struct(
                x["gap"].alias("gap"), x["hit"].alias("hit"), s["before"].alias("before"), s["after"].alias("after")
            ),
        )

    # The items take the pairs' columns.
    pairs = pairs.withColumns({n: with_sides(k) for k, n in names.items()})
    spans = F.array_sort(F.concat(*[_spans(F.col(n), k) for k, n in names.items()]))
    return pairs.select(*[F.col(f"`{c}`") for c in docs.columns], spans.alias(out))


def _told(spans: Column) -> Column:
    return F.concat_ws(
        ",",
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
    )


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_email, n_ip, n_card, n_phone, base_sha256, spans, pii for every row of `docs`.

    A null or empty text has no spans: counts 0, the hash of nothing, spans "".
    Null keys and repeated rows give a row each; an empty table an empty result;
    other columns are not read.
    """
    found = add_spans(docs.select(docs[key].alias("key"), docs[text].alias("text"))).drop("text")
    base = F.filter("pii", lambda s: s["rank"] <= len(BASE))
    told = found.select("key", "pii", _told(base).alias("base"), _told(F.col("pii")).alias("spans"))
    n = [_count(F.col("pii"), k).alias(f"n_{k}") for k in BASE]
    return told.select(
        F.col("key").alias(key), *n, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "pii"
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with every span of its text replaced by [KIND]; same columns, same rows.

    Overlapping spans go together under the first one's name.  The text is
    read in pieces of 1,024 code points, so the work is linear in its length.
    A null text stays null.
    """
    size = 1024
    pii, chunks = free_name(docs, set(), "_pii"), free_name(docs, set(), "_chunks")
    found = add_spans(docs, text, pii)
    cut = F.regexp_extract_all(text_or_empty(text), F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))
    found = found.withColumn(chunks, F.when(F.size(pii) > 0, cut))

    def between(start: Column, end: Column) -> Column:
        first = F.floor(start / size).cast("int")
        some = F.array_join(F.slice(chunks, first + 1, F.floor((end - 1) / size).cast("int") - first + 1), "")
        return F.when(end > start, F.substring(some, start - first * size + 1, end - start)).otherwise(F.lit(""))

    def step(pos: Column, x: Column) -> tuple[Column, Column]:
        name = F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))
        out = F.array(between(pos, x["start"]), name)
        none = F.array().cast("array<string>")
        return F.greatest(pos, x["end"]), F.when(x["start"] >= pos, out).otherwise(none)

    folded = free_name(docs, {pii, chunks}, "_folded")
    found = found.withColumn(folded, F.when(F.size(pii) > 0, fold(F.col(pii), "string", step)))
    rest = between(F.col(folded)["pos"], F.length(text_or_empty(text)))
    masked = F.array_join(F.concat(F.col(folded)["out"], F.array(rest)), "")
    return found.select(
        *[
            F.when(F.size(pii) > 0, masked).otherwise(F.col(text)).alias(c) if c == text else F.col(f"`{c}`")
            for c in docs.columns
        ]
    )
