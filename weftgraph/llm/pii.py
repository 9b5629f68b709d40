"""Personal data in texts, by SQL functions alone.

Regular expressions propose spans, checksums confirm them (Luhn for cards, modulo 97 for IBANs, parts at most 255 for
addresses), and words nearby move a span's score up or down.

Base kinds, leftmost and non-overlapping within a kind: email, ip, card, phone. Each base match that passes its check is
a span, whatever its score. The method adds spans of further kinds: iban (two letters, two digits, 11 to 30 letters or
digits, single spaces allowed, modulo 97), secret (a key, token, password or the like, assigned in quotes or after a
colon or an equals sign, 16 characters or more), and natphone (a national phone number of 9 to 12 digits in groups, only
where a word such as tel or phone stands before it, and outside of base spans).

Positions come from the text between matches: split() and regexp_extract_all() see the same matches, so the start of
match i is the length of all pieces and matches before it. Patterns use possessive quantifiers and start at the start of
a run of their characters (or where the match before ended), which finds the same matches and keeps long runs of
characters linear. Lists are built block by block (``folded``), so a text of very many matches stays near linear too, and
what overlaps is told by two passes over sorted spans, not by pairs. The patterns of iban and natphone match the first group only; of what follows, the longest stretch that
ends with a group and passes the check is the span, so a word or number behind it does no harm.

Edge cases. Null text counts as empty: no spans. Null or repeated ids are kept as they are. An empty table gives an empty
result. ``find`` reads the id and the text only; ``redact`` keeps all columns of its input, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import blocks, folded, let
from .common import text_or_empty

_LOCAL = "A-Za-z0-9._%+-"
#: kind: (what a text must contain to be searched, pattern)
PATTERNS = {
    "email": ("@", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": ("[0-9]\\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("[0-9](?:[ -]?[0-9]){13}", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("\\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": ("[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11})(?=([\s\S]{1,90}))[A-Z]{2}[0-9]{2}"),
    "secret": ("[=:]", r"(?i)\b(?:api[_-]?key|access[_-]?key|secret|token|password|passwd|pwd)\b\x20{0,3}[=:]\x20{0,3}[\x22']?[A-Za-z0-9+/_.~-]{16,512}+[\x22']?"),
    "natphone": ("[0-9]{2}", r"(?<![0-9A-Za-z+.])(?=\(?[0-9]{2,5}\)?[\x20./-][0-9]{2})(?=([\s\S]{1,90}))\(?[0-9]{2,5}\)?(?=[\x20./-][0-9]{2})"),
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
CONTEXT, BEFORE, AFTER = {
    "email": "(?i)\\b(?:e-?mail|mail|contact|kontakt|correo|courriel|write)\\b",
    "ip": "(?i)\\b(?:ip|address|host|server|login|adresse)\\b",
    "card": "(?i)\\b(?:card|credit|visa|mastercard|karte|carte|tarjeta|pay(?:ment)?)\\b",
    "phone": "(?i)\\b(?:tel|phone|call|mobile|fax|telefon|téléphone|teléfono|cell)\\b",
    "iban": "(?i)\\b(?:iban|account|bank|konto|compte|cuenta)\\b",
    "secret": "(?i)\\b(?:secret|private|credential|key|token)\\b",
    "natphone": "(?i)\\b(?:tel|phone|call|mobile|fax|telefon|téléphone|teléfono|cell)\\b",
}, 40, 20
AGAINST = "(?i)\\b(?:example|sample|test|dummy|version|isbn|order|invoice|serial)\\b"
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "secret": 0.7, "natphone": 0.3}
SPAN = "array<struct<start:int,end:int,kind:string,score:double>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether a string of digits passes Luhn's check: every second digit from the right doubled, digits summed."""
    back = F.split(F.reverse(x), "")

    def term(d: Column, i: Column) -> Column:
        v = d.cast("int")
        w = F.when(i % 2 == 1, v * 2).otherwise(v)
        return F.when(w > 9, w - 9).otherwise(w)

    return F.aggregate(F.transform(F.filter(back, lambda d: d != ""), term), F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(x: Column) -> Column:
    """Whether an IBAN without spaces has remainder 1: the first four characters moved to the end, letters as 10 to 35."""
    moved = F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, 1, 4))

    def step(a: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v >= 65, (a * 100 + (v - 55)) % 97).otherwise((a * 10 + (v - 48)) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def confirmed(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: F.rlike(p, F.lit("^0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])?$")))
    if kind == "card":
        return n.between(14, 19) & luhn(_digits(x))
    if kind == "phone":
        return n.between(10, 15)
    if kind == "iban":
        return F.length(F.replace(x, F.lit(" "), F.lit(""))).between(15, 34) & mod97(F.replace(x, F.lit(" "), F.lit("")))
    if kind == "natphone":
        return n.between(9, 12)
    return F.lit(True)


def _longest(kind: str, ahead: Column) -> Column:
    """The longest confirmed stretch at the start of ``ahead`` that ends with a group, or null."""
    if kind == "iban":
        run = F.regexp_extract(ahead, r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+", 0)
        ends = F.filter(F.sequence(F.lit(15), F.greatest(F.lit(15), F.length(run))), lambda e: F.rlike(F.substring(ahead, e, F.lit(2)), F.lit("^[A-Z0-9](?![A-Za-z0-9])")))
        tries = F.transform(ends, lambda e: F.substring(run, F.lit(1), e))
    else:
        tries = F.array(*[F.regexp_extract(ahead, rf"^\(?[0-9]{{2,5}}\)?(?:[\x20./-][0-9]{{2,8}}){{{k}}}(?![0-9A-Za-z])", 0) for k in range(1, 5)])
    return F.try_element_at(F.filter(tries, lambda m: confirmed(kind, m)), F.lit(-1))


_MATCHES = "array<struct<start:int,match:string,near:string>>"


def grouped(text: Column, kind: str) -> Column:
    """proposals() for iban and natphone: leftmost, non-overlapping, each the longest that is confirmed."""
    need, pattern = PATTERNS[kind]
    hits = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("head"), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("ahead"))
    both = F.zip_with(F.split(text, pattern, -1), hits, lambda g, h: F.struct(g.alias("gap"), h["head"].alias("head"), _longest(kind, h["ahead"]).alias("match"), h["ahead"].alias("ahead")))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.lit(0).alias("last"))

    def step(a: Column, x: Column) -> Column:
        start, before = a["at"] + F.length(x["gap"]), F.concat(a["tail"], F.right(x["gap"], F.lit(BEFORE)))
        near = F.concat(F.right(before, F.least(F.lit(BEFORE), start - a["last"])), F.lit(" "), F.substring(x["ahead"], F.length(x["match"]) + 1, F.lit(AFTER)))
        good = x["match"].isNotNull() & (start >= a["last"])
        found = F.when(good, F.array_append(a["found"], F.struct(start.alias("start"), x["match"].alias("match"), near.alias("near")))).otherwise(a["found"])
        head = F.coalesce(x["head"], F.lit(""))
        return F.struct((start + F.length(head)).alias("at"), F.right(F.concat(before, head), F.lit(BEFORE)).alias("tail"), F.when(good, start + F.length(x["match"])).otherwise(a["last"]).alias("last"), found.alias("found"))

    return F.when(F.rlike(text, F.lit(need)), folded(both, zero, _MATCHES, step)).otherwise(F.array().cast(_MATCHES))


def proposals(text: Column, kind: str) -> Column:
    """array<struct<start, match, near>> of a kind's matches, confirmed. near: what stands up to BEFORE characters before
    and AFTER characters after the match, as far as it belongs to no other match of the kind."""
    if kind in ("iban", "natphone"):
        return grouped(text, kind)
    need, pattern = PATTERNS[kind]

    def pieces(gaps: Column) -> Column:
        around = F.zip_with(gaps, F.slice(gaps, 2, F.greatest(F.lit(1), F.size(gaps))), lambda g, after: F.struct(F.length(g).alias("gap"), F.concat(F.right(g, F.lit(BEFORE)), F.lit(" "), F.left(F.coalesce(after, F.lit("")), F.lit(AFTER))).alias("near")))
        return F.zip_with(around, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(g["gap"].alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("size"), F.when(confirmed(kind, m), m).alias("match"), g["near"].alias("near")))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        found = F.when(x["match"].isNull(), a["found"]).otherwise(F.array_append(a["found"], F.struct(start.alias("start"), x["match"].alias("match"), x["near"].alias("near"))))
        return F.struct((start + x["size"]).alias("at"), found.alias("found"))

    found = folded(let(F.split(text, pattern, -1), pieces), F.struct(F.lit(0).alias("at")), _MATCHES, step)
    wanted = F.contains(text, F.lit(need)) if kind == "email" else F.rlike(text, F.lit(need))
    return F.when(wanted, found).otherwise(F.array().cast(_MATCHES))


def _scored(kind: str, found: Column) -> Column:
    def span(s: Column) -> Column:
        score = F.lit(PRIOR[kind]) + F.when(F.rlike(s["near"], F.lit(CONTEXT[kind])), 0.2).otherwise(0.0) - F.when(F.rlike(s["near"], F.lit(AGAINST)), 0.3).otherwise(0.0)
        return F.struct(s["start"].alias("start"), (s["start"] + F.length(s["match"])).alias("end"), F.lit(kind).alias("kind"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 2).alias("score"))

    return F.transform(found, span)


def _is(kind: str):
    return lambda s: s["kind"] == kind


def _ordered(i: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("order"), s["end"].alias("end"), s["kind"].alias("kind"), s["score"].alias("score"))


_ORDERED = "array<struct<start:int,order:int,end:int,kind:string,score:double>>"
_LAST = 2**31 - 1


def _clear(spans: Column) -> Column:
    """Sorted spans without the natphones that overlap a span of another kind. Going forward, the largest end so far tells
    of spans that begin before one does; going backward, the smallest start so far of those that begin after."""

    def pass_over(items: Column, edge: int, meets, further) -> Column:
        def step(a: Column, s: Column) -> Column:
            weak = s["kind"] == "natphone"
            found = F.when(weak & meets(s, a["edge"]), a["found"]).otherwise(F.array_append(a["found"], s))
            return F.struct(F.when(weak, a["edge"]).otherwise(further(s, a["edge"])).alias("edge"), found.alias("found"))

        return folded(items, F.struct(F.lit(edge).alias("edge")), _ORDERED, step)

    forward = pass_over(spans, 0, lambda s, edge: s["start"] < edge, lambda s, edge: F.greatest(edge, s["end"]))
    return F.reverse(pass_over(F.reverse(forward), _LAST, lambda s, edge: s["end"] > edge, lambda s, edge: F.least(edge, s["start"])))


def with_spans(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with all spans of a text column, ordered by start, then by kind as listed."""
    for k in KINDS:
        df = df.withColumn(f"{name}_{k}", _scored(k, proposals(F.col(text), k)))
    # A national number is kept with a word for phones before it, and only outside of the other spans.
    df = df.withColumn(f"{name}_natphone", F.filter(F.col(f"{name}_natphone"), lambda s: s["score"] >= 0.4))
    every = F.sort_array(F.concat(*[F.transform(F.col(f"{name}_{k}"), _ordered(i)) for i, k in enumerate(KINDS)]))
    df = df.withColumn(name, every)
    df = df.withColumn(name, F.when(F.size(f"{name}_natphone") > 0, _clear(F.col(name))).otherwise(F.col(name)))
    return df.withColumn(name, F.transform(name, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["score"].alias("score")))).drop(*[f"{name}_{k}" for k in KINDS])


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: array<struct<start, end, kind, score>>; positions are code points, ends exclusive."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return with_spans(rows, "text", "spans").select("doc_id", "spans")


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from those of find(): counts by kind, the base spans' digest, all spans as a string, and the
    spans' scores in the same order."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",")
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), scores.alias("scores"))


def _unions(spans: Column) -> Column:
    """Sorted spans to stretches (a: end of the stretch before, start, end, kind of its first span)."""
    flush = F.struct(F.lit(_LAST).alias("start"), F.lit(_LAST).alias("end"), F.lit("").alias("kind"))
    items = F.concat(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))), F.array(flush))
    zero = F.struct(F.lit(0).alias("a"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit("").alias("kind"))

    def step(u: Column, s: Column) -> Column:
        grows = (u["start"] >= 0) & (s["start"] < u["end"])
        closed = (u["start"] >= 0) & ~grows
        done = F.struct(u["a"].alias("a"), u["start"].alias("start"), u["end"].alias("end"), u["kind"].alias("kind"))
        return F.struct(F.when(closed, u["end"]).otherwise(u["a"]).alias("a"), F.when(grows, u["start"]).otherwise(s["start"]).alias("start"), F.when(grows, F.greatest(u["end"], s["end"])).otherwise(s["end"]).alias("end"), F.when(grows, u["kind"]).otherwise(s["kind"]).alias("kind"), F.when(closed, F.array_append(u["found"], done)).otherwise(u["found"]).alias("found"))

    return folded(items, zero, "array<struct<a:int,start:int,end:int,kind:string>>", step)


def _replaced(text: Column, stretches: Column) -> Column:
    """The text with each stretch named. Positions are counted from a text's start, so the text is first cut where a block
    of stretches ends, and each block's stretches are cut out of its own part."""

    def part(block: Column) -> Column:
        base = block[0]["a"]
        cut = lambda sub: F.array_join(F.transform(block, lambda c: F.concat(F.substring(sub, c["a"] - base + 1, c["start"] - c["a"]), F.lit("<"), F.upper(c["kind"]), F.lit(">"))), "")
        return let(F.substring(text, base + 1, F.element_at(block, -1)["end"] - base), cut)

    rest = F.substring(text, F.element_at(stretches, -1)["end"] + 1, F.length(text))
    return F.concat(F.array_join(F.transform(blocks(stretches), part), ""), rest)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of the text replaced by its kind in angle brackets, <EMAIL>; of overlapping spans the first
    (then the one listed first) is named and the replaced stretch is their union. Null stays null."""
    rows = with_spans(docs.withColumn("__pii_text", text_or_empty(text_col)), "__pii_text", "__pii_spans")
    rows = rows.withColumn("__pii_spans", _unions(F.col("__pii_spans")))
    new = _replaced(F.col("__pii_text"), F.col("__pii_spans"))
    return rows.withColumn(text_col, F.when(F.col(text_col).isNull() | (F.size("__pii_spans") == 0), F.col(text_col)).otherwise(new)).drop("__pii_text", "__pii_spans")
