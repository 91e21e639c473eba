"""Personal data: regular expressions propose spans, checksums confirm them, context words score them.

Columns and SQL functions only. A pattern's matches and the gaps between them (the text split by the
same pattern) give every position: a running sum of code points. Patterns are written with possessive
quantifiers and look-behinds that find the same leftmost matches as the plain forms, without
backtracking over long runs of letters or digits.

Kinds, in order: email, ip (parts at most 255), card (16 to 19 digits, Luhn), phone (8 to 15 digits),
and the method's own iban (mod-97) and ssn (nothing but its form to check, so it needs a context word
nearby). Base kinds stay whatever their score. A span's score starts at its kind's base and rises by
`CONTEXT_GAIN` where a context word of the kind stands within `WINDOW` code points on either side.

Defined cases: null or empty text has no spans; kinds may overlap each other; within a kind matches are
leftmost and do not overlap, and a match that fails its check is dropped without another try; extra
columns are kept, columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatgrid.llm.shared import free_name

WINDOW = 40
CONTEXT_GAIN = 0.2
#: A match has four code points at least, so this many pairs hold WINDOW of them.
NEAR = WINDOW // 4 + 1
RUN = 64
LOCAL = "A-Za-z0-9._%+-"
DOMAIN = "[A-Za-z0-9-]++"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str
    context: str
    score: float
    needs_context: bool = False


KINDS = (
    Kind("email", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@{DOMAIN}(?:\.{DOMAIN})++", "@", "mail|contact|courriel|correo|write to", 0.8),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", r"\bip\b|address|host|server|login", 0.6),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){15}", "card|visa|credit|debit|karte|carte|tarjeta", 0.8),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", r"phone|\btel|mobile|call|fax|telefon", 0.7),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
         r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", "iban|bank|konto|compte|cuenta|account", 0.8),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
         "ssn|social security", 0.5, True),
)
BASE = ("email", "ip", "card", "phone")


def mod97(code: Column) -> Column:
    """Remainder mod 97 of an IBAN without blanks: first four characters last, letters as 10 to 35."""
    turned = F.concat(F.substring(code, 5, 40), F.substring(code, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        value = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(value >= 65, (acc * 100 + value - 55) % 97).otherwise((acc * 10 + value - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step)


def confirmed(kind: str, match: Column) -> Column:
    """Whether the checksum or the counts of a proposed span hold."""
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        digits = F.translate(match, " -", "")
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.translate(match, "+ ().-", "")).between(8, 15)
    if kind == "iban":
        code = F.translate(match, " ", "")
        return F.length(code).between(15, 34) & (mod97(code) == 1)
    return F.lit(True)


def proposals(text: Column, kind: Kind) -> Column:
    """array<struct<gap, match>> of a text; nothing where the kind's cheap hint is absent."""
    hinted = F.contains(text, F.lit("@")) if kind.hint == "@" else F.rlike(text, F.lit(kind.hint))
    pairs = F.arrays_zip(
        F.split(text, kind.pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("match"))
    empty = F.from_json(F.lit("[]"), "array<struct<gap:string,match:string>>")
    return F.when(hinted, pairs).otherwise(empty)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with value computed once, however often and inside however many loops body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pieces_of(pairs: Column) -> Column:
    """Of each gap and match: their lengths, the gap's ends, and the match."""
    return F.transform(pairs, lambda p: F.struct(
        (F.length(p["gap"]) + F.coalesce(F.length(p["match"]), F.lit(0))).alias("size"), F.length(p["gap"]).alias("gap"),
        F.left(p["gap"], F.lit(WINDOW)).alias("head"), F.right(p["gap"], F.lit(WINDOW)).alias("tail"), p["match"].alias("match")))


def added_up(pieces: Column) -> Column:
    return F.aggregate(pieces, F.lit(0), lambda a, p: a + p["size"])


def spans(pairs: Column, kind: Kind) -> Column:
    """array<struct<start, end, score>> of the confirmed matches, code points, end exclusive.

    Positions come from sums over blocks of RUN pairs, and inside a block from the pairs before: work grows with the number
    of matches. Context is put together from the gaps and matches next to a span; NEAR of them always hold WINDOW code points.
    """

    def found(p: Column, blocks: Column, i: Column) -> Column:
        me = F.get(p, i)
        run = F.floor(i / RUN).cast("int")
        start = F.get(blocks, run) + added_up(F.slice(p, run * RUN + 1, i - run * RUN)) + me["gap"]
        first = F.greatest(i - NEAR, F.lit(0))
        before = F.transform(F.slice(p, first + 1, i - first), lambda q: F.concat(q["tail"], q["match"]))
        after = F.transform(F.slice(p, i + 2, F.lit(NEAR)), lambda q: F.concat(q["head"], F.coalesce(q["match"], F.lit(""))))
        left = F.right(F.concat(F.array_join(before, ""), me["tail"]), F.lit(WINDOW))
        near = F.concat_ws("\n", left, F.left(F.array_join(after, ""), F.lit(WINDOW)))
        told = F.rlike(F.lower(near), F.lit(kind.context))
        return F.struct(start.alias("start"), (start + F.length(me["match"])).alias("end"),
                        F.round(F.lit(kind.score) + F.when(told, CONTEXT_GAIN).otherwise(0.0), 2).alias("score"))

    def placed(p: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / RUN).cast("int")), lambda k: added_up(F.slice(p, k * RUN + 1, F.lit(RUN))))
        starts = F.aggregate(runs, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
        good = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.coalesce(confirmed(kind.name, F.get(p, i)["match"]), F.lit(False))
                        & F.get(p, i)["match"].isNotNull())
        return let(starts, lambda blocks: F.transform(good, lambda i: found(p, blocks, i)))

    none = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,score:double>>")
    scored = let(pieces_of(pairs), lambda p: F.when(F.size(p) > 0, placed(p)).otherwise(none))
    if kind.needs_context:
        scored = F.filter(scored, lambda s: s["score"] > kind.score)
    return scored


def joined(name: str, kinds: list[str], last: str = "end") -> Column:
    def of(kind: str) -> Column:
        return F.transform(F.col(f"{name}{kind}"), lambda s: F.concat_ws(":", F.lit(kind), s["start"], s[last]))

    return F.array_join(F.concat(*[of(k) for k in kinds]), ",")


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of `docs`; n_<base kind>; base_spans, spans (kind:start:end) and scores (kind:start:score), comma-joined."""
    added = [f"n_{k}" for k in BASE] + ["base_spans", "spans", "scores"]
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    names, own = [k.name for k in KINDS], free_name(docs, "pii_")
    df = docs.select(*keep, *[spans(proposals(text, k), k).alias(f"{own}{k.name}") for k in KINDS])
    return df.select(
        *keep, *[F.size(f"{own}{k}").cast("long").alias(f"n_{k}") for k in BASE],
        joined(own, list(BASE)).alias("base_spans"), joined(own, names).alias("spans"), joined(own, names, "score").alias("scores"))
