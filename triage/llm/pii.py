"""Personal data and secrets by patterns, checksums and context, in column expressions only.

A pattern proposes spans, a validator confirms or drops them (Luhn for card numbers, mod 97 for
account numbers, number ranges, digit counts, entropy of secrets), and words close before a span
raise its score. Spans of the base kinds (email, ip, card, phone) always stay once confirmed; the
others need ``min_score``, and one that lies inside a span of an earlier kind goes.

Added kinds: iban, ssn, tel (numbers of the North American plan without ``+1``, near a word such as
"call"), ipv6 (eight groups), key (credentials that begin with the mark of their issuer), jwt,
private_key (a whole PEM block, or its first line), password (a name such as ``api_key`` with the
value given to it) and token (24 or more mixed characters near a word such as "secret").

The patterns are written so that a match attempt never rereads a run of characters: repeated
groups are possessive, and a run is entered at its begin or where the last match ended. This
changes no match and keeps long texts linear.

Places are in code points, ends exclusive. The place of a match is the length of what stands
between matches plus the matches before it.

Defined cases: a null or empty text has no spans; several spans may begin at one place, they
are then ordered by kind; each row is looked at on its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT_CHARS = 40
MIN_SCORE = 0.5
# bits per character; sums of equal shares do not fall on these, so rounding decides nothing
PASSWORD_BITS = 2.2
TOKEN_BITS = 3.3


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float  # of a confirmed span without context
    bonus: float  # for a context word close before it
    context: str
    needs: str  # characters without which a text cannot match
    base: bool = True


# The patterns of the base kinds, in the order in which equal places are listed.
_LOCAL = "[A-Za-z0-9._%+-]"
_TOKEN = "[A-Za-z0-9_/+-]"
KINDS = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, 0.1,
         "mail|contact|write", "@"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.7, 0.2, "ip|address|host|server", "."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){13,}+", 0.8, 0.2, "card|visa|credit|payment", ""),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, 0.3, "phone|call|tel|mobile", "+"),
    Kind("iban", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)"
         r"(?![A-Za-z0-9_])", 0.8, 0.2, "iban|account|bank|konto", "", base=False),
    Kind("ssn", r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])", 0.3, 0.4, "ssn|social|security", "-",
         base=False),
    Kind("tel", r"(?:\([2-9][0-9]{2}\)\x20?|(?<![A-Za-z0-9_])[2-9][0-9]{2}[\x20.-])[2-9][0-9]{2}[\x20.-][0-9]{4}"
         r"(?![A-Za-z0-9_])", 0.3, 0.4, "phone|call|tel|mobile|cell|fax|contact|reach", "", base=False),
    Kind("ipv6", r"(?<![A-Za-z0-9_])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![A-Za-z0-9_])", 0.6, 0.2,
         "ip|address|host|server", ":", base=False),
    # The marks by which issuers of credentials begin them, and their lengths.
    Kind("key", r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9_])|gh[oprsu]_[A-Za-z0-9]{36,}+"
         r"|github_pat_[A-Za-z0-9_]{22,}+|glpat-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9_-]{20,}+"
         r"|[prs]k_(?:live|test)_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36,}+"
         r"|SG\.[A-Za-z0-9_-]{16,}+\.[A-Za-z0-9_-]{16,}+)", 0.9, 0.1, "[a-z0-9_-]*(?:key|token|secret)", "", base=False),
    Kind("jwt", r"(?<![A-Za-z0-9_])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0.9, 0.1,
         "[a-z0-9_-]*(?:token|bearer|auth)", "eyJ", base=False),
    Kind("private_key", r"-----BEGIN\x20(?:[A-Z]{2,9}\x20)?PRIVATE\x20KEY(?:\x20BLOCK)?-----"
         r"(?:[^-]*+-----END\x20(?:[A-Z]{2,9}\x20)?PRIVATE\x20KEY(?:\x20BLOCK)?-----)?+", 1.0, 0.0, "key", "PRIVATE KEY",
         base=False),
    Kind("password", r"(?:[Pp]assword|PASSWORD|[Pp]asswd|[Pp]assphrase|[Pp]wd|[Ss]ecret|SECRET|[Aa]pi[_-]?[Kk]ey|API_?KEY"
         r"|[Aa]ccess[_-]?[Kk]ey|ACCESS_KEY|[Tt]oken|TOKEN)[\x22']?(?:\x20?[:=]\x20?|\x20is\x20)[\x22']?"
         r"[A-Za-z0-9_!@#$%^&*+=./?~-]{6,}+", 0.6, 0.0, "key", "", base=False),
    Kind("token", rf"(?:(?<!{_TOKEN})|\G){_TOKEN}{{24,}}+", 0.3, 0.4,
         "[a-z0-9_-]*(?:key|token|secret|passw|credential|bearer)", "", base=False),
)
# what stands after the name of a password
VALUE = r"^[A-Za-z_-]+[\x22']?(?:\x20?[:=]\x20?|\x20is\x20)[\x22']?(.*)$"
_ORDER = {k.name: i for i, k in enumerate(KINDS)}


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.split(F.reverse(number), "")
    doubled = F.transform(
        places, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))
        )
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number passes the mod 97 check (letters count from 10)."""
    plain = F.regexp_replace(code, " ", "")
    turned = F.split(F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4)), "")
    step = lambda a, c: F.when(
        F.ascii(c) < 58, (a * 10 + F.ascii(c) - 48) % 97
    ).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(turned, F.lit(0), step) == 1


def entropy(word: Column) -> Column:
    """Bits per character by the shares of its characters."""
    n = F.length(word)

    def bits(c: Column) -> Column:
        times = n - F.length(F.replace(word, c, F.lit("")))
        return times * F.log2(times.cast("double"))

    places = F.transform(F.array_distinct(F.split(word, "")), bits)
    return F.log2(n.cast("double")) - F.aggregate(places, F.lit(0.0), lambda a, x: a + x) / n


def mixed(word: Column, bits: float) -> Column:
    """Whether a string has letters, digits and so many bits per character."""
    return word.rlike("[0-9]") & word.rlike("[A-Za-z]") & (entropy(word) >= bits)


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        n = digits(match)
        # luhn() only where the length is right: the text may hold very long numbers
        return F.when(F.length(n) > 19, F.lit(False)).otherwise(luhn(n))
    if kind == "phone":
        return F.length(digits(match)).between(10, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(match, " ", "")).between(15, 34) & mod97(match)
    if kind == "ssn":  # numbers that are never given out
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "tel":  # codes such as 911 serve other ends
        return ~digits(match).rlike("^(?:.11|....11)")
    if kind == "key":
        return match.rlike("[0-9]")
    if kind == "password":
        return mixed(F.regexp_extract(match, VALUE, 1), PASSWORD_BITS)
    if kind == "token":
        return mixed(match, TOKEN_BITS)
    return F.lit(True)


def _located(text: Column, matches: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of all matches."""
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), matches.alias("match"))
    none = F.array().cast("array<struct<start: int, end: int, match: string>>")
    begin = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        end = start + F.coalesce(F.length(pair["match"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("match"))
        return F.struct(end.alias("at"), F.array_append(state["out"], span).alias("out"))

    return F.filter(F.aggregate(pairs, begin, step, lambda s: s["out"]), lambda s: s["match"].isNotNull())


def _filter(kind: Kind) -> Callable[[Column], Column]:
    return lambda s: _confirmed(kind.name, s["match"])


def _scored(kind: Kind, text: Column) -> Callable[[Column], Column]:
    """A span with the score of its kind and of the words before it."""

    def scored(s: Column) -> Column:
        low = F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0))
        before = F.lower(F.substr(text, low + 1, s["start"] - low))
        near = before.rlike(f"(?:^|[^a-z0-9_])(?:{kind.context})")
        score = F.lit(kind.score) + F.when(near, F.lit(kind.bonus)).otherwise(F.lit(0.0))
        return F.struct(
            s["start"].alias("start"), F.lit(_ORDER[kind.name]).alias("rank"), s["end"].alias("end"),
            F.lit(kind.name).alias("kind"), score.alias("score"),
        )

    return scored


def detect(docs: DataFrame, text_col: str = "text", name: str = "spans", min_score: float = MIN_SCORE) -> DataFrame:
    """Add ``name``: array<struct<start, rank, end, kind, score>> in the order of start and kind.

    Helper columns carry the prefix ``_pii_`` and are gone from the result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumns({
        f"_pii_{k.name}": F.when(
            F.contains(text, F.lit(k.needs)) if k.needs else text.rlike("[0-9]"),
            F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0)),
        )
        for k in KINDS
    })
    out = out.withColumns({
        f"_pii_{k.name}": F.when(
            F.size(f"_pii_{k.name}") > 0, _located(text, F.col(f"_pii_{k.name}"), k.pattern)
        )
        for k in KINDS
    })
    found = []
    for k in KINDS:
        spans = F.transform(F.filter(F.col(f"_pii_{k.name}"), _filter(k)), _scored(k, text))
        if not k.base:
            spans = F.filter(spans, lambda s: s["score"] >= min_score)
        empty = F.array().cast("array<struct<start: int, rank: int, end: int, kind: string, score: double>>")
        found.append(F.coalesce(spans, empty))
    out = out.withColumn("_pii_spans", F.array_sort(F.concat(*found)))
    spans = F.col("_pii_spans")
    base = sum(k.base for k in KINDS)

    def alone(s: Column) -> Column:
        inside = F.exists(
            spans, lambda o: (o["rank"] < s["rank"]) & (o["start"] <= s["start"]) & (o["end"] >= s["end"])
        )
        return F.when(s["rank"] < base, True).otherwise(~inside)

    # most texts have no added span and need no second look
    added = F.exists(spans, lambda s: s["rank"] >= base)
    kept = F.when(added, F.filter(spans, alone)).otherwise(spans)
    return out.withColumn(name, kept).drop("_pii_spans", *[f"_pii_{k.name}" for k in KINDS])


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin([k.name for k in KINDS if k.base]))


def redact(docs: DataFrame, text_col: str = "text", spans: str = "spans") -> DataFrame:
    """Replace every span of ``detect`` by its kind in square brackets; of overlapping spans the first stays."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        piece = F.substr(text, state["at"] + 1, s["start"] - state["at"])
        fresh = s["start"] >= state["at"]
        return F.struct(
            F.when(fresh, s["end"]).otherwise(state["at"]).alias("at"),
            F.when(fresh, F.concat(state["out"], piece, F.lit("["), s["kind"], F.lit("]"))).otherwise(state["out"]).alias("out"),
        )

    rest = lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.length(text)))
    return docs.withColumn(text_col, F.aggregate(F.col(spans), begin, step, rest))
