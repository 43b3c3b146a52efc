"""Personal data by weak supervision, in DataFrame functions only.

Candidate spans come from strict patterns (the base) and wide ones (written-out e-mail addresses, national
phone numbers, IPv6, dotted card numbers). Four labelers vote yes, no or nothing on each: format and
checksums, a gazetteer of prefixes and domains, cue words before the span, and what the span touches.
Expectation-maximisation over the counts of vote patterns (at most 3^4, whatever the corpus) estimates how
reliable each labeler is; its posteriors train a naive Bayes classifier on span features, again from counts
over all candidates. Base spans always stay; the classifier adds wide ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

# The base patterns. Possessive quantifiers and \G keep them linear in the text: a match can
# only start where the run of its first class does, or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
EMAIL_WORDS = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?[A-Za-z0-9-]++(?:(?:\x20?[\[(]\x20?(?:dot|DOT)\x20?[\])]\x20?|\.)[A-Za-z0-9-]++)++"
PHONE_NATIONAL = r"(?<![0-9A-Za-z+().-])(?:\([2-9][0-9]{2}\)\x20?|[2-9][0-9]{2}[\x20.-])[2-9][0-9]{2}[\x20.-][0-9]{4}(?![0-9])"
IPV6 = r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
CARD_DOTTED = r"(?<![0-9.])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"

#: form: (kind, pattern, a cheap test that texts without a match mostly fail)
FORMS = {
    "email": ("email", EMAIL, "@"),
    "ip": ("ip", IP, r"[0-9]\.[0-9]"),
    "card": ("card", CARD, r"[0-9][\x20-]?[0-9]"),
    "phone": ("phone", PHONE, r"\+[0-9]"),
    "email_words": ("email", EMAIL_WORDS, r"[\[(]\x20?(?:at|AT)\x20?[\])]"),
    "phone_national": ("phone", PHONE_NATIONAL, r"[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}"),
    "ipv6": ("ip", IPV6, r":[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:"),
    "card_dotted": ("card", CARD_DOTTED, r"[0-9]{4}[._/][0-9]{4}[._/]"),
}
BASE = ("email", "ip", "card", "phone")
SPAN = "array<struct<form:string,start:int,end:int,match:string>>"
#: Matches that are put together at a time.
RUN = 256
MARK, OTHER = "\u0001", "\u0002"

# Gazetteers and cue words.
DOMAINS = "com org net edu gov mil int info biz io de fr es it nl be ch at uk eu us ca au nz jp cn in br mx ru pl se no fi dk pt ie test example".split()
CUES = {
    "email": "mail e-mail email contact write reach reply correo courriel schreib",
    "ip": "ip host server address login connect from adresse dirección servidor",
    "card": "card visa mastercard credit debit payment karte carte tarjeta",
    "phone": "phone tel call fax mobile dial telefon téléphone teléfono móvil",
}
AGAINST = "version ver release isbn order invoice build section serial issue"
LABELERS = ("format", "gazetteer", "cue", "edges")
ADD_FROM = 0.9


def matches(text: Column, form: str) -> Column:
    """All matches of the form in text, with code point offsets; text holds no MARK."""
    _, pattern, gate = FORMS[form]
    pieces = F.split(F.regexp_replace(text, pattern, MARK + "$0" + MARK), MARK, -1)  # every second piece is a match
    none = F.array().cast(SPAN)
    # matches are added to short arrays, full ones to an array of those: adding copies an array
    found = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), F.array().cast(f"array<{SPAN}>").alias("full"), none.alias("found")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p)).alias("at"),
            (~s["odd"]).alias("odd"),
            F.when(F.size(s["found"]) >= RUN, F.array_append(s["full"], s["found"])).otherwise(s["full"]).alias("full"),
            F.when(
                s["odd"],
                F.array_append(
                    F.when(F.size(s["found"]) >= RUN, none).otherwise(s["found"]),
                    F.struct(F.lit(form).alias("form"), s["at"].alias("start"), (s["at"] + F.length(p)).alias("end"), p.alias("match")),
                ),
            ).otherwise(F.when(F.size(s["found"]) >= RUN, none).otherwise(s["found"])).alias("found"),
        ),
        lambda s: F.flatten(F.array_append(s["full"], s["found"])),
    )
    return F.when(text.contains(gate) if gate == "@" else text.rlike(gate), found).otherwise(F.array().cast(SPAN))


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def well_formed(form: Column, match: Column) -> Column:
    """Checks beyond the pattern: parts of an address, digits of a number, Luhn's sum."""
    digits = digits_of(match)
    byte = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    card = F.length(digits).between(12, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))
    phone = F.length(digits).between(9, 15)
    return (
        F.when(form == "ip", match.rlike(rf"^{byte}(?:\.{byte}){{3}}$"))
        .when(form.isin("card", "card_dotted"), card)
        .when(form == "phone", phone)
        .otherwise(F.lit(True))
    )


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, spans, wide): base-pattern and wide matches, wide ones and rejected base ones with their contexts."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), MARK, OTHER)
    df = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    df = df.select("id", "text", F.concat(*[matches(F.col("text"), f) for f in FORMS]).alias("all"))
    with_context = F.transform(
        "all",
        lambda m: F.struct(
            m["form"].alias("form"), m["start"].alias("start"), m["end"].alias("end"), m["match"].alias("match"),
            F.substring(F.col("text"), F.greatest(m["start"] - 39, F.lit(1)), F.least(m["start"], F.lit(40))).alias("left"),
            F.substring(F.col("text"), m["end"] + 1, F.lit(1)).alias("right"),
            well_formed(m["form"], m["match"]).alias("ok"),
        ),
    )
    return df.select("id", with_context.alias("spans"))


def _votes(c: DataFrame) -> DataFrame:
    """Votes 1, -1 and 0 of each labeler, over rows (id, form, kind, start, end, match, left, right, ok)."""
    digits, low = digits_of(F.col("match")), F.lower("left")
    domain = F.regexp_extract(F.lower("match"), r"([a-z0-9-]+)$", 1)
    first_octet = F.regexp_extract("match", r"^0*([0-9]+)\.", 1)
    gazetteer = (
        F.when(F.col("kind") == "email", F.when(domain.isin(DOMAINS), 1).otherwise(-1))
        .when(F.col("form") == "ip", F.when(first_octet.isin("0", "255"), -1).otherwise(1))
        .when(F.col("kind") == "card", F.when(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47068]|6)"), 1).otherwise(-1))
        .when(F.col("form") == "phone", F.when(digits.rlike("^[1-9]"), 1).otherwise(-1))
        .otherwise(0)
    )
    word = lambda words: r"(?U)(?<![\p{L}0-9])(?:" + "|".join(words.split()) + r")(?![\p{L}0-9])"
    cue = F.when(low.rlike(word(AGAINST)), -1)
    for kind, words in CUES.items():
        cue = cue.when((F.col("kind") == kind) & low.rlike(word(words)), 1)
    glued = F.col("left").rlike(r"[\p{L}0-9_/=#.-]$") | F.col("right").rlike(r"^[\p{L}0-9_/=#]")
    return c.select(
        "*",
        F.when(~F.col("ok"), -1).when(F.col("form").isin(*BASE), 1).otherwise(0).alias("format"),
        gazetteer.alias("gazetteer"),
        cue.otherwise(0).alias("cue"),
        F.when(glued, -1).otherwise(1).alias("edges"),
    )


def em(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 30) -> tuple[float, list[dict]]:
    """Prior and, per labeler, P(vote | truth), from counts of vote patterns. patterns has at most 3^len(LABELERS) rows."""
    k = len(LABELERS)
    table = [{True: {1: 0.75, 0: 0.2, -1: 0.05}, False: {1: 0.15, 0: 0.35, -1: 0.5}} for _ in range(k)]
    prior = 0.5
    for _ in range(rounds):
        sums = [{y: {v: 0.5 for v in (1, 0, -1)} for y in (True, False)} for _ in range(k)]  # add-half smoothing
        yes = total = 1e-9
        for votes, n in patterns:
            p = posterior(prior, table, votes)
            yes, total = yes + p * n, total + n
            for j, v in enumerate(votes):
                sums[j][True][v] += p * n
                sums[j][False][v] += (1 - p) * n
        prior = min(0.99, max(0.01, yes / total if total > 1 else 0.5))
        table = [{y: {v: c / sum(s[y].values()) for v, c in s[y].items()} for y in s} for s in sums]
    return prior, table


def posterior(prior: float, table: list[dict], votes: tuple[int, ...]) -> float:
    a = math.log(prior) - math.log(1 - prior)
    for t, v in zip(table, votes, strict=True):
        a += math.log(t[True][v]) - math.log(t[False][v])
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, a))))


def _looked_up(values: dict[str, float], key: Column, otherwise: float = 0.0) -> Column:
    """A lookup in a few fixed entries, as an expression."""
    out = F.lit(otherwise)
    if values:
        out = F.coalesce(F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))]), key), out)
    return out


def _features(c: DataFrame) -> list[Column]:
    """Span features of few values each: votes, separators, length; none names a document."""
    return [
        *[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in LABELERS],
        F.concat(F.lit("len="), F.least(F.floor(F.length("match") / 4), F.lit(9)).cast("string")),
        F.concat(F.lit("digits="), F.least(F.floor(F.length(digits_of(F.col("match"))) / 3), F.lit(6)).cast("string")),
        F.concat(F.lit("kind="), F.col("kind")),
    ]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, base and spans, arrays of (start, rank, end, kind) by start, then kind.

    Offsets are code points, ends exclusive. base holds the strict patterns' matches that pass their checks,
    leftmost and non-overlapping per kind; spans adds the wide matches that the classifier accepts and that
    touch no base span. Null texts count as empty. Ids should be distinct: added spans go by id, while base
    spans go by row. Other columns are ignored. An empty table gives an empty result.
    """
    found = cut(candidates(docs, id_col, text_col))
    rows = found.select("id", F.explode("spans").alias("s")).select("id", "s.*")
    kind = F.col("form")
    for form, (k, _, _) in FORMS.items():
        if form != k:
            kind = F.when(F.col("form") == form, k).otherwise(kind)
    # single digits and short numbers match the card pattern; they are no candidates
    rows = rows.withColumn("kind", kind).filter((F.col("form") != "card") | (F.length(digits_of(F.col("match"))) >= 12))
    voted = _votes(rows)
    counts = voted.groupBy(*LABELERS).agg(F.count(F.lit(1)).alias("n")).orderBy(*LABELERS).collect()  # at most 81 rows
    patterns = [(tuple(r[n] for n in LABELERS), r.n) for r in counts]
    prior, table = em(patterns)
    key = F.concat_ws(",", *[F.col(n).cast("string") for n in LABELERS])
    truth = _looked_up({",".join(map(str, v)): posterior(prior, table, v) for v, _ in patterns}, key, prior)
    seen = (
        voted.select(truth.alias("p"), F.explode(F.array(*_features(voted))).alias("feature"))
        .groupBy("feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).orderBy("feature").collect()  # as many as features have values
    )
    n_yes = sum(r.yes for r in seen) / (len(LABELERS) + 3) + 1
    n_no = sum(r.no for r in seen) / (len(LABELERS) + 3) + 1
    weights = {r.feature: math.log((r.yes + 0.5) / n_yes) - math.log((r.no + 0.5) / n_no) for r in seen}
    log_odds = sum((_looked_up(weights, f) for f in _features(voted)), F.lit(math.log(n_yes / n_no)))
    span = F.struct("start", "end", "kind")
    wide = voted.filter(~F.col("form").isin(*BASE) & F.col("ok") & (1 / (1 + F.exp(-log_odds)) >= ADD_FROM)).groupBy("id").agg(F.collect_set(span).alias("wide"))

    ranked = lambda s, k: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, BASE)), k).cast("int").alias("rank"), s["end"].alias("end"), k.alias("kind"))
    base = F.array_sort(F.transform(F.filter("spans", lambda s: s["form"].isin(*BASE) & s["ok"]), lambda s: ranked(s, s["form"])))
    free = F.filter(F.coalesce("wide", F.array().cast("array<struct<start:int,end:int,kind:string>>")), lambda w: ~F.exists("base", lambda b: (w["start"] < b["end"]) & (b["start"] < w["end"])))
    return (
        found.select("id", base.alias("base")).join(wide, "id", "left")
        .select(F.col("id").alias(id_col), "base", F.array_sort(F.concat("base", F.transform(free, lambda w: ranked(w, w["kind"])))).alias("spans"))
    )


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
