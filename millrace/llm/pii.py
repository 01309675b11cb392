"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs their votes.

Base spans of four kinds (email, ip, card, phone) come from patterns with a validity test and always stay. Further
candidates come from looser patterns: an address spelt with "at" and "dot", a phone number without country code, a
card number inside a longer run of digits or one that fails its checksum, and secrets (a fifth kind: a value of twelve
signs or more that is assigned to a name such as token, key or password, or one in the shape of a known kind of key). Five labelers vote on every candidate, base spans
included, with 1, -1 or 0: the pattern and its test, the layout of the span, a gazetteer (top-level domains, country
codes, card issuers, private networks, shapes of keys), cue words before the span, and cue words against it.
Expectation-maximisation estimates each labeler's reliability by kind from the counts of vote patterns, of which
there are at most 5 * 3**5; the posterior then weighs a log-odds classifier over span features, and looser candidates
that it scores above ``MIN_SCORE`` are added where they overlap no base span. DataFrame functions only; texts are
read once, and each pattern runs only on texts that pass a cheap test.

Defined results: null text is empty; spans are code points with an exclusive end; matches of a kind don't overlap
and are taken from the left, failing matches are dropped without another try; added spans overlap neither base
spans nor each other; rows are independent of each other but for the weights, so repeated rows and ids are no
matter; texts are read whole, however long; an empty table gives an empty table; new columns whose names clash get an
underscore in front.

Quantifiers are possessive, so Java's matcher neither recurses nor backtracks on long runs, and local parts and
numbers start only where a run (or the last match's rest) starts: the leftmost match is the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from millrace.llm.common import column, unique_name, written

#: The kinds with base spans, and the one that only the method finds.
KINDS, SECRET = ("email", "ip", "card", "phone"), "secret"
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Looser patterns: runs are possessive and open-ended, so a span reaches to the end of its value.
SPELT_EMAIL = r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{2,}+(?: ?[\[({<] ?(?:at|@) ?[\])}>] ?| at |@)[a-z0-9-]{2,}+(?:(?: ?[\[({<] ?(?:dot|\.) ?[\])}>] ?| dot |\.)[a-z0-9-]{2,}+)++"
LOCAL_PHONE = r"(?<![0-9+(.-])(?:\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}|\(?0[0-9]{1,5}\)?[ ./-]?[0-9]{3,4}(?:[ .-]?[0-9]{2,4}){1,2}|00[1-9][0-9]{0,2}(?:[ .-]?[0-9]{2,4}){3,5})(?![0-9.-])"
INNER_CARD = r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{14,16})(?![0-9])"
NAMED_SECRET = r"(?i)(?:api[_ -]?key|access[_ -]?key|secret|token|passw(?:or)?d|passwort|bearer|auth|key|pwd)[\"']?[ ]{0,2}[:=][ ]{0,2}[\"']?[A-Za-z0-9_/+.=-]{12,}+"
#: Keys that their shape gives away without a name: fixed beginnings of common providers' keys, and signed web tokens.
BARE_KEY = r"(?<![A-Za-z0-9_/+=-])(?:A(?:KI|SI)A[0-9A-Z]{16,}+|gh[pousr]_[A-Za-z0-9]{20,}+|glpat-[A-Za-z0-9_-]{16,}+|sk-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{30,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)"
#: Cheap tests of whole texts: each asks for a part of its pattern, so where one fails, its pattern has no match.
GATES = {
    EMAIL: "@", IP: r"[0-9]\.[0-9]", CARD: r"[0-9](?:[ -]?[0-9]){13}", PHONE: r"\+[0-9]",
    SPELT_EMAIL: r"(?i)@|[\[({< ]at[ \])}>]{1,3}[a-z0-9-]{2,}+(?: dot |\.[a-z0-9-]| ?[\[({<])",
    LOCAL_PHONE: r"[0-9]{2}(?:[^0-9]{0,2}[0-9]){5}", INNER_CARD: r"[0-9](?:[ -]?[0-9]){13}", NAMED_SECRET: r"[:=][ ]{0,2}[\"']?[A-Za-z0-9_/+.=-]{12}",
    BARE_KEY: r"A(?:KI|SI)A[0-9A-Z]|gh[pousr]_|glpat-|sk-[A-Za-z0-9_-]{20}|xox[abprs]-|AIza|eyJ[A-Za-z0-9_-]{8}",
}

#: Fixed values of the gazetteers and cue words: top-level domains, country calling codes.
DOMAINS = (
    "com org net edu gov mil int io co info biz name pro dev app ai me tv cc eu ac ad ae ar at au be bg br by ca ch cl cn cz de dk ee es fi fr gr hk hr hu id ie il in ir is it jp "
    "kr kz lt lu lv ma mx my nl no nz pe ph pk pl pt ro rs ru se sg si sk th tr tw ua uk us uy ve vn za example test"
)
COUNTRY_CODES = (
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 "
    "212 213 216 218 234 254 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 378 380 381 382 385 386 387 389 420 421 423 852 853 880 886 961 962 963 964 965 966 968 971 972 973 974 975 976 977 992 993 994 995 996 998"
)
CUES = {
    "email": r"mail|contact|write|reach|kontakt|correo|courriel|schreib|escrib|@",
    "ip": r"\bip\b|host|server|address|login|adresse",
    "card": r"card|visa|master|amex|credit|karte|carte|tarjeta|pay|zahl|[0-9]{4}[ -]$",
    "phone": r"phone|tel|call|mobile|cell|fax|ring|anruf|appel|llama|ruf|m[oó]vil|handy",
    "secret": r".",
}
AGAINST = r"version|\bv\.?$|order|isbn|chapter|section|\bno\.?$|article|invoice|serial|\bid:? ?$|#$"
CONTEXT = 30
ITERATIONS = 10
MIN_SCORE = 2.0
VOTES = ("by_pattern", "by_layout", "by_gazetteer", "by_cue", "by_counter_cue")
SPAN = "array<struct<start:int,end:int,text:string>>"


def matches(text: Column, pattern: str) -> Column:
    """All matches with their places: texts between matches and matches alternate, so lengths add up to positions."""
    none = F.array().cast(SPAN)
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.transform(F.slice(between, 1, F.size(found)), lambda x: F.length(x)).alias("gap"), found.alias("hit"))
    first = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(s: Column, p: Column) -> Column:
        begin = s["at"] + p["gap"]
        end = begin + F.length(p["hit"])
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), p["hit"].alias("text")))).alias("out"))

    # Most texts have no match of a kind; they skip the rest.
    gate = F.contains(text, F.lit("@")) if GATES[pattern] == "@" else text.rlike(GATES[pattern])
    return F.when(gate, F.when(F.size(found) > 0, F.aggregate(pairs, first, step)["out"]).otherwise(none)).otherwise(none)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def valid_ip(hit: Column) -> Column:
    parts = F.transform(F.split(hit, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    return F.forall(parts, lambda p: F.when(F.length(p) <= 3, F.coalesce(p.try_cast("int"), F.lit(0)) <= 255).otherwise(False))


def luhn_ok(number: Column) -> Column:
    """The checksum of a string of digits: from the right every second digit counts double, less 9 if above 9."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") < 5, d.cast("int") * 2).otherwise(d.cast("int") * 2 - 9))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_ok(kind: str, hit: Column) -> Column:
    n = F.length(digits(hit))
    if kind == "ip":
        return valid_ip(hit)
    if kind == "card":
        return F.when(n.between(14, 19), luhn_ok(digits(hit))).otherwise(F.lit(False))
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _sign(yes: Column, no: Column) -> Column:
    return F.when(F.coalesce(yes, F.lit(False)), 1).when(F.coalesce(no, F.lit(False)), -1).otherwise(0)


def _candidate(kind: str, base: Column, passed: Column, s: Column, text: Column) -> Column:
    """A span with its votes and the features of the classifier; ``passed`` is a looser pattern's own test."""
    hit, number = s["text"], digits(s["text"])
    before = F.lower(F.substring(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT))))
    layout = {
        "email": (F.length(hit).between(6, 60), F.length(hit) > 100),
        "ip": (hit.rlike(r"^[1-9][0-9]{0,2}(\.(0|[1-9][0-9]{0,2})){3}$"), hit.rlike(r"(^|\.)0[0-9]")),
        "card": (hit.rlike(r"^[0-9]{14,19}$") | hit.rlike(r"^[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{2,7}$"), hit.rlike(r"[0-9][ -][0-9][ -][0-9]")),
        "phone": (hit.rlike(r"^\+[0-9]{1,3} ?\(?[0-9]{2,4}\)?([ .-]?[0-9]{2,4}){2,4}$") | hit.rlike(r"^\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}$") | hit.rlike(r"^\(?0[0-9]+\)?[ ./-]"), hit.rlike(r"[().-]{3,}") | hit.rlike("^[0-9]+$")),
        "secret": (hit.rlike(r"[0-9]") & hit.rlike(r"[A-Za-z]{1}[^:=]*$"), hit.rlike(r"[:=][ \"']*[A-Za-z]+$|[:=][ \"']*[0-9]+$")),
    }[kind]
    gazetteer = {
        "email": (F.lower(F.regexp_extract(hit, r"([A-Za-z]+)$", 1)).isin(DOMAINS.split()), F.lower(hit).rlike(r"\.(png|jpg|gif|js|css)$")),
        "ip": (~hit.rlike(r"^(0|127|255)\."), hit.rlike(r"^(0|127|255)\.")),
        "card": (number.rlike(r"^(4|5[1-5]|2[2-7]|3[0-9]|6)"), number.rlike(r"^(0|1|7|8|9)")),
        "phone": (F.when(F.startswith(hit, F.lit("+")), number.rlike(f"^({'|'.join(COUNTRY_CODES.split())})")).otherwise(number.rlike(f"^(00({'|'.join(COUNTRY_CODES.split())})|0[1-9]|[2-9][0-9]{{2}}[2-9])")), number.rlike(r"^(0{3}|1{4}|123456)")),
        "secret": (hit.rlike(r"[A-Fa-f0-9]{32,}|(AKIA|ASIA|gh[pousr]_|glpat-|sk-|xox|AIza|eyJ)[A-Za-z0-9_-]{10,}|[A-Za-z0-9_/+=-]{24,}"), hit.rlike(r"(?i)(example|xxxx|your|changeme|placeholder)")),
    }[kind]
    votes = {
        "by_pattern": F.when(base | passed, 1).otherwise(-1),
        "by_layout": _sign(*layout),
        "by_gazetteer": _sign(*gazetteer),
        "by_cue": _sign(before.rlike(CUES[kind]), F.lit(False)),
        "by_counter_cue": _sign(F.lit(False), before.rlike(AGAINST)),
    }
    return F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), base.alias("base"),
        *[v.cast("int").alias(k) for k, v in votes.items()],
        F.array(
            F.concat(F.lit("digits:"), F.least(F.length(number), F.lit(20)).cast("string")),
            F.concat(F.lit("length:"), F.least(F.floor(F.length(hit) / 4), F.lit(12)).cast("string")),
            F.concat(F.lit("marks:"), F.least(F.length(F.regexp_replace(hit, "[A-Za-z0-9]", "")), F.lit(8)).cast("string")),
            F.concat(F.lit("cue:"), votes["by_cue"].cast("string")),
            F.concat(F.lit("against:"), votes["by_counter_cue"].cast("string")),
            F.concat(F.lit("book:"), votes["by_gazetteer"].cast("string")),
            F.concat(F.lit("layout:"), votes["by_layout"].cast("string")),
        ).alias("features"),
    )


def _voted(kind: str, text: Column, is_base: Callable[[Column], Column], passes: Callable[[Column], Column] = lambda hit: F.lit(False)) -> Callable[[Column], Column]:
    return lambda s: _candidate(kind, is_base(s["text"]), passes(s["text"]), s, text)


def candidates(text: Column) -> Column:
    """All candidates of a text, base spans and looser ones."""
    parts, no = [], lambda hit: F.lit(False)
    for kind, pattern in zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True):
        found = matches(text, pattern)
        if kind == "card":  # shorter runs of digits are no candidates at all
            found = F.filter(found, lambda s: F.length(digits(s["text"])).between(14, 19))
        parts.append(F.transform(found, _voted(kind, text, lambda hit, k=kind: base_ok(k, hit))))
    own_test = {"email": lambda hit: hit.rlike(r"[\[({< ]"), "phone": lambda hit: F.length(digits(hit)).between(10, 15), "card": lambda hit: luhn_ok(digits(hit)), SECRET: lambda hit: hit.rlike(r"[:=][ \"']*[A-Za-z0-9_/+.=-]{16,}$") | ~hit.rlike("[:=]")}
    for kind, pattern in (("email", SPELT_EMAIL), ("phone", LOCAL_PHONE), ("card", INNER_CARD), (SECRET, NAMED_SECRET), (SECRET, BARE_KEY)):
        parts.append(F.transform(matches(text, pattern), _voted(kind, text, no, own_test[kind])))
    return F.concat(*parts)


def estimate(patterns: list[tuple[tuple[int, ...], float]], iterations: int = ITERATIONS) -> list[float]:
    """The probability that spans of each vote pattern (votes, count) are true, by expectation-maximisation.

    A pattern starts at the share of its votes that are for the span; a labeler's reliability is how often it casts
    its vote among true and among false spans, smoothed by one.
    """
    p = [(sum(v > 0 for v in votes) + 1) / (sum(v != 0 for v in votes) + 2) for votes, _ in patterns]
    for _ in range(iterations):
        mass = [[n * x for (_, n), x in zip(patterns, p, strict=True)], [n * (1 - x) for (_, n), x in zip(patterns, p, strict=True)]]
        total = [sum(m) for m in mass]
        cast: list[dict[tuple[int, int], float]] = [{}, {}]
        for side in (0, 1):
            for (votes, _), m in zip(patterns, mass[side], strict=True):
                for labeler, v in enumerate(votes):
                    cast[side][labeler, v] = cast[side].get((labeler, v), 0.0) + m
        prior = (total[0] + 1) / (sum(total) + 2)
        for k, (votes, _) in enumerate(patterns):
            true, false = prior, 1 - prior
            for labeler, v in enumerate(votes):
                true *= (cast[0][labeler, v] + 1) / (total[0] + 3)
                false *= (cast[1][labeler, v] + 1) / (total[1] + 3)
            p[k] = true / (true + false)
    return p


def posteriors(counted: list[Row], iterations: int = ITERATIONS) -> dict[str, float]:
    """The probability of each kind and vote pattern, from the counts (kind, votes..., n) of all spans."""
    out = {}
    for kind in {r["kind"] for r in counted}:
        mine = [(tuple(r[v] for v in VOTES), float(r["n"])) for r in sorted(counted) if r["kind"] == kind]
        for (votes, _), p in zip(mine, estimate(mine, iterations), strict=True):
            out[" ".join(map(str, (kind, *votes)))] = p
    return out


def literal_map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv]) if values else F.create_map().cast("map<string,double>")


def feature_weights(spans: DataFrame) -> dict[str, float]:
    """Log odds of each kind's features and its bias, weighted by the posteriors of all spans; under 400 in all."""
    counted = spans.groupBy("kind", *VOTES).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 5 * 3**5 patterns
    labelled = spans.withColumn("p", F.element_at(literal_map(posteriors(counted)), F.concat_ws(" ", "kind", *[F.col(v).cast("string") for v in VOTES])))
    rows = labelled.select("kind", "p", F.explode(F.concat("features", F.array(F.lit("all")))).alias("feature"))
    sums = rows.groupBy("kind", "feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    total = sums.where("feature = 'all'").select("kind", F.col("yes").alias("all_yes"), F.col("no").alias("all_no"))
    odds = F.log((F.col("yes") + 1) / (F.col("all_yes") + 2)) - F.log((F.col("no") + 1) / (F.col("all_no") + 2))
    bias = F.log((F.col("all_yes") + 1) / (F.col("all_no") + 1))
    weighed = sums.join(F.broadcast(total), "kind").select(F.concat_ws(" ", "kind", "feature").alias("name"), F.when(F.col("feature") == "all", bias).otherwise(odds).alias("weight"))
    return {r["name"]: r["weight"] for r in weighed.collect()}


def detect_pii(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """The columns ``keep`` (all but the text, unless given) and ``pii``: spans (kind, start, end, base, score) by start and kind."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    pii = unique_name(docs, "pii")
    found = docs.select(*[column(c) for c in keep], candidates(F.coalesce(column(text_col), F.lit(""))).alias(pii))
    found = written(found)  # no text any more: a few spans for some of the rows
    spans = found.select(F.explode(pii).alias("s")).select("s.*")
    table = literal_map(feature_weights(spans))

    def score(s: Column) -> Column:
        names = F.transform(F.concat(s["features"], F.array(F.lit("all"))), lambda f: F.concat_ws(" ", s["kind"], f))
        return F.aggregate(names, F.lit(0.0), lambda a, n: a + F.coalesce(F.try_element_at(table, n), F.lit(0.0)))

    scored = F.transform(pii, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.lit([*KINDS, SECRET]), s["kind"]).cast("int").alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base"), score(s).alias("score")))
    out = found.withColumn(pii, scored)
    base = F.filter(pii, lambda s: s["base"])
    loose = F.array_sort(F.filter(pii, lambda s: ~s["base"] & (s["score"] >= min_score)))

    def add(have: Column, s: Column) -> Column:
        return F.when(F.exists(have, lambda h: (h["start"] < s["end"]) & (s["start"] < h["end"])), have).otherwise(F.concat(have, F.array(s)))

    return out.withColumn(pii, F.array_sort(F.when(F.size(loose) > 0, F.aggregate(loose, base, add)).otherwise(base)))


def _equals(value: str) -> Callable[[Column], Column]:
    return lambda x: x == value


def op5_pii(docs: DataFrame) -> DataFrame:
    found = detect_pii(docs.select("doc_id", "text"))

    def digest(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("pii", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, _equals(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("pii")).alias("spans"), (F.size("pii") - F.size(base)).cast("long").alias("n_added"), F.size("pii").cast("long").alias("n_spans"))
