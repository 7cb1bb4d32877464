"""Personal data by weak supervision, in DataFrame expressions only.

Strict patterns find the base spans (e-mail, IP address, card, phone), which
always stay. Loose patterns propose further spans. Four labelers vote on each
candidate: the pattern (strict for, loose against), the shape (well-formed or
not), a gazetteer (top-level domains, public networks, card issuers, calling
codes) and the words before it (for, against or neither). Votes are counted per
pattern of votes, a table of bounded size; expectation-maximisation over it
estimates each labeler's reliability and each kind's share of true spans, and
its posteriors train a logistic span classifier, applied to all candidates as a
column expression: loose spans that it takes are added.

Positions come from splitting a text at a pattern: the pieces between matches
and the matches, in turn, make up the text, so prefix sums of their lengths are
the starts. Prefix sums go by blocks, parts of a text by chunks of it, so the
work is about linear in the text and in its spans. Patterns use possessive
repeats, and a match may only begin at the first character of a run (or where
the last match ended), which gives the same leftmost matches in linear time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.arrays import let
from tidemark.llm.common import narrow, table
from tidemark.session import written

KINDS = ("email", "ip", "card", "phone")
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has none of the strict pattern that passes its checks.
QUICK = {"email": r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\s?+(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\s?+[A-Za-z0-9-]{1,63}+(?:\s?+(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\s?+[A-Za-z0-9-]{2,63}+){1,4}+",
    "phone": r"(?<![0-9A-Za-z+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
}
# Gazetteers, and words before a span that speak for or against it.
DOMAINS = "com|net|org|edu|gov|mil|int|info|biz|io|co|ai|app|dev|me|tv|de|fr|es|it|nl|be|ch|at|pl|pt|se|no|fi|dk|uk|ie|us|ca|mx|br|ar|cl|jp|cn|in|kr|au|nz|ru|ua|tr|za|eu"
RESERVED_NETWORKS = r"^(?:0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5]|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\."
CARD_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|36|38|6011|64|65|35|62)"
CALLING_CODES = r"^\+?(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-8]|35[1-9]|37[0-9]|38[0-7]|42[013]|85[2356]|88[06]|97[1-7]|99[2-8])"
FOR = {"email": "mail|contact|write|reply|courriel|correo|kontakt", "ip": "ip|host|server|address|login|from|client", "card": "card|visa|master|amex|credit|payment|karte|carte|tarjeta", "phone": "phone|tel|call|mobile|cell|fax|whatsapp|contact|anruf|llam"}
AGAINST = "version|release|isbn|issn|order|invoice|serial|token|sha|hash|build|section|figure|lot|sku"
CONTEXT = 40


#: Elements of a block of a prefix, and code points of a chunk of a text.
BLOCK, CHUNK = 64, 512


def prefix(values: Column, op, zero: int = 0) -> Column:
    """Of an array<bigint>, op over all elements before each: within blocks, then over the blocks."""
    seed = F.struct(F.lit(zero).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def step(acc, v):
        return F.struct(op(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda i: F.aggregate(F.slice(values, i, F.lit(BLOCK)), seed, step))

    def spread(local):
        carried = F.aggregate(local, seed, lambda acc, x: step(acc, x["at"]), lambda acc: acc["out"])
        return F.flatten(F.zip_with(local, carried, lambda x, c: F.transform(x["out"], lambda v: op(c, v))))

    return let(blocks, spread)


SPANS = "array<struct<start:bigint,end:bigint,hit:string>>"


def matches(text: Column, pattern: str, quick: str) -> Column:
    """Array of (start, end, hit) of all matches, in order; code points, end exclusive."""
    length = lambda x: F.coalesce(F.char_length(x), F.lit(0)).cast("bigint")
    zipped = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.struct(length(gap).alias("gap"), length(hit).alias("size"), hit.alias("hit")))

    def placed(z):
        before = prefix(F.transform(z, lambda x: x["gap"] + x["size"]), lambda a, b: a + b)
        return F.filter(F.zip_with(z, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), x["hit"].alias("hit"))), lambda x: x["hit"].isNotNull())

    return F.when(text.rlike(quick), let(zipped, placed)).otherwise(F.array().cast(SPANS))


def chunked(text: Column) -> Column:
    """The text in pieces of CHUNK code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def piece(chunks: Column, start: Column, end: Column) -> Column:
    """The text from start to end (exclusive), from the chunks it touches alone."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")
    at = (start % CHUNK + 1).cast("int")
    inner = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    whole = F.concat(F.substring(F.get(chunks, first), at, F.lit(CHUNK)), inner, F.substring(F.get(chunks, last), F.lit(1), (end - last * CHUNK).cast("int")))
    return F.when(end <= start, "").when(first == last, F.substring(F.get(chunks, first), at, (end - start).cast("int"))).otherwise(whole)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Every second digit from the right doubled, digits of doubles added, divisible by ten."""
    n = F.char_length(number)

    def add(acc, i):
        d = number.substr(i, F.lit(1)).cast("int")
        twice = F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return acc + twice

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def passes(kind: str, hit: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    d = digits(hit)
    if kind == "phone":
        return F.char_length(d).between(9, 15)
    return F.when(F.char_length(d).between(13, 19), luhn(d)).otherwise(False)


def gazetteer(kind: str, hit: Column) -> Column:
    d = digits(hit)
    known = {"email": F.lower(hit).rlike(rf"(?:\.|dot\W?\s?)(?:{DOMAINS})$"), "ip": ~hit.rlike(RESERVED_NETWORKS), "card": d.rlike(CARD_ISSUERS), "phone": F.when(hit.startswith("+"), hit.rlike(CALLING_CODES)).otherwise(d.rlike("^[2-9]"))}
    return known[kind].cast("int")


def shape(kind: str, hit: Column) -> Column:
    """Whether a candidate is written the usual way."""
    usual = {
        "email": r"^(?!\.|.*\.\.|.*\.@).*@.*\.[A-Za-z]{2,24}$|(?i)\(at\).*\(dot\)|\[at\].*\[dot\]|\{at\}.*\{dot\}",
        "ip": r"^[1-9][0-9]{0,2}(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
        "card": r"^[0-9]{13,19}$|^[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$|^[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5}$",
        "phone": r"^\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)[\x20.-]?)?[0-9]{1,14}(?:[\x20.-][0-9]{1,8}){0,5}$|^\([0-9]{3}\)\x20?[0-9]{3}[.-][0-9]{4}$|^[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}$",
    }
    return hit.rlike(usual[kind]).cast("int")


def context(kind: str, chunks: Column, start: Column) -> Column:
    before = F.lower(piece(chunks, F.greatest(start - CONTEXT, F.lit(0)), start))
    return let(before, lambda x: F.when(x.rlike(rf"\b(?:{FOR[kind]})"), 1).when(x.rlike(rf"\b(?:{AGAINST})\b"), 0).otherwise(-1))


def checked(kind: str):
    return lambda m: passes(kind, m["hit"])


def voted(kind: str, chunks: Column, strict: int):
    """A match to (start, end, strict, shape, gaz, ctx, size)."""
    return lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(strict).alias("strict"), shape(kind, m["hit"]).alias("shape"), gazetteer(kind, m["hit"]).alias("gaz"), context(kind, chunks, m["start"]).alias("ctx"), F.least(F.char_length(digits(m["hit"])) / 4, F.lit(4)).cast("int").alias("size"))


def free_of(span: Column, others: Column) -> Column:
    """Whether no element of an array sorted by start and without overlaps meets the span: by bisection."""
    seed = F.struct(F.lit(0).alias("lo"), F.size(others).alias("hi"))

    def halve(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        left = F.coalesce(F.get(others, mid)["end"] > span["start"], F.lit(True))
        return F.when(acc["lo"] < acc["hi"], F.struct(F.when(left, acc["lo"]).otherwise(mid + 1).alias("lo"), F.when(left, mid).otherwise(acc["hi"]).alias("hi"))).otherwise(acc)

    first = F.aggregate(F.sequence(F.lit(1), F.lit(32)), seed, halve, lambda acc: acc["lo"])
    return (F.size(others) == 0) | ~F.coalesce(F.get(others, first)["start"] < span["end"], F.lit(False))


def mark_for(docs: DataFrame) -> str:
    """What the columns added to ``docs`` begin with: an underscore, more if such columns are there."""
    mark, taken = "_", {c.lower() for c in docs.columns}
    while taken & {f"{mark}{x}" for x in ("text", "chunks", *KINDS, *(f"loose_{k}" for k in LOOSE))}:
        mark += "_"
    return mark


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with _text, _chunks and, per kind, _<kind>: array of (start, end, strict, shape, gaz, ctx, size)."""
    m = mark_for(docs)
    text, chunks = F.col(f"{m}text"), F.col(f"{m}chunks")
    out = docs.withColumn(f"{m}text", F.coalesce(F.col(text_col), F.lit("")))
    some = text.rlike(QUICK[KINDS[0]])
    for rx in (*(QUICK[k] for k in KINDS[1:]), *LOOSE.values()):
        some = some | text.rlike(rx)
    out = out.withColumn(f"{m}chunks", F.when(some, chunked(text)).otherwise(F.array().cast("array<string>")))
    for kind in KINDS:
        out = out.withColumn(f"{m}{kind}", F.transform(F.filter(matches(text, STRICT[kind], QUICK[kind]), checked(kind)), voted(kind, chunks, 1)))
        if kind in LOOSE:
            out = out.withColumn(f"{m}loose_{kind}", F.transform(matches(text, LOOSE[kind], LOOSE[kind]), voted(kind, chunks, 0)))

    def alone(x):
        free = free_of(x, F.col(f"{m}{KINDS[0]}"))
        for k in KINDS[1:]:
            free = free & free_of(x, F.col(f"{m}{k}"))
        return free

    for kind in LOOSE:
        out = out.withColumn(f"{m}loose_{kind}", F.filter(f"{m}loose_{kind}", alone))
    for kind in LOOSE:
        out = out.withColumn(f"{m}{kind}", F.array_sort(F.concat(f"{m}{kind}", f"{m}loose_{kind}"))).drop(f"{m}loose_{kind}")
    return out


VOTES = ("strict", "shape", "gaz", "ctx")


def reliabilities(rows: list[tuple[str, tuple[int, ...], float]], rounds: int = 200) -> tuple[list[list[float]], dict[str, float], list[float]]:
    """EM over (kind, votes, count): P(vote 1 | class) per labeler and class, each kind's share, each row's posterior.

    A vote of -1 abstains. Three labelers that vote both ways make the classes
    identifiable. Starts from the share of votes for; one pseudo-count each keeps
    rates and shares off zero and one; the true class is the one with more votes for.
    """
    post = [(1 + sum(v == 1 for v in votes)) / (2 + sum(v >= 0 for v in votes)) for _, votes, _ in rows]
    kinds = sorted({k for k, _, _ in rows})
    labelers = range(len(rows[0][1])) if rows else []
    rate: list[list[float]] = []
    prior: dict[str, float] = {}
    for _ in range(rounds):
        rate = [[(1 + sum(n * (p if c else 1 - p) for (_, v, n), p in zip(rows, post) if v[j] == 1)) / (2 + sum(n * (p if c else 1 - p) for (_, v, n), p in zip(rows, post) if v[j] >= 0)) for c in (0, 1)] for j in labelers]
        if sum(r[1] - r[0] for r in rate) < 0:
            rate, post = [[b, a] for a, b in rate], [1 - p for p in post]
        prior = {kind: (1 + sum(n * p for (k, _, n), p in zip(rows, post) if k == kind)) / (2 + sum(n for k, _, n in rows if k == kind)) for kind in kinds}
        post = []
        for kind, v, _ in rows:
            odds = math.log(prior[kind] / (1 - prior[kind])) + sum(math.log(r[1] / r[0]) if x == 1 else math.log((1 - r[1]) / (1 - r[0])) for x, r in zip(v, rate) if x >= 0)
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return rate, prior, post


FEATURES = [f"kind={k}" for k in KINDS] + ["strict=1", "shape=1", "gaz=1", "ctx=1", "ctx=0", *[f"size={i}" for i in range(5)]]


def features_of(kind: str, strict: int, shape: int, gaz: int, ctx: int, size: int) -> list[int]:
    on = {f"kind={kind}", f"strict={strict}", f"shape={shape}", f"gaz={gaz}", f"ctx={ctx}", f"size={size}"}
    return [int(f in on) for f in FEATURES]


def train(rows: list[tuple[list[int], float, float]], rounds: int = 500) -> list[float]:
    """Logistic weights (the last is the intercept) from (features, count, soft label)."""
    w = [0.0] * (len(FEATURES) + 1)
    total = sum(n for _, n, _ in rows) or 1
    for _ in range(rounds):
        g = [0.001 * x for x in w]
        for x, n, y in rows:
            z = w[-1] + sum(a for a, b in zip(w, x) if b)
            e = n / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y)
            for i, b in enumerate(x):
                g[i] += e * b
            g[-1] += e
        w = [a - 1.0 * b for a, b in zip(w, g)]
    return w


def learn(found: DataFrame, mark: str = "_") -> list[float]:
    """The classifier's weights from all candidates of ``found``; at most some hundred vote patterns are collected."""

    def voting(kind):
        return lambda s: F.struct(F.lit(kind).alias("kind"), *[s[v].alias(v) for v in (*VOTES, "size")])

    spans = F.concat(*[F.transform(f"{mark}{k}", voting(k)) for k in KINDS])
    by = ["kind", *VOTES, "size"]
    counted = [tuple(r) for r in found.select(F.explode(spans).alias("s")).groupBy(*[f"s.{x}" for x in by]).agg(F.count("*").alias("n")).orderBy(*by).collect()]
    _, _, post = reliabilities([(row[0], row[1:5], row[6]) for row in counted])
    return train([(features_of(*row[:6]), row[6], p) for row, p in zip(counted, post)])


def kept(kind: str, span: Column, w: list[float]) -> Column:
    """Strict spans, and those the classifier takes."""
    weight = dict(zip(FEATURES, w))
    z = F.lit(w[-1] + weight[f"kind={kind}"]) + F.when(span["ctx"] == 1, weight["ctx=1"]).when(span["ctx"] == 0, weight["ctx=0"]).otherwise(0.0)
    for vote in ("shape", "gaz"):
        z = z + F.when(span[vote] == 1, weight[f"{vote}=1"]).otherwise(0.0)
    z = z + F.element_at(F.array(*[F.lit(weight[f"size={i}"]) for i in range(5)]), span["size"] + 1)
    return (span["strict"] == 1) | (z >= 0)


def judged(found: DataFrame, mark: str) -> DataFrame:
    """``found``, written once and read for the votes and for the result, with the spans that are base or accepted."""
    held = written(found, "candidates")
    w = learn(held, mark)

    def good(kind):
        return lambda s: kept(kind, s, w)

    return held.withColumns({f"{mark}{k}": F.filter(f"{mark}{k}", good(k)) for k in KINDS})


def spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with _text, _chunks and arrays _email, _ip, _card, _phone of base and accepted spans.

    Null and empty texts have no spans; every row is taken by itself, so ties,
    repeated rows and null ids need no rule; a very long text costs about its
    length; an empty table gives an empty result; if ``docs`` has such columns,
    the new ones begin with more underscores (``mark_for``).
    """
    m = mark_for(docs)
    out = judged(candidates(docs, text_col).drop(f"{m}text", f"{m}chunks"), m).withColumn(f"{m}text", F.coalesce(F.col(text_col), F.lit("")))
    some = F.size(F.concat(*[f"{m}{k}" for k in KINDS])) > 0
    return out.withColumn(f"{m}chunks", F.when(some, chunked(F.col(f"{m}text"))).otherwise(F.array().cast("array<string>")))


def listed(kinds: dict[str, Column]) -> Column:
    """kind:start:end by kind as listed, then start, comma-joined."""

    def named(kind):
        return lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"])

    return F.array_join(F.concat(*[F.transform(c, named(k)) for k, c in kinds.items()]), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans and all spans of every document, rules as in ``spans``."""
    found = judged(candidates(narrow(table(spark, sf_dir, "documents"), "doc_id", "text")).select("doc_id", *[f"_{k}" for k in KINDS]), "_")
    base = {k: F.filter(f"_{k}", lambda s: s["strict"] == 1) for k in KINDS}
    return found.select(
        "doc_id",
        *[F.size(base[k]).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed({k: F.col(f"_{k}") for k in KINDS}).alias("spans"),
    )


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of its text replaced by <KIND>; overlapping spans become one, named by the first; n_chars follows."""
    m = mark_for(docs)
    found = spans(docs, text_col)

    def tagged(kind):
        return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"<{kind.upper()}>").alias("tag"))

    every = F.array_sort(F.concat(*[F.transform(f"{m}{k}", tagged(k)) for k in KINDS]))
    text, chunks = F.col(f"{m}text"), F.col(f"{m}chunks")

    def clean(all_):
        done = prefix(F.transform(all_, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        parts = F.zip_with(all_, done, lambda s, at: F.when(s["start"] < at, "").otherwise(F.concat(piece(chunks, at, s["start"]), s["tag"])))
        end = F.array_max(F.transform(all_, lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), piece(chunks, end, F.char_length(text).cast("bigint")))

    out = found.withColumn(text_col, F.when(F.size(every) > 0, let(every, clean)).otherwise(F.col(text_col)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
