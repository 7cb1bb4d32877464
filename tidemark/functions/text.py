"""Text functions: column expressions, and Arrow-batched functions where Spark has no builtin."""

from __future__ import annotations

import difflib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ordinal words.
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth"]


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalized_ascii(x) -> Column:
    """F1 for ASCII text, inside codegen."""
    return F.trim(F.regexp_replace(F.lower(F.replace(F.translate(c(x), "_", " "), F.lit("&"), F.lit(" and "))), "[^a-z0-9]+", " "))


def normalize(value: str | None) -> str | None:
    """'_' to space, NFKD without marks, lower case, '&' to and, [a-z0-9]+ words."""
    if value is None:
        return None
    plain = "".join(ch for ch in unicodedata.normalize("NFKD", value.replace("_", " ")) if not unicodedata.combining(ch))
    return " ".join(re.findall("[a-z0-9]+", plain.lower().replace("&", " and ")))


def batched(function, kind: str):
    """A column function that maps ``function`` over Arrow batches; nulls stay null.

    The pandas function is made when it is used: workers import this module
    without a session.
    """

    def run(x: pd.Series) -> pd.Series:
        return x.map(function, na_action="ignore").astype(object)

    return lambda column: F.pandas_udf(run, kind)(c(column))


normalize_udf = batched(normalize, "string")


def name_tokens(x) -> Column:
    """normalised name without 'and'."""
    return F.array_join(F.filter(F.split(normalized_ascii(x), " "), lambda t: t != "and"), " ")


def safe_label(x) -> Column:
    """characters that are safe in a file name."""
    return F.regexp_replace(F.regexp_replace(F.lower(c(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def human_label(x) -> Column:
    """'_and_' to ' / ', '_' to space."""
    return F.translate(F.replace(c(x), F.lit("_and_"), F.lit(" / ")), "_", " ")


def ordinal_word(n) -> Column:
    """first to tenth, else digits."""
    return F.when(c(n).between(1, len(ORDINALS)), F.try_element_at(F.array(*map(F.lit, ORDINALS)), c(n).cast("int"))).otherwise(c(n).cast("string"))


def ordinal_number(x) -> Column:
    """the first ordinal word, or digits with an ending, as a number; 1 without one."""
    word = F.regexp_extract(F.lower(c(x)), r"\b(" + "|".join(ORDINALS) + r")\b", 1)
    digits = F.regexp_extract(F.lower(c(x)), r"\b([0-9]+)(?:st|nd|rd|th)\b", 1)
    return F.when(word != "", F.array_position(F.array(*map(F.lit, ORDINALS)), word)).when(digits != "", digits.cast("bigint")).otherwise(1)


def caption(x) -> Column:
    """lower case, [^a-z0-9] runs to one space."""
    return F.trim(F.regexp_replace(F.lower(c(x)), "[^a-z0-9]+", " "))


def domain_key(prefix: str, domain: str, x) -> Column:
    """prefix and domain-separated SHA-256 of the exact name."""
    return F.concat(F.lit(prefix), F.sha2(F.concat(F.lit(domain), c(x)), 256))


def exact_question(value: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", value).casefold().split())


#: NFKC, case folded, white space to one space, trimmed.
question = batched(exact_question, "string")


def parent_id(x) -> Column:
    """without the part after the last underscore."""
    return F.regexp_replace(c(x), "_[^_]*$", "")


def canonical_hash(*columns: str) -> Column:
    """F14, DD9: SHA-256 of compact JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def words(x) -> Column:
    """Unicode words of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c(x)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def contains_phrase(x, cues: list[str]) -> Column:
    """A cue as whole words of the normalised text."""
    padded = F.concat(F.lit(" "), normalized_ascii(x), F.lit(" "))
    out = F.lit(False)
    for cue in cues:
        out = out | padded.contains(f" {cue} ")
    return out


def mentions(x, aliases: dict[str, str]) -> Column:
    """Labels whose aliases occur as whole words, by position, longer aliases first; array of labels."""
    padded = F.concat(F.lit(" "), normalized_ascii(x), F.lit(" "))
    found = F.array_compact(F.array(*[F.when(padded.contains(f" {a} "), F.struct(F.instr(padded, f" {a} ").alias("at"), F.lit(-len(a)).alias("n"), F.lit(label).alias("label"))) for a, label in sorted(aliases.items())]))
    return F.array_distinct(F.transform(F.array_sort(found), lambda m: m["label"]))


def safe_path(x) -> Column:
    """a relative path without empty, '.' or '..' parts."""
    return c(x).isNotNull() & (c(x) != "") & ~c(x).rlike(r"^/|\\|(^|/)(\.{0,2})(/|$)")


# The shortest variant that is compared, and the least ratio.
FUZZY_CHARS, FUZZY_RATIO = 6, 0.88


def settled(run, kind: str):
    """A pandas function whose results are columns of their own before others use them; the optimizer would move it into lambda functions, which can't call Python."""
    return F.pandas_udf(run, kind).asNondeterministic()


def normal_form(x: Column) -> Column:
    """F1 for use in lambda functions."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(normalize, na_action="ignore").astype(object)

    return settled(run, "string")(x)


def spans(n, least: int | Column, most: int | Column) -> Column:
    """All windows of ``least`` to ``most`` of n words, as structs (start, stop), by start, then by length."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    low, high = F.greatest(F.lit(1), as_column(least)), as_column(most)
    at = lambda i: F.filter(F.transform(F.sequence(low, F.greatest(low, high)), lambda k: F.struct(i.alias("start"), (i + k).alias("stop"))), lambda w: w["stop"] <= n)
    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), at))).otherwise(F.array().cast("array<struct<start: int, stop: int>>"))


def ratios(target: Column, words: Column, windows: Column, target_first: bool = False) -> Column:
    """The likeness (0 to 1, by matching blocks of characters) of each window of words to the target; -1 where an earlier window is at least as like.

    The likeness may depend on which of the two comes first.
    """

    def of(wanted, said, places):
        out, best = [], -1.0
        for w in places:
            pair = " ".join(said[w["start"] : w["stop"]]), wanted
            m = difflib.SequenceMatcher(None, *(reversed(pair) if target_first else pair))
            # a window that can't beat an earlier one needs no exact ratio
            out.append(m.ratio() if m.real_quick_ratio() > best and m.quick_ratio() > best else -1.0)
            best = max(best, out[-1])
        return out

    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([of(*x) if x[0] is not None and x[2] is not None else None for x in zip(a, b, c)])

    return settled(run, "array<double>")(target, words, windows)


def most_alike(windows: Column, like: Column) -> Column:
    """The first of the windows with the greatest ratio, as a struct (ratio, start, stop); null without windows."""
    scored = F.transform(F.arrays_zip(windows.alias("w"), like.alias("r")), lambda x: F.struct(x["r"].alias("ratio"), (-x["w"]["start"]).alias("start"), (-x["w"]["stop"]).alias("stop")))
    best = F.array_max(scored)
    return F.when(best.isNotNull(), F.struct(best["ratio"].alias("ratio"), (-best["start"]).alias("start"), (-best["stop"]).alias("stop")))


def with_quotes(df: DataFrame, quote: str, spoken: str, into: str = "found") -> DataFrame:
    """``df`` with the place (ratio, start, stop) of each row's quote among its array of spoken words.

    Windows are two words shorter to two longer than the quote; quote and words
    are compared in normal form. Null without a quote or words.
    """
    marked = df.withColumns({"_target": normal_form(F.col(quote)), "_words": normalized_words(F.col(spoken))})
    n = F.size(F.split("_target", " "))
    marked = marked.withColumn("_windows", F.when((F.col("_target") != "") & (F.size("_words") > 0), spans(F.size("_words"), n - 2, n + 2)))
    return marked.withColumn(into, most_alike(F.col("_windows"), ratios(F.col("_target"), F.col("_words"), F.col("_windows"), True))).drop("_target", "_words", "_windows")


def beside_quote(spoken: str, found: str, before: bool) -> Column:
    """The words before or after a found quote; NONE if there are none."""
    start, stop = F.col(found)["start"], F.col(found)["stop"]
    said = F.when(start.isNotNull(), F.slice(spoken, F.lit(1), start) if before else F.slice(spoken, stop + 1, F.size(spoken)))
    return F.coalesce(F.nullif(F.array_join(said, " "), F.lit("")), F.lit("NONE"))


def normalized_words(words: Column) -> Column:
    """F1 of each element."""

    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda ws: None if ws is None else [normalize(w) or "" for w in ws])

    return settled(run, "array<string>")(words)


def with_fuzzy_mentions(df: DataFrame, text: str, variants: dict[str, str], threshold: float = FUZZY_RATIO, into: str = "labels") -> DataFrame:
    """``df`` with the labels whose variants nearly occur in the text, by the place of their best window.

    Windows have a variant's number of words, one less or one more; each label
    takes the greatest ratio over its variants, of equal ones the first variant's
    first window (shorter windows before longer ones). Labels at one place go by name.
    """
    wanted = [(normalize(v) or "", label) for v, label in variants.items()]
    wanted = [(v, label) for v, label in wanted if len(v) >= FUZZY_CHARS]
    if not wanted:
        return df.withColumn(into, F.array().cast("array<string>"))
    out = df.withColumn("_words", F.filter(F.split(F.coalesce(normal_form(F.col(text)), F.lit("")), " "), lambda w: w != ""))
    found = []
    for i, (variant, label) in enumerate(wanted):
        n = variant.count(" ") + 1
        # shorter windows come first, so the windows go by length, then by start
        by_length = F.array_sort(F.transform(spans(F.size("_words"), n - 1, n + 1), lambda w: F.struct((w["stop"] - w["start"]).alias("n"), w["start"].alias("start"), w["stop"].alias("stop"))))
        out = out.withColumn("_windows", by_length).withColumn("_like", ratios(F.lit(variant), F.col("_words"), F.col("_windows")))
        best = F.array_max(F.transform("_like", lambda r, k: F.struct(r.alias("ratio"), (-k).alias("k"))))
        out = out.withColumn(f"_found{i}", F.when(best["ratio"] >= threshold, F.struct(best["ratio"].alias("ratio"), F.lit(-i).alias("variant"), F.get("_windows", -best["k"])["start"].alias("start"), F.lit(label).alias("label"))))
        found.append(f"_found{i}")
    every = F.array_compact(F.array(*found))
    best_of = lambda x: F.array_max(F.filter(every, lambda y: y["label"] == x))
    chosen = F.transform(F.array_distinct(F.transform(every, lambda x: x["label"])), best_of)
    ordered = F.array_sort(F.transform(chosen, lambda x: F.struct(x["start"], x["label"])))
    return out.withColumn(into, F.transform(ordered, lambda x: x["label"])).drop("_words", "_windows", "_like", *found)


def first_json(text: str | None) -> str | None:
    """the first balanced JSON object in free text."""
    for at, ch in enumerate(text or ""):
        if ch == "{":
            try:
                value, _ = json.JSONDecoder().raw_decode(text, at)
            except ValueError:
                continue
            return json.dumps(value, sort_keys=True)
    return None


first_json_udf = batched(first_json, "string")


def has_duplicate_keys(text: str | None) -> bool | None:
    """Whether a JSON object repeats a key at any level; null for what isn't JSON."""

    def pairs(items):
        if len({k for k, _ in items}) < len(items):
            raise KeyError
        return dict(items)

    try:
        json.loads(text or "", object_pairs_hook=pairs)
    except KeyError:
        return True
    except ValueError:
        return None
    return False


has_duplicate_keys_udf = batched(has_duplicate_keys, "boolean")


def recovered_fields(x) -> Column:
    """relation, anchor_label and anchor_ordinal of a JSON object that may break off, and the outcome.

    Each field is the first of its name with a whole value; a null or missing one
    is null. Without a relation nothing is recovered.
    """
    text = F.coalesce(c(x), F.lit(""))
    relation = F.nullif(F.regexp_extract(text, r'"relation"\s*:\s*"([^"]+)"', 1), F.lit(""))
    label = F.regexp_extract(text, r'"anchor_label"\s*:\s*(null|"[^"]*")', 1)
    ordinal = F.regexp_extract(text, r'"anchor_ordinal"\s*:\s*(null|-?[0-9]+|"[^"]*")', 1)
    known = relation.isNotNull()
    quoted = lambda v: F.when(known & ~v.isin("", "null"), F.regexp_replace(v, '^"|"$', ""))
    return F.struct(relation.alias("relation"), quoted(label).alias("anchor_label"), quoted(ordinal).try_cast("bigint").alias("anchor_ordinal"), F.when(known, "partial").otherwise("missing_relation").alias("outcome"))


#: P20: words that no field's name may hold.
PROHIBITED = ("oracle", "sdr")


def prohibited_in(text: str | None, words: tuple[str, ...] = PROHIBITED) -> list[str] | None:
    """P20: sorted paths of fields, at any depth, whose name holds one of the words (case and '-' aside); null for what isn't JSON."""
    try:
        value = json.loads(text or "")
    except ValueError:
        return None
    out, todo = set(), [("", value)]
    while todo:
        path, v = todo.pop()
        if isinstance(v, list):
            todo += [(f"{path}[]", x) for x in v]
        elif isinstance(v, dict):
            for name, x in v.items():
                at = f"{path}.{name}" if path else name
                if any(w in name.casefold().replace("-", "_") for w in words):
                    out.add(at)
                todo.append((at, x))
    return sorted(out)


prohibited_paths = batched(prohibited_in, "array<string>")


def parse_question(text: str | None, labels: list[str], cues: tuple[str, ...] = ("before", "after")) -> tuple[str | None, list[str], int]:
    """(relation, labels in order of mention, ordinal before the anchor).

    Two or more labels ask for the first of them; one label needs one of the
    cues (the first that occurs in their order); the nearest ordinal word before the anchor counts, else 1.
    """
    q = f" {normalize(text) or ''} "
    seen = sorted((q.find(f" {normalize(label)} "), label) for label in labels if f" {normalize(label)} " in q)
    names = [label for _, label in seen]
    if len(names) >= 2:
        return "first", names, 1
    relation = next((r for r in cues if f" {r} " in q), None)
    if not names or not relation:
        return None, names, 1
    before = q[: seen[0][0]].split()
    n = next((ORDINALS.index(w) + 1 for w in reversed(before) if w in ORDINALS), 1)
    return relation, names, n


INTENTS = ("list", "count", "exists", "locate", "before", "after", "between", "overlap", "first", "last", "longest", "speaker_count", "speaker_identity", "speech_before_quote", "speech_after_quote")
SPEAKERS = ("any", "male", "female", "child")


def normalized_program(payload, labels: dict[str, str]) -> Column:
    """A question program from JSON with its fields made valid; ``labels`` leads from normalised aliases to labels.

    Unknown intents are ``unsupported``; labels without an alias are left out and
    repeated ones named once; ordinals are whole numbers from one on, anything
    else one; an unknown speaker is ``any``, and so is every speaker of speaker
    questions; the confidence lies from zero to one; only quote intents keep a
    quote. What isn't JSON is ``unsupported`` with a reason.
    """
    p = F.from_json(c(payload), "intent string, labels array<string>, ordinals array<string>, speaker string, quote string, confidence string")
    tidy = lambda x: F.lower(F.trim(x))
    alias = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    intent = F.when(tidy(p["intent"]).isin(*INTENTS), tidy(p["intent"])).otherwise("unsupported")
    named = F.array_distinct(F.array_compact(F.transform(F.coalesce(p["labels"], F.array().cast("array<string>")), lambda x: F.element_at(alias, normalized_ascii(x)))))
    ordinals = F.transform(F.coalesce(p["ordinals"], F.array().cast("array<string>")), lambda x: F.greatest(F.lit(1), F.coalesce(x.try_cast("int"), F.lit(1))))
    who = F.nullif(tidy(p["speaker"]), F.lit(""))
    speaker = F.when(intent.isin("speaker_identity", "speaker_count") | (who.isNotNull() & ~who.isin(*SPEAKERS)), "any").otherwise(who)
    quote = F.when(intent.isin("speech_before_quote", "speech_after_quote"), F.nullif(F.trim(p["quote"]), F.lit("")))
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(p["confidence"].try_cast("double"), F.lit(0.0))))
    broken = p.isNull() | ~F.startswith(F.trim(c(payload)), F.lit("{"))
    return F.struct(F.when(broken, "unsupported").otherwise(intent).alias("intent"), F.coalesce(named, F.array().cast("array<string>")).alias("labels"), F.coalesce(ordinals, F.array().cast("array<int>")).alias("ordinals"), speaker.alias("speaker"), quote.alias("quote"), F.coalesce(sure, F.lit(0.0)).alias("confidence"), F.when(broken, "invalid_json").alias("reason"))
