"""Conversations, filter audit and byte pairs against plain Python, over odd rows."""

import hashlib
import random
import sys
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, conversations, filters, lattice

sys.setrecursionlimit(20_000)
SPACE = " \t\n\x0b\x0c\r"


def collect(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# conversations


def brute_damage(rows):
    """{conv_id: rows left as (turn, role, text)}."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        v = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        out[conv] += []
        if v == 0:
            continue
        text = "" if v == 1 else "".join(c for c in text if c not in ".!?") if v == 2 else text
        out[conv] += [(turn, "user" if v == 4 else role, text)] * (2 if v == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for k, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_repair(rows):
    """Best (cost, audit, lines) by comparing whole strings from the end on."""
    found = faults(rows)
    moves = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    names = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i, g, inserted):
        options = []
        if i == len(rows) and g in (0, 3):
            options.append((0, "", ()))
        if inserted < 4:
            for c, to in moves[g].items():
                if c in names:
                    cost, s, lines = best(i, to, inserted + 1)
                    options.append((cost + 2, "I" + s, (names[c] + ":", *lines)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, s, lines = best(i + 1, g, 0)
            options.append((cost + 3, "D" + s, lines))
            if found[i] in ("", "truncated"):
                extra = found[i] == "truncated"
                for c, to in moves[g].items():
                    cost, s, lines = best(i + 1, to, 0)
                    if role[:1] == c:
                        options.append((cost + extra, "K" + s, (f"{role}:{text}", *lines)))
                    if c in names:
                        options.append((cost + 2 + extra, "R" + s, (f"{names[c]}:{text}", *lines)))
        return min(options, default=(1 << 40, "~", ()))

    return best(0, 0, 0)


def brute_conversations(rows):
    out = []
    for conv, left in brute_damage(rows).items():
        found, turns = faults(left), [r[0] for r in left if r[0] is not None]
        cost, audit, lines = brute_repair(left)
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")), sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(left, left[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


CONVERSATION = "conv_id bigint, turn bigint, role string, text string"


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(4)
    roles = ["user"] * 5 + ["assistant"] * 5 + ["system"] * 2 + ["tool", "", None, "User", "sage"]
    texts = ["Yes.", "No!", "Why?", "cut", "", " \t\n", None, "a. b", "Ünï 文.", "end. \x0b", "\xa0", "x\x85", ".", "\x1c"]
    rows = []
    for conv in range(400):
        for t in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([t, t, t, t, 2 * t, -t, None]), rng.choice(roles), rng.choice(texts)))
    rows += [(None, t, "user", "Hello.") for t in range(5)] + [(None, None, None, None)] * 3
    rows += rows[10:14]  # repeated rows
    rows += [(1000, t, "user" if t % 2 else "assistant", f"Turn {t}.") for t in range(250)]
    rows += [(1001, 1, "user", "long " * 300_000 + ".")]
    return rows


def test_conversations_equal_brute_force(spark, talks, tmp_path):
    spark.createDataFrame(talks, CONVERSATION).withColumn("audit", F.lit("clash")).withColumn("gone", F.lit(1)).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = Counter(tuple(r[n] for n in names) for r in collect(conversations.op11_conversations(spark, str(tmp_path))))
    assert got == Counter(brute_conversations(talks))
    assert sum(n for n in got.values()) == len({r[0] for r in talks})


def test_lazy_composition_equals_whole_strings():
    rng = random.Random(9)
    machine = conversations.Repair()
    for _ in range(1500):
        rows = [(i, rng.choice(["user", "assistant", "system", "other"]), rng.choice([f"{i}.", f"{i}", "", "Same."])) for i in range(rng.randint(0, 12))]
        found = faults(rows)
        classes = [conversations.Class(r[1][:1] if f in ("", "truncated") and r[1][0] in "sua" else "", f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, found)]
        cost, edits = machine(classes)
        assert (cost, "".join(e[0] for e in edits)) == brute_repair(rows)[:2]
    assert len(machine.known) < 3000  # the machine is made once for all conversations


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind.", 0, False), (1, 1, "user", "Hi.", 0, False), (1, 2, "user", "Hi.", 0, False), (1, 3, "assistant", "Hello", 0, False), (2, 0, "user", "x", 0, True)]
    got = {r["conv_id"]: r for r in collect(conversations.repaired(spark.createDataFrame(rows, CONVERSATION + ", copy int, gone boolean")))}
    assert got[1]["audit"] == "KKDK" and got[1]["cost"] == 4
    assert [(t["role"], t["text"], t["edit"]) for t in got[1]["repaired"]] == [("system", "Be kind.", "K"), ("user", "Hi.", "K"), ("assistant", "Hello", "K")]
    assert got[2] == {"conv_id": 2, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired": []}


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], CONVERSATION).write.parquet(f"{tmp_path}/conversations.parquet")
    assert conversations.op11_conversations(spark, str(tmp_path)).count() == 0


# filters


def brute_audit(docs, labels):
    """Every order applied to every document, one after the other."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for r in docs:
        if r[0] is not None:
            first[r[1] or ""] = min(r[0], first.get(r[1] or "", r[0]))
    failing = []
    for i, text, lang, *_ in docs:
        t = text or ""
        w = [x for x in t.translate({ord(c): " " for c in SPACE}).split(" ") if x]
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and first[t] < i}
        failing.append((lang or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    out, removed_of = [], Counter()
    for part in {r[0] for r in failing}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in failing if r[0] == part]
            for step, k in enumerate(order, 1):
                away = [r for r in left if k in r[1]]
                left = [r for r in left if k not in r[1]]
                all_failing = [r for r in failing if r[0] == part and k in r[1]]
                removed_of[part, k] += len(away)
                out.append([part, order, step, len(left), len(away), len(all_failing) - len(away), sum(len(r[1]) == 1 for r in all_failing), sum(r[2] for r in away), sum(r[3] for r in away)])
    return Counter((*r, removed_of[r[0], r[1][r[2] - 1]]) for r in out)


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
LABELS = [(i, int(i % 3 != 0), int(i % 5 == 0)) for i in range(0, 44, 2)] + [(4, 0, 1), (None, 1, 1), (6, None, None), (10**6, 1, 1)]


@pytest.fixture(scope="module")
def filter_docs(rows):
    extra = [(200 + i, t, lang, None, None) for i, (t, lang) in enumerate([("A# b", "en"), ("A# b", None), ("A# b", ""), ("UP " * 250, "de"), ("x" * 10 + "|", "de"), ("", "de"), (None, "fr"), ("w\x0bv\x0cu\x1ct\x85s " * 100, "fr")])]
    return rows + extra + extra[:2] + [(None, "A# b", "en", None, None)]


def test_filter_audit_equals_brute_force(spark, filter_docs):
    df = spark.createDataFrame(filter_docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    for c in ("A", "n", "e", "part", "digest", "good", "_words", "_text", "_none"):
        df = df.withColumn(c, F.lit("clash"))
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int").withColumn("good", F.lit("clash"))
    got = Counter(tuple(r[n] for n in AUDIT) for r in collect(filters.audit(filters.joint_failures(df, labels))))
    assert got == brute_audit(filter_docs, LABELS)
    assert filters.joint_failures(df.where("false"), labels).count() == 0


def test_filter_audit_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    cols = ", ".join(AUDIT)
    want = Counter(con.execute(f"select {cols} from ({filters.ORACLE_SQL})").fetchall())
    assert Counter(tuple(r[n] for n in AUDIT) for r in collect(filters.op12_filter_audit(spark, sf))) == want
    assert len(want) == 600 * con.execute("select count(distinct coalesce(lang, '')) from documents").fetchone()[0]


# byte pairs


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    return t


ODD = ["<|endoftext|>", "a<|startoftext|>b<|endoftext|><|endoftext|>", "<|endoftext", "ΣΑΣ İı ﬁ é é ͸x", "it's IT'S 'Ll we’ll", "\x1c\x85\xa0 x​y", "1²½Ⅷ०", "a" * 40_000, "ab" * 30_000 + "c", "😀" * 500, "\x00\x7f﻿", "-" * 3000 + "!?"]


def test_bpe_equals_the_library(spark, rows, tmp_path):
    docs = rows + [(500 + i, t, None, None, None) for i, t in enumerate(ODD)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("ids", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    t = library()
    want = Counter()
    for r in docs:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in collect(bpe.op13_bpe(spark, str(tmp_path))))
    assert got == want


def test_pair_index_on_random_words(monkeypatch):
    rng, t = random.Random(2), library()
    letters = list("aaabcdefghinst  \n'0é文") + ODD[:3]
    monkeypatch.setattr(bpe, "SLICE", 40)
    monkeypatch.setattr(bpe, "INDEX_SYMBOLS", 50)
    monkeypatch.setattr(bpe, "MOST_WORDS", 300)
    e = bpe.Encoder()
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) for _ in range(2000)]
    for text, ids in zip(texts, e.encode(texts)):
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert bpe.decode(ids, bpe.token_names()) == t.decode(want, skip_special_tokens=False)


def test_every_assigned_character_is_cut_as_in_the_library():
    import unicodedata

    e = bpe.encoder()
    some = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")][::17]
    for c in some:
        text = e.normalize(f"a{c}b1{c}")
        assert e.cut.findall(text) == [text[a:b] for _, (a, b) in e.split(text)]


def test_decoding_passes_over_unknown_ids():
    assert bpe.decode(np.array([49407, 10**6], "<u4").tobytes(), bpe.token_names()) == "<|endoftext|>"


def test_unordered_merges_are_refused():
    with pytest.raises(ValueError):
        bpe.PairIndex([(3, 1), (1, 2)], [4, 3])


def test_bpe_of_no_documents(spark, empty):
    assert bpe.decoded(bpe.encoded(empty)).count() == 0


# expectation over long words, and words in very many chunks


def test_expectations_of_long_words_are_whole(monkeypatch):
    rng = random.Random(3)
    pieces, logp = lattice.vocabulary()
    words = ["".join(rng.choice("aeinrstThe文é") for _ in range(n)) for n in (1, 30, 500, 2500)] + ["ab" * 1000, "x" * 900]
    for word in words:
        found = []
        for most in (10**9, 7, 64, 1000):
            monkeypatch.setattr(lattice, "MOST_CHARS", most)
            counts = [0.0] * len(logp)
            lattice.Lattice(pieces, logp).expect(word, 3.0, counts)
            found.append(np.array(counts))
        for other in found[1:]:
            assert np.abs(other - found[0]).max() <= 1e-9 * max(1, len(word))
    monkeypatch.setattr(lattice, "MOST_CHARS", 10_000)
    counts = [0.0] * len(logp)
    lattice.Lattice(pieces, logp).expect("the cat"[:3] * 33_334, 1.0, counts)
    assert sum(counts) > 0


def test_words_of_many_chunks_are_dealt(spark, docs, monkeypatch):
    def run():
        return sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 5)) for r in collect(lattice.scores(docs, 2000))))

    whole = run()
    monkeypatch.setattr(lattice, "WORD_ROWS", 3)
    assert run() == whole
