"""Each operator against plain Python over odd rows: nulls, empties, copies, long texts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import common, decontam, gif, langid, lattice, packing, pii, quality, simhash
from tidemark.llm.queries import queries


def collect(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(rows):
    """{row number: least id reachable}."""
    fps = [brute_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        k = find(i)
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    return fps, [least.get(find(i)) for i in range(len(rows))], [find(i) for i in range(len(rows))]


def test_simhash_matches_brute_force(spark, sf_dir, rows):
    fps, least, _ = brute_components(rows)
    want = Counter((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, least))
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in collect(simhash.op6_simhash(spark, sf_dir)))
    assert got == want


def test_simhash_keeps_one_row_of_each_component(clashing, rows):
    _, _, component = brute_components(rows)
    kept = collect(simhash.one_of_each(clashing))
    assert len(kept) == len(set(component))
    assert set(kept[0]) == set(clashing.columns)


def test_links_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 6), replace=False))) for b in base for _ in range(4)]
    every = sorted({int(x) for x in np.array([*base, *near], np.uint64).view(np.int64)})
    df = spark.createDataFrame([(x,) for x in every], "fp bigint")
    got = {tuple(r) for r in map(sorted, simhash.links(df).collect())}
    mask = (1 << 64) - 1
    assert got == {(a, b) for i, a in enumerate(every) for b in every[i + 1 :] if ((a ^ b) & mask).bit_count() <= 3}


def test_the_bound_rejects_and_never_loses(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    flips = [sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in x]
    y = x ^ np.array(flips, np.uint64)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x.view(np.int64), y.view(np.int64))], "a bigint, b bigint")
    m = simhash.manhattan(simhash.counts_of(F.col("a")), simhash.counts_of(F.col("b")))
    got = df.select("a", "b", m.alias("m"), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("h")).collect()
    fields = lambda v: [(v >> 2 * i & 1) + (v >> 2 * i + 1 & 1) for i in range(32)]
    mask = (1 << 64) - 1
    assert all(r.m == sum(abs(p - q) for p, q in zip(fields(r.a & mask), fields(r.b & mask))) <= r.h for r in got)
    dense = spark.range(3000).select(F.col("id").alias("fp"))  # neighbours everywhere: cells hold far pairs too
    met = simhash.candidates(dense)
    near = met.where(simhash.manhattan(F.col("x.v"), F.col("y.v")) <= 3)
    assert met.count() > near.count() > simhash.links(dense).count()


def test_random_fingerprints_meet_few_candidates(spark):
    n = 50_000
    some = spark.range(n).select(F.xxhash64("id").alias("fp")).distinct()
    assert simhash.candidates(some).count() < n


def test_hub_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(common, "HUB", 10)
    rows = spark.range(300).select((F.col("id") % 7 * (F.col("id") % 2)).alias("k"), "id")
    per = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("m"))
    assert {(r.k, r.id, r.m) for r in common.hub_join(rows, per, "k").collect()} == {(r.k, r.id, r.m) for r in rows.join(per.drop("n"), "k").collect()}
    edges = [(0, i) for i in range(1, 80)]
    assert {r.component for r in common.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()} == {0}


def test_hot_cells_give_the_same_components(spark, monkeypatch):
    base = 0x0123456789ABCDEF
    every = sorted({base ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i, 20)})
    df = spark.createDataFrame([(x,) for x in every], "fp bigint")
    whole = {r.node: r.component for r in common.connected_components(simhash.links(df)).collect()}
    monkeypatch.setattr(simhash, "HOT", 8)
    assert {r.node: r.component for r in common.connected_components(simhash.links(df)).collect()} == whole


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}


def lowered(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_overlap(text, items):
    w = lowered(text)
    hit, found = set(), set()
    for item, t in items:
        b = lowered(t)
        n = min(13, len(b))
        for i in range(len(b) - n + 1 if b else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == b[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add("null" if item is None else str(item))
    return len(w), len(hit), sorted(found)


def test_decontamination_matches_brute_force(spark, sf_dir, rows, monkeypatch):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = Counter()
    for r in rows:
        if len(r[1] or "") < 20_000:
            n, h, found = brute_overlap(r[1], items)
            want[r[0], n, h, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), h > 0 and 20 * h >= n] += 1
    for bits in (1 << 28, 64):  # a filter that hardly errs, and one that lets nearly everything pass
        monkeypatch.setattr(decontam, "FILTER_BITS", bits)
        got = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in collect(decontam.op10_decontamination(spark, sf_dir)) if r["n_words"] < 5000)
        assert got == want


def test_decontamination_of_random_texts(spark):
    rng = np.random.default_rng(6)
    word = lambda n: " ".join(rng.choice(list("abc"), n))  # noqa: E731  three words: windows recur everywhere
    items = [(i, word(n)) for i, n in enumerate((1, 4, 5, 6, 13, 14, 30))] + [(7, word(20)), (7, word(20))]
    docs = [(i, word(int(rng.integers(0, 60))) + " z " + items[i % 9][1] + " y " + word(5)) for i in range(40)]
    got = decontam.overlaps(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = {i: brute_overlap(t, items) for i, t in docs}
    assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in got} == want
    texts = dict(docs)
    for r in got:
        w = lowered(texts[r.doc_id])
        assert {" ".join(w[s.start : s.end]) for s in r.spans} <= {" ".join(lowered(t)[j : j + 13]) for _, t in items for j in range(max(1, len(lowered(t)) - 12))}


def test_packing_is_lossless(spark, sf_dir, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in rows:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        for start, n in packing.cuts(len(ids)):
            want[r[0], start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids)] += 1
    got = collect(packing.op8_packing(spark, sf_dir))
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048


def test_ids_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(3)
    odd = ["hello <|endoftext|> x", "<|endoftext|>", "it's they'll 's'S \n\n x \t\r\n  y   ", "\x1c\x1d\x85\xa0 a\u2003b\u3000 c", "½²३ x_1 __a", "a" * 3000 + " b", "\U000107bb\u0558 ab", "", " ", "\n"]
    for size, top in ((40, 128), (60, 0x250), (60, 0xD800), (40, 0x30000)):
        odd += ["".join(chr(c) for c in rng.integers(0, top, size) if not 0xD800 <= c < 0xE000) for _ in range(300)]
        odd += ["".join(rng.choice(list("a1 \n\t'.sl\x1f"), size)) for _ in range(100)]
    encode = packing.Encoder()
    for text in odd:
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_equal_rows_spread_over_blocks(spark):
    rows = spark.range(20_000).select(F.lit(5).cast("bigint").alias("doc_id"), F.lit("the same few words").alias("text"))
    got = packing.packed(rows).groupBy(F.shiftright("sequence_id", 32).alias("block")).agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in got) == 20_000 and len(got) >= 18 and max(r.n for r in got) < 2 * packing.BLOCK_PIECES


@pytest.mark.parametrize("seed", range(5))
def test_differencing_respects_the_capacity(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 2049, int(rng.integers(0, 300)))
    window = packing.pack(lengths)
    sums = np.bincount(window, weights=lengths) if len(lengths) else np.zeros(0)
    assert (sums <= 2048).all()
    items = lengths[lengths < 2048]
    found, total = packing.difference(items, 1 + int(items.sum()) // 2048)
    assert sorted(np.bincount(found, weights=items, minlength=0)[np.bincount(found, minlength=0) > 0].astype(int)) == sorted(total.tolist())


def test_lattice_base_scores_and_marginals(spark, sf_dir, rows):
    tok = lattice.tokens
    fold = lambda i: zlib.crc32(("null" if i is None else str(i)).encode()) % 7 == 2
    c = Counter()
    for r in rows:
        if not fold(r[0]):
            c.update([*tok(r[1]), None])
    n, v = sum(c.values()), len(c)
    want = sorted((str(r[0]), len(tok(r[1])) + 1, sum(c[w] > 0 for w in [*tok(r[1]), None]), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*tok(r[1]), None]), 6)) for r in rows)
    got = collect(lattice.scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), chunk_bytes=3000))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)


def test_lattice_sums_all_segmentations():
    pieces = [("▁", 256), ("a", 257), ("b", 258), ("▁a", 259), ("ab", 260), ("▁ab", 261)]
    p = np.full(263, 1e-4)
    p[256:262] = [0.1, 0.2, 0.05, 0.15, 0.03, 0.02]
    model = lattice.Lattice(pieces, np.log(p))
    want = 0.02 + 0.15 * 0.05 + 0.1 * 0.03 + 0.1 * 0.2 * 0.05
    assert math.exp(model.score("ab")) == pytest.approx(want)
    counts = np.zeros(263)
    model.expect("ab", 2.0, counts)
    assert counts[261] == pytest.approx(2 * 0.02 / want)
    assert math.exp(model.score("é")) == pytest.approx(0.1 * 1e-8)  # two byte pieces


KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, rx in KINDS:
        for m in re.finditer(rx, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


HARD = [
    "mail a@b.co+x@y.zz, a.b%c@d-e.f.g. and @no.one a@b a@@b.c x@y..z é@ü.de 😀u@v.w",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.255 1.2.3 99999999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1234567890123 0000000000000 5 12",
    "+1 (555) 010-9999 +49.89.636.48018 ++1234567890 +12345 +1 23456789012345678 + 1",
    "call me (555) 123-4567 or 555-123-4567, order 555 123 4567; jo (at) site (dot) org",
    None, "", "no data", "a.b" * 3000 + "@x." + "y." * 3000 + "z", "7 " * 4000, "@" * 2000, "1." * 4000,
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(HARD)] + [(0, HARD[0]), (None, HARD[2])], "doc_id bigint, text string")


def test_base_spans_equal_the_patterns(hard, spark, tmp_path):
    hard.write.parquet(f"{tmp_path}/documents.parquet")
    for r in collect(pii.op7_pii(spark, str(tmp_path))):
        want = brute_spans(HARD[2] if r["doc_id"] is None else HARD[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (r, want)
        assert [r[f"n_{k}"] for k, _ in KINDS] == [sum(x.startswith(k + ":") for x in want) for k, _ in KINDS]
        assert set(want) <= set(filter(None, r["spans"].split(",")))
        starts = [(["email", "ip", "card", "phone"].index(k), int(s)) for k, s, _ in (x.split(":") for x in filter(None, r["spans"].split(",")))]
        assert starts == sorted(starts)


def test_redaction_leaves_no_base_span(hard):
    rows = {r["doc_id"]: r["text"] for r in collect(pii.redacted(hard)) if r["doc_id"] is not None}
    assert rows[7] == "no data" and rows[5] is None and rows[6] == ""
    assert all(not brute_spans(t) for i, t in rows.items() if i < 8)
    assert "<EMAIL>" in rows[0] and "<PHONE>" in rows[3]


def test_em_finds_the_unreliable_labeler():
    rng = np.random.default_rng(1)
    rates = [(0.05, 0.95), (0.2, 0.85), (0.3, 0.9), (0.5, 0.5)]
    counts = Counter()
    for _ in range(20_000):
        kind = "phone" if rng.random() < 0.5 else "email"
        true = rng.random() < (0.7 if kind == "phone" else 0.2)
        votes = tuple(-1 if j == 3 and rng.random() < 0.4 else int(rng.random() < r[int(true)]) for j, r in enumerate(rates))
        counts[kind, votes] += 1
    rate, prior, post = pii.reliabilities([(k, v, n) for (k, v), n in sorted(counts.items())])
    for got, want in zip(rate, rates):
        assert got[0] == pytest.approx(want[0], abs=0.05) and got[1] == pytest.approx(want[1], abs=0.05)
    assert prior["phone"] == pytest.approx(0.7, abs=0.05) and prior["email"] == pytest.approx(0.2, abs=0.05)
    assert pii.reliabilities([])[2] == []


def test_the_classifier_accepts_and_rejects_loose_spans(spark):
    rows = []
    for i in range(60):
        rows += [f"mail jo{i}@site.org or call +1 555 010 {1000 + i}", f"phone (415) 555-{1000 + i} please", f"order 155 123 {2000 + i} shipped", f"contact ann{i} (at) mail (dot) org", f"x{i} at y dot zz"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in pii.spans(df).collect()}
    kinds = lambda i: [k for k in pii.KINDS if found[i][f"_{k}"]]
    for i in range(0, 300, 5):
        assert kinds(i) == ["email", "phone"] and kinds(i + 1) == ["phone"] and kinds(i + 2) == [] and kinds(i + 3) == ["email"] and kinds(i + 4) == []
        s = found[i + 1]["_phone"][0]
        assert rows[i + 1][s.start : s.end].startswith("(415)")


def test_prefix_chunks_and_bisection(spark):
    rng = np.random.default_rng(2)
    values = [rng.integers(0, 9, n).tolist() for n in (0, 1, 63, 64, 65, 500)]
    df = spark.createDataFrame([(v,) for v in values], "v array<bigint>")
    for r in df.select("v", pii.prefix(F.col("v"), lambda a, b: a + b).alias("s"), pii.prefix(F.col("v"), lambda a, b: F.greatest(a, b)).alias("m")).collect():
        assert r.s == [sum(r.v[:i]) for i in range(len(r.v))] and r.m == [max(r.v[:i], default=0) for i in range(len(r.v))]
    text = "é😀x" * 5000
    at = [(0, 0), (0, 1), (511, 512), (511, 513), (512, 1024), (4095, 4096), (4095, 4097), (4096, 8192), (10, 14_999), (5000, 15_000), (14_999, 15_000)]
    got = spark.createDataFrame([(text, a, b) for a, b in at], "t string, a bigint, b bigint").select(pii.piece(pii.chunked(F.col("t")), F.col("a"), F.col("b")).alias("p"), "a", "b").collect()
    assert all(r.p == text[r.a : r.b] for r in got)
    others = [(i * 10, i * 10 + 4) for i in range(50)]
    asked = [(a, a + n) for a in range(-3, 505, 3) for n in (1, 5, 30)]
    df = spark.createDataFrame([(others, s, e) for s, e in asked], "o array<struct<start:bigint,end:bigint>>, start bigint, end bigint")
    for r in df.select("start", "end", pii.free_of(F.struct("start", "end"), F.col("o")).alias("f")).collect():
        assert r.f == all(b <= r.start or a >= r.end for a, b in others)


def test_a_long_text_with_many_spans_is_quick(spark, tmp_path):
    import time

    text = " ".join(f"jo{i}@site{i}.org 10.0.{i % 250}.7 +1555010{i:05d}" for i in range(20_000))
    spark.createDataFrame([(1, text)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    (r,) = pii.op7_pii(spark, str(tmp_path)).collect()
    assert (r.n_email, r.n_ip, r.n_phone) == (20_000, 20_000, 20_000) and r.base_sha256 == hashlib.sha256(",".join(brute_spans(text)).encode()).hexdigest()
    (clean,) = pii.redacted(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    assert clean.text == " ".join(["<EMAIL> <IP> <PHONE>"] * 20_000)
    assert time.time() - began < 120


def test_gif_queries_round_trip(spark, sf_dir, rows):
    got = Counter((r["doc_id"], r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in collect(gif.op1_gif(spark, sf_dir)))
    want = Counter()
    for r in rows:
        data = (r[1] or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        want[r[0], len(data), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])] += 1
    assert got == want


def test_long_texts_are_read_in_slices(monkeypatch):
    from tidemark.llm import bytestats

    text = " ".join(f"word{i} ünd" for i in range(4000)).encode()
    whole = bytestats.ngram_counts([text], 512)
    monkeypatch.setattr(bytestats, "GROUP_BYTES", 1000)
    assert (bytestats.ngram_counts([text], 512) == whole).all()
    monkeypatch.setattr(bytestats, "GROUP_BYTES", 2048)
    x, count = bytestats.passages([text])
    assert count.tolist() == [len(x)] == [-(-len(text) // bytestats.PASSAGE_BYTES)]
    assert len(quality.spread(x, 5)) == 5 and len(quality.spread(x[:3], 5)) == 3
    pieces = [("a", 256), ("aa", 257), ("\u2581", 258)]
    model = lattice.Lattice(pieces, np.log(np.full(259, 0.3)))
    counts = [0.0] * 259
    model.expect("a" * 25_000, 1.0, counts)
    assert counts[256] + 2 * counts[257] == pytest.approx(25_000) and model.score("a" * 200_000) < 0


def test_every_query_takes_empty_tables(spark, tmp_path):
    schemas = {"documents": "doc_id bigint, text string, lang string, source string, n_chars bigint", "benchmark": "item_id bigint, text string", "labels": "doc_id bigint, quality int, toxic int", "pages": "page_id bigint, url string, html string", "conversations": "conv_id bigint, turn bigint, role string, text string"}
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, run in queries().items():
        assert run(spark, str(tmp_path)).count() == 0, name


def test_extra_columns_do_not_clash(clashing, docs):
    from tidemark.llm import licenses

    n = docs.count()
    assert pii.spans(clashing).count() == n
    assert lattice.scores(clashing).count() == n
    assert licenses.scan(clashing).count() == n
    assert quality.scored(clashing, None).count() == n
    assert quality.accepted(clashing, None).columns == simhash.one_of_each(clashing).columns == pii.redacted(clashing).columns == clashing.columns
    assert pii.redacted(clashing).where("_email = 'clash' and _key = 'clash'").count() == quality.accepted(clashing, None).where("_score = 'clash'").count() == n
    nothing = clashing.limit(0).select(F.col("doc_id").alias("item_id"), "text")
    assert decontam.overlaps(clashing, nothing).count() == n
    assert decontam.clean_of(clashing, nothing).columns == clashing.columns
    assert packing.packed(clashing).where("start = 0").count() == n


def test_langid_learns_and_abstains(spark, tmp_path):
    en, de = "the house of the river and the light ", "der fluss und das licht der steine "
    rows = [(i, (en if i % 2 else de) * (1 + i % 5), "en" if i % 2 else "de") for i in range(200)]
    rows += [(900, None, "en"), (901, "123 !!", "en"), (902, en, None), (None, de, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in collect(langid.op3_langid(spark, str(tmp_path)))}
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[900]["score"] == 0
    assert got[902]["lang_pred"] == "en" and got[None]["lang_pred"] == "de"
    held = [r for r in got.values() if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 200]
    assert held and all(r["lang_pred"] == ("en" if r["doc_id"] % 2 else "de") and 0 <= r["score"] <= 1 for r in held)


@pytest.mark.parametrize("n", [2, 3, 12])
def test_codewords_are_far_apart(n):
    code = langid.codewords(n)
    assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= code.shape[1] // 4
    assert (np.abs(code.sum(0)) < n).all()


def test_attention_gradients():
    rng = np.random.default_rng(0)
    model = quality.Attention(np.zeros(quality.FEATURES), np.ones(quality.FEATURES))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, count, y = rng.standard_normal((7, quality.FEATURES)) * 0.1, np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])
    loss = lambda: float(np.mean([-np.log(p if t else 1 - p) for p, t in zip(model.forward(x, count)["y"], y)]))
    grads = model.gradients(x, count, y)
    for name, at in (("E", (3, 2)), ("V", (1, 4)), ("U", (2, 3)), ("w", (5,)), ("c", (0,)), ("e", (1,)), ("b", (0,))):
        keep, h = model.p[name][at], 1e-5
        model.p[name][at] = keep + h
        up = loss()
        model.p[name][at] = keep - h
        down = loss()
        model.p[name][at] = keep
        assert grads[name][at] == pytest.approx((up - down) / (2 * h), abs=2e-5), name


def test_quality_learns_from_labels(spark, tmp_path):
    from tests.llm.conftest import prose

    docs = [(i, prose(i, 80) if i % 2 else "bad bad bad !!! " * 30) for i in range(300)] + [(900, None), (None, "")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = collect(quality.op4_quality(spark, str(tmp_path)))
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 300]
    assert held and sum(r["predicted"] == r["doc_id"] % 2 for r in held) >= 0.95 * len(held)
    assert len(got) == 302 and all(0 <= r["score"] <= 1 for r in got)
