"""The pipeline over odd tables, and trained operators against plain Python."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, prose
from tidemark.llm import bytestats, langid, lattice, licenses, packing, quality, simhash
from tidemark.llm.decontam import words


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of odd documents with further columns, labels and a benchmark."""
    at = str(tmp_path_factory.mktemp("odd"))
    docs = [(i, prose(i, 80 + i), "en", "s", 0) for i in range(80)] + [(200 + i, "bad bad bad !!! " * (20 + i), "en", "s", 0) for i in range(60)]
    docs += [(5, prose(900, 90), "en", "s", 0), (5, prose(901, 95), None, None, 0), docs[7], docs[7], (None, prose(902, 70), None, None, None), (None, prose(902, 70), None, None, None), (None, None, None, None, None), (301, "", "en", "s", 0), (302, " ".join(prose(950 + i, 400) for i in range(60)) + " mail jo@site.org", "en", "s", 0)]
    names = ["fp", "score", "_score", "_fp", "_component", "_key", "_text", "block", "offset", "start", "key", "run", "window"]
    spark.createDataFrame(docs, SCHEMA).withColumns({n: F.lit("clash") for n in names}).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(80)] + [(200 + i, 0, 0) for i in range(60)] + [(None, 1, 0), (3, None, None), (9999, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, prose(0, 40)), (None, None), (1, prose(0, 40))], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_pipeline_over_odd_rows(spark, tables):
    import corpus_pipeline

    stage = spark.read.parquet(f"{tables}/documents.parquet")
    columns, kept = stage.columns, {}
    for name, run in corpus_pipeline.STAGES[:-1]:
        before = stage
        stage = spark.createDataFrame(run(spark, stage, tables).collect(), before.schema)
        assert stage.columns == columns and stage.where("block <> 'clash' or _key <> 'clash'").isEmpty()
        kept[name] = [(r.doc_id, r.text) for r in stage.collect()]
    fps = [simhash.fingerprint(t) for _, t in kept["quality"]]
    root = list(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            a, b = root[i], root[j]
            root = [a if x == b else x for x in root]
    assert len(kept["near_duplicates"]) == len(set(root))  # one row of each component
    by_component = {}
    for (i, _), k in zip(kept["quality"], root):
        by_component.setdefault(k, []).append(i)
    left = Counter(i for i, _ in kept["near_duplicates"])
    assert left == Counter(min((i for i in ids if i is not None), default=None) for ids in by_component.values())
    assert 0 in left and 0 not in {i for i, _ in kept["decontamination"]}
    assert [t for i, t in kept["personal_data"] if i == 302][0].endswith("mail <EMAIL>")
    encode = packing.encoder()
    want = Counter((i, len(encode(t or "")) + 1) for i, t in kept["personal_data"])
    got = Counter((r.doc_id, r.doc_tokens) for r in corpus_pipeline.STAGES[-1][1](spark, stage, tables).where("start = 0").collect())
    assert got == want


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for name, schema in {"documents": SCHEMA, "benchmark": "item_id bigint, text string", "labels": "doc_id bigint, quality int, toxic int"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_lattice_scores_equal_a_sum_over_segmentations(spark, tmp_path):
    """op9's score of every document from the pieces' expected counts, in plain Python."""
    texts = ["the river the light", "light Light", "", None, "the zz é"]
    docs = list(enumerate(texts))
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in lattice.op9_lattice_lm(spark, str(tmp_path)).collect()}
    pieces, first = lattice.vocabulary()
    number = dict(pieces)

    def paths(s, logp):
        """(log-probability, pieces) of every segmentation; characters without a piece are bytes."""
        if not s:
            return [(0.0, ())]
        out = [(logp[number[s[:n]]] + p, (number[s[:n]], *rest)) for n in range(1, len(s) + 1) if s[:n] in number for p, rest in paths(s[n:], logp)]
        if s[0] not in number:
            b = tuple(s[0].encode())
            out += [(sum(logp[x] for x in b) + p, (*b, *rest)) for p, rest in paths(s[1:], logp)]
        return out

    tokens = [[w.decode() for w in lattice.tokens(t)] for t in texts]
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in docs]
    counts = Counter(w for t, use in zip(tokens, train) if use for w in t)
    expected = np.zeros(len(first))
    for w, n in counts.items():
        every = paths("▁" + w, first)
        total = sum(math.exp(p) for p, _ in every)
        for p, used in every:
            for x in used:
                expected[x] += n * math.exp(p) / total
    expected[-1] = sum(train)
    logp = np.log((expected + lattice.PRIOR * np.exp(first)) / (expected.sum() + lattice.PRIOR))
    for (i, _), t in zip(docs, tokens):
        want = logp[-1] + sum(math.log(sum(math.exp(p) for p, _ in paths("▁" + w, logp))) for w in t)
        assert got[i] == pytest.approx(want / math.log(10), rel=1e-9)


def test_licenses_equal_an_unbanded_alignment(spark):
    """A match of each document covers as much as full dynamic programming finds."""
    rng = np.random.default_rng(7)
    names = sorted(licenses.TEMPLATES)
    docs = []
    for i in range(40):
        body = [w.decode() for w in words(licenses.TEMPLATES[names[i % len(names)]])]
        if len(body) > 30:
            for at in sorted(rng.choice(len(body), 3, replace=False), reverse=True):
                body[at : at + 1] = [["swapped"], [], [body[at], "added"]][int(rng.integers(3))]
        docs.append((i, f"{prose(i, 30)} {' '.join(body)} {prose(i + 99, 30)}"))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    for i, text in docs:
        template, found = words(licenses.TEMPLATES[names[i % len(names)]]), words(text)
        best = np.zeros((len(template) + 1, len(found) + 1), int)  # longest common subsequence
        for a, x in enumerate(template, 1):
            for b, y in enumerate(found, 1):
                best[a, b] = best[a - 1, b - 1] + 1 if x == y else max(best[a - 1, b], best[a, b - 1])
        # noise shares words such as "the": they may lengthen a subsequence, not an alignment
        mine = [m for m in got[i].matches if m.license == names[i % len(names)]]
        assert len(mine) == 1 and len(template) - 4 <= mine[0].matched <= best[-1, -1]


def test_language_and_quality_equal_plain_python(spark, tmp_path):
    docs = [(i, prose(i, 60) if i % 2 else "der fluss und das licht der steine im garten " * (1 + i % 3), "en" if i % 2 else "de") for i in range(120)]
    docs += [(500, prose(1, 200_000), "en"), (501, "bad !!! " * 300_000, "de")]  # long texts
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, i % 2, 0) for i in range(120)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in langid.op3_langid(spark, str(tmp_path)).collect()}
    train = sorted((r for r in docs if zlib.crc32(str(r[0]).encode()) % 5), key=lambda r: (r[2], langid.features([r[1]]).astype(np.float16).tobytes()))
    model = langid.Model(np.concatenate([langid.features([r[1]]) for r in train]).astype(np.float16).astype(np.float32), [r[2] for r in train])
    best, score, _ = model.decode(np.concatenate([langid.features([r[1]]) for r in docs]))
    for r, k, s in zip(docs, best, score):
        assert got[r[0]].lang_pred == model.langs[k] == r[2] and got[r[0]].score == pytest.approx(float(s), abs=1e-3)
    scored = {r.doc_id: r for r in quality.op4_quality(spark, str(tmp_path)).collect()}
    fitted = quality.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    for i, text, _ in docs:
        x, count = bytestats.passages([text.encode()])
        assert scored[i].score == pytest.approx(float(fitted.forward(fitted.scaled(x), count)["y"][0]), abs=1e-4)
        assert scored[i].predicted == int(scored[i].score >= 0.3)
