"""GIF decoding, license scans, HTML extraction and the pipeline."""

import random
import struct

import numpy as np
import pytest

from tests.llm.conftest import prose
from tidemark.llm import gif, html, licenses
from tidemark.llm.decontam import words


def naive_lzw(data, size, limit):
    """The textbook decoder."""
    bits, pos = int.from_bytes(data, "little"), 0
    clear, width = 1 << size, size + 1
    out, last, dictionary = bytearray(), None, [bytes([i]) for i in range(clear)] + [b"", b""]
    while len(out) < limit and pos + width <= 8 * len(data):
        code = bits >> pos & (1 << width) - 1
        pos += width
        if code == clear:
            width, last, dictionary = size + 1, None, dictionary[: clear + 2]
            continue
        if code == clear + 1:
            break
        word = dictionary[code] if code < len(dictionary) else last + last[:1]
        out += word
        if last is not None and len(dictionary) < 4096:
            dictionary.append(last + word[:1])
        if len(dictionary) == 1 << width and width < 12:
            width += 1
        last = word
    return bytes(out[:limit])


@pytest.mark.parametrize("n", [0, 1, 2, 3, 300, 5000, 60_000])
@pytest.mark.parametrize("alphabet", [1, 2, 40, 256])
def test_lzw_round_trip_and_textbook_decoder(n, alphabet):
    rng = random.Random(n * 1000 + alphabet)
    data = bytes(rng.randrange(alphabet) for _ in range(n))
    stream = gif.lzw_encode(data)
    assert gif.lzw_decode(stream, 8, max(n, 1)).tobytes() == data == naive_lzw(stream, 8, n)


def bit_stream(codes, size):
    """Codes with growing widths and no clear code when the table is full."""
    value = pos = 0
    following, width = (1 << size) + 2, size + 1
    for i, code in enumerate(codes):
        value |= code << pos
        pos += width
        if code == 1 << size:
            following, width = (1 << size) + 2, size + 1
        elif i and codes[i - 1] != 1 << size and following < 4096:
            following += 1
            if following == 1 << width and width < 12:
                width += 1
    return value.to_bytes(pos // 8 + 1, "little")


def test_a_table_left_full_goes_on_with_twelve_bits():
    rng = random.Random(3)
    codes = [256, *[rng.randrange(256) for _ in range(9000)], 257]
    stream = bit_stream(codes, 8)
    assert gif.lzw_decode(stream, 8, 9000).tobytes() == bytes(codes[1:-1])


def image(x, y, w, h, pixels, flags=0, palette=b"", control=None):
    out = b""
    if control:
        disposal, delay, transparent = control
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (transparent is not None), delay, transparent or 0) + b"\0"
    stream = gif.lzw_encode(bytes(pixels))
    blocks = b"".join(bytes([len(b)]) + b for b in (stream[i : i + 255] for i in range(0, len(stream), 255)))
    return out + b"\x2c" + struct.pack("<HHHHB", x, y, w, h, flags) + palette + b"\x08" + blocks + b"\0"


PALETTE = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])
HEAD = b"GIF89a" + struct.pack("<HHBBB", 3, 2, 0x81, 0, 0) + PALETTE


def test_frames_follow_disposal_transparency_and_palettes():
    data = HEAD + image(0, 0, 3, 2, [0] * 6, control=(1, 5, None)) + image(1, 0, 2, 1, [1, 2], control=(3, 7, 2)) + image(0, 1, 1, 1, [0], 0x80, bytes([1, 2, 3, 4, 5, 6]), control=(2, 1, None)) + image(2, 1, 1, 1, [2]) + b"\x21\xfe\x03abc\0\x3b"
    g = gif.decode(data)
    rgb = [[tuple(p) for row in f.pixels[..., :3].tolist() for p in row] for f in g.frames]
    red, green, blue = (255, 0, 0), (0, 255, 0), (0, 0, 255)
    assert g.error is None and [(f.at_ms, f.delay_ms) for f in g.frames] == [(0, 50), (50, 70), (120, 10), (130, 0)]
    assert rgb[0] == [red] * 6
    assert rgb[1] == [red, green, red, red, red, red]  # index 2 is transparent
    assert rgb[2] == [red, red, red, (1, 2, 3), red, red]  # the second image was restored
    assert g.frames[3].pixels[1, 0].tolist() == [0, 0, 0, 0] and rgb[3][5] == blue  # the third was cleared
    assert sum(g.frames[0].histogram()[:8]) == 6 and sum(g.frames[3].histogram()) == 15


def test_interlaced_rows_are_put_in_order():
    order = [*range(0, 10, 8), *range(4, 10, 8), *range(2, 10, 4), *range(1, 10, 2)]
    rows = {y: [y % 4] * 3 for y in range(10)}
    head = b"GIF89a" + struct.pack("<HHBBB", 3, 10, 0x81, 0, 0) + PALETTE
    g = gif.decode(head + image(0, 0, 3, 10, [v for y in order for v in rows[y]], 0x40) + b"\x3b")
    want = np.array([[list(PALETTE[3 * (y % 4) : 3 * (y % 4) + 3])] * 3 for y in range(10)])
    assert (g.frames[0].pixels[..., :3] == want).all()


def test_broken_files_keep_what_they_have(spark):
    whole = gif.encode(bytes(range(192)) * 600)
    assert len(gif.decode(whole).frames) == 3
    cut = gif.decode(whole[: len(whole) // 2])
    assert cut.error and all(f.pixels.shape[2] == 4 for f in cut.frames)
    rows = spark.createDataFrame([(1, whole), (2, None), (3, b""), (4, b"PNG"), (5, whole[:20])], "k bigint, media binary")
    got = gif.frames(rows, "k", "media").select("k", "frame", "error", "at_ms").collect()
    assert sorted((r.k, r.frame, r.at_ms) for r in got if r.k == 1) == [(1, 0, 0), (1, 1, 100), (1, 2, 200)]
    assert all(r.error and r.frame is None for r in got if r.k > 1)


def test_odd_sizes_end_with_an_error():
    picture = image(0, 0, 3, 2, [0] * 6)
    for size in (0, 1, 9, 11, 12, 63, 64, 70, 255):
        at = len(HEAD) + 10
        data = HEAD + picture[:10] + bytes([size]) + picture[11:] + b"\x3b"
        assert data[at] == size and gif.decode(data).error == f"broken: code size {size}"
    vast = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0x81, 0, 0) + PALETTE
    assert "canvas" in gif.decode(vast + picture).error
    assert "image 0" in gif.decode(HEAD + image(0, 0, 65535, 65535, [0] * 6)).error
    assert len(gif.decode(HEAD + picture * 5 + b"\x3b", most_total=18).frames) == 3


def test_templates_are_found_in_noise():
    index = licenses.Index()
    for name, text in licenses.TEMPLATES.items():
        noisy = words(text)
        if len(noisy) > 40:
            noisy = noisy[:10] + [b"changed"] + noisy[11:25] + noisy[27:]
        found = index.search(words(prose(1, 50)) + noisy + words(prose(2, 50)))
        assert [m[0] for m in found] == [name], (name, found)
        assert found[0][1] > 0.9 and found[0][2] == 50 and found[0][3] == 50 + len(noisy)


def test_alignment_equals_full_dynamic_programming():
    rng = np.random.default_rng(4)
    for _ in range(30):
        t = rng.integers(1, 6, 12)
        d = np.concatenate([rng.integers(1, 6, 5), t[:4], rng.integers(1, 6, 1), t[4:], rng.integers(1, 6, 5)])
        score = np.zeros((len(t) + 1, len(d) + 1))
        for i in range(1, len(t) + 1):
            for j in range(1, len(d) + 1):
                score[i, j] = max(0, score[i - 1, j - 1] + (2 if t[i - 1] == d[j - 1] else -1), score[i - 1, j] - 1, score[i, j - 1] - 1)
        matched, first, end = licenses.align(t, d, 5, band=40)
        assert 0 <= first < end <= len(d) and matched * 2 >= score.max()


def test_scan_reports_spans_of_the_text(spark):
    text = "Ünïcode 😀 first. Licensed under the Apache License, Version 2.0. Then more. Released under the MIT License."
    rows = spark.createDataFrame([(1, text), (1, text), (2, None), (3, ""), (None, "plain words")], "doc_id bigint, text string")
    got = licenses.scan(rows).collect()
    hit = [r for r in got if r.doc_id == 1]
    assert len(hit) == 2 and all(r.licenses == "Apache-2.0-notice,MIT-notice" for r in hit)
    assert [text[m.start : m.end] for m in hit[0].matches] == ["Licensed under the Apache License, Version 2.0", "Released under the MIT License"]
    assert all(not r.matches for r in got if r.doc_id != 1)


def page(title, body, nav="Home About", extra=""):
    return f"<html><head><title>x</title><script>if(a<b){{}}</script></head><body><nav>{nav}</nav><div class='ad'>Buy now</div><article><h1>{title}</h1>{body}{extra}</article><section class='comments'><p>nice</p></section><footer>&copy; me</footer></body></html>"


def test_main_text_drops_page_parts():
    got = html.main_text(html.parse(page("A &amp; B", "<p>One  <b>bold</b>\n text<p>Two<br>lines<ul><li>x<li>y</ul>")))
    assert got == "A & B\nOne bold text\nTwo lines\nx\ny"
    assert html.main_text(html.parse("just &lt;text&gt;")) == "just <text>"
    assert html.main_text(html.parse(None)) == html.main_text(html.parse("")) == ""
    assert html.main_text(html.parse("<div>" * 3000 + "deep" + "</div>" * 10)) == "deep"
    assert html.main_text(html.parse("<p>cut <b>of")) == "cut of"
    assert html.main_text(html.parse("<main><header><h2>In</h2></header><p hidden>no</p><aside>no</aside>yes<!-- no --></main>no")) == "In\nyes"


def test_matching_prefers_the_larger_trees():
    left, right = html.parse("<div><p>a</p></div><div><ul><li>b</ul></div>"), html.parse("<div><ul><li>c<li>d</ul></div>")
    pairs = html.match(html.shape(left), html.shape(right))
    assert [(left[i].tag, i, j) for i, j in enumerate(pairs) if j >= 0] == [("#root", 0, 0), ("div", 3, 1), ("ul", 4, 2), ("li", 5, 3)]


def test_constant_nodes_of_a_host_are_template(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div>Share this page</div><div><p>{prose(i, 30)}</p></div><div>Terms</div></body>") for i in range(8)]
    rows += [(100 + i, f"http://copy.example/{i}", f"<body><p>{prose(1, 30)}</p></body>") for i in range(6)]
    rows += [(200, None, "<p>alone"), (201, "http://one.example/", None), (None, "http://h.example/x", f"<body><div>Share this page</div><div><p>{prose(50, 30)}</p></div><div>Terms</div></body>"), rows[0]]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = html.extract(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is None or r.page_id < 100:
            assert r.text == prose(50 if r.page_id is None else r.page_id, 30)
        elif r.page_id < 200:
            assert r.text == prose(1, 30)  # copies are no evidence of a template
        assert r.n_chars == len(r.text)
    assert {r.page_id: r.text for r in got}[200] == "alone" and {r.page_id: r.text for r in got}[201] == ""


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline
    from tidemark.llm import packing, simhash

    docs = [(i, prose(i, 80 + i), "en", "s", 0) for i in range(120)]
    docs += [(200 + i, "bad bad bad !!! " * (20 + i), "en", "s", 0) for i in range(60)]
    docs += [(300, prose(3, 83), "en", "s", 0), (301, prose(0, 40) + " and", "en", "s", 0), (302, prose(400, 90) + " mail jo.doe@site.org", "en", "s", 0), (None, prose(500, 70), None, None, None)]
    at = str(tmp_path)
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(120)] + [(200 + i, 0, 0) for i in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, prose(0, 40))], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    stage, columns = spark.read.parquet(f"{at}/documents.parquet"), None
    kept = {}
    for name, run in corpus_pipeline.STAGES[:-1]:
        columns = columns or stage.columns
        stage = run(spark, stage, at)
        assert stage.columns == columns
        kept[name] = {r.doc_id: r.text for r in stage.collect()}
        stage = spark.createDataFrame(stage.collect(), stage.schema)
    assert not any(i is not None and 200 <= i < 260 for i in kept["quality"]) and len(kept["quality"]) >= 118
    assert 300 not in kept["near_duplicates"] and 3 in kept["near_duplicates"] and None in kept["near_duplicates"]
    assert 301 not in kept["decontamination"] and 0 not in kept["decontamination"] and len(kept["decontamination"]) >= len(kept["near_duplicates"]) - 2
    assert kept["personal_data"][302].endswith("mail <EMAIL>") and set(kept["personal_data"]) == set(kept["decontamination"])
    got = corpus_pipeline.run(spark, at).collect()
    tokens = {i: len(packing.encoder()(t)) + 1 for i, t in kept["personal_data"].items()}
    assert {r.doc_id: r.doc_tokens for r in got} == tokens
    assert simhash.fingerprint(None) == 0


def test_frames_of_long_files_go_on_in_small_batches(monkeypatch):
    import pyarrow as pa

    text = "".join(chr(32 + i * i % 90) for i in range(3_000_000))
    batches = [pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["short", text, None])], ["doc_id", "text"]), pa.RecordBatch.from_arrays([pa.array([4]), pa.array(["short"])], ["doc_id", "text"])]
    digests = lambda: [r for b in gif._digests(gif._frames("media", 1 << 62)(gif._media(batches))) for r in b.to_pylist()]
    whole = digests()
    monkeypatch.setattr(gif, "FRAME_BYTES", 1 << 20)
    sizes = [sum(len(x) for x in b.column("pixels").to_pylist() if x) for b in gif._frames("media", 1 << 62)(gif._media(batches))]
    one = gif.FRAME_ROWS * gif.WIDTH * 4
    assert len(sizes) > 3 and max(sizes) <= (1 << 20) + one and sum(sizes) > 4 * len(text)
    assert digests() == whole and [r["doc_id"] for r in whole] == [1, 2, 3, 4]
    assert [r["n_bytes"] for r in whole] == [5, len(text), 0, 5] and whole[0]["payload_sha256"] == whole[3]["payload_sha256"]
