"""Cases that were once wrong or not covered, each against a plain computation."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from citeloom.llm import language_id, license_scan, media, ngram_join, packing, quality_rules

from test_llm import text_of


@pytest.mark.parametrize(("text", "letter"), [("½ ² Ⅷ", False), ("1 2 3", False), ("_ ٣ ④", False), ("a", True), ("12 日", True), ("²ʰ", True), ("", False)])
def test_letters_are_of_category_l(text, letter):
    assert language_id.has_letter(text) == letter


def test_letterless_texts_are_undetermined(spark):
    rows = [(i, text_of(i), "en") for i in range(40)] + [(100, "½ ² Ⅷ", "en"), (101, "é", "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(frame, language_id.train(frame)).collect()}
    assert found[100] == "und" and found[101] == "en"


def test_training_sample_is_bounded_in_bytes(spark):
    rows = [(i, "some words of a text " * 500, "en") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    picked, languages = language_id.training_rows(frame, "doc_id", "text", "lang", 800, 200_000)
    assert languages == ["en"] and 1 <= picked.count() <= 60


def test_texts_of_no_learned_language_are_rejected(spark):
    rng = np.random.default_rng(1)
    noise = "".join(chr(c) for c in rng.integers(0x400, 0x450, 600))
    letters = "".join(chr(c) for c in rng.integers(97, 123, 900))
    rows = [(i, text_of(i), "en", "s", 1) for i in range(80)] + [(500, noise, None, "s", 1), (501, letters, None, "s", 1), (502, "blue stone", None, "s", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, frame, "").collect()}
    assert kept == {*range(80), 502}


def test_ids_of_any_type(spark):
    good = [(f"g{i}", text_of(i)) for i in range(120)]
    bad = [(f"b{i}", " ".join(w + "###" for w in text_of(i).split())) for i in range(120)]
    frame = spark.createDataFrame(good + bad, "doc_id string, text string")
    labels = spark.createDataFrame([(i, int(i[0] == "g")) for i, _ in good + bad], "doc_id string, quality int")
    verdicts = {r["doc_id"]: r["kept"] for r in quality_rules.quality_verdicts(frame, labels).collect()}
    assert all(kept == (i[0] == "g") for i, kept in verdicts.items())
    copies = spark.createDataFrame([("x", good[0][1]), ("a", good[0][1]), ("m", good[1][1])], "doc_id string, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_jaccard_classes(copies).collect()} == {"x": "a", "a": "a", "m": "m"}


def test_rules_are_accepted_on_held_back_rows_only():
    rng = np.random.default_rng(0)
    x = rng.random(300)
    bad = x > 0.8
    held = np.arange(300) % 3 == 0
    assert quality_rules.sequential_covering({"x": x}, bad, held)
    misled = np.where(held, rng.random(300) < 0.2, bad)  # what grows a rule does not hold on the rows kept back
    assert quality_rules.sequential_covering({"x": x}, misled, held) == []


def test_templates_of_any_length(spark):
    words = [f"word{k}" for k in range(900)]
    long, rng = " ".join(words), np.random.default_rng(2)
    changed = " ".join(w if rng.random() > 0.03 else "other" for w in words)
    rows = [(1, text_of(1) + " " + long), (2, changed), (3, " ".join(words[:500])), (4, text_of(2)), (5, license_scan.TEMPLATES["MIT full text"])]
    found = {(r["doc_id"], r["license"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), texts={"long": long, "MIT": license_scan.TEMPLATES["MIT full text"]}).collect()}
    assert found == {(1, "long"), (2, "long"), (5, "MIT")}


@pytest.fixture(scope="module")
def stated_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abcd'stlrevm \n\t\r 　​12½²٣é日本語🙂.,!?-_", max_size=60) | st.sampled_from(["<|endoftext|>", "a<|endoftext|> b", "'re'S  \n", "   x", "\x00\x1f"]))
def test_packing_ids_are_those_of_the_stated_tokenizer(stated_tokenizer, text):
    assert packing.token_ids(text) == stated_tokenizer.encode(text, add_special_tokens=False).ids


def test_equal_rows_are_spread_over_buckets(spark):
    frame = spark.createDataFrame([(None, "")] * 4000 + [(7, "one text")] * 500, "doc_id long, text string").repartition(3)
    placed = packing.pack(frame).collect()
    assert len(placed) == 4500 and len({(r["sequence_id"], r["offset"]) for r in placed}) == 4500
    batches = packing._pieces(None, 1024, iter([pa.record_batch([pa.nulls(1000, pa.int64()), pa.array([""] * 1000)], names=["id", "text"])]))
    assert len({turn for batch in batches for turn in batch.column("turn").to_pylist()}) == 1000


def direct_hash(samples):
    """The hash by sums over cells and cosines, one coefficient at a time."""
    height, width = samples.shape
    edges = [k * height // media.GRID for k in range(media.GRID)] + [height]
    cells = np.zeros((media.GRID, media.GRID))
    for y in range(media.GRID):
        for x in range(media.GRID):
            rows = samples[edges[y] : edges[y + 1]] if height >= media.GRID else samples[edges[y] : edges[y] + 1]
            cells[y, x] = rows[:, x * width // media.GRID : (x + 1) * width // media.GRID].astype(float).mean()
    low = []
    for u in range(media.LOW):
        for v in range(media.LOW):
            low.append(sum(cells[y, x] * np.cos(np.pi * u * (2 * y + 1) / (2 * media.GRID)) * np.cos(np.pi * v * (2 * x + 1) / (2 * media.GRID)) for y in range(media.GRID) for x in range(media.GRID)))
    bits = [round(c, 6) > round(float(np.median(low)), 6) for c in low]
    return "".join(f"{sum(b << (7 - k) for k, b in enumerate(bits[i : i + 8])):02x}" for i in range(0, 64, 8))


@pytest.mark.parametrize("height", [1, 5, 32, 45, 131])
def test_hash_is_the_signs_of_a_direct_transform(height):
    samples = np.random.default_rng(height).integers(0, 256, (height, media.WIDTH)).astype(np.uint8)
    assert media.cosine_hash(samples) == direct_hash(samples)


def test_inflating_stops_at_the_size_of_the_header():
    import struct
    import zlib

    bomb = zlib.compress(bytes(50_000_000))
    image = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 1, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", bomb) + media._chunk(b"IEND", b"")
    with pytest.raises(media.MediaError):
        media.read_png(image)


def test_small_pages_meet_in_no_hot_key(spark):
    """Equal pages under 100 bytes, null ones among them, are all responses; large copies refer to the first."""
    from citeloom.llm import warc

    rows = [(i, "u", [None, "", "short"][i % 3]) for i in range(300)] + [(1000 + i, "u", "<p>" + "long " * 40) for i in range(5)]
    out = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i] == ("response", None) for i in range(300)) and out[1000] == ("response", None)
    assert all(out[1000 + i] == ("revisit", 1000) for i in range(1, 5))
    sample = warc.train_dictionary(spark.createDataFrame(rows[300:] * 100, "page_id long, url string, html string"))
    assert sample == b""  # copies of one page are one sample, too few to train on


@pytest.mark.parametrize("shape", [(1, 1), (3, 20), (40, 40), (7, 100), (100, 33), (64, 64)])
def test_images_of_any_size_are_hashed(shape):
    samples = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    assert (media.read_png(media.write_png(samples)) == samples).all()
    cells = np.zeros((media.GRID, media.GRID))
    edges = [[k * n // media.GRID for k in range(media.GRID)] + [n] for n in shape]
    for i in range(media.GRID):
        for j in range(media.GRID):
            (a, b), (c, d) = edges[0][i : i + 2], edges[1][j : j + 2]
            cells[i, j] = samples[a : max(b, a + 1), c : max(d, c + 1)].mean()
    k, x = np.arange(media.LOW)[:, None], np.arange(media.GRID)[None, :]
    basis = np.cos(np.pi * k * (2 * x + 1) / (2 * media.GRID))
    low = (basis @ cells @ basis.T).ravel()
    assert media.cosine_hash(samples) == np.packbits(np.round(low, 6) > np.round(np.median(low), 6)).tobytes().hex()


def test_short_and_second_headers_are_refused():
    import struct
    import zlib

    chunk = lambda kind, content: struct.pack(">I", len(content)) + kind + content + struct.pack(">I", zlib.crc32(kind + content))
    image = media.write_png(np.zeros((2, 2), np.uint8))
    sign = image[:8]
    header = chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 0, 0, 0, 0))
    data = chunk(b"IDAT", zlib.compress(bytes(6))) + chunk(b"IEND", b"")
    assert media.read_png(sign + header + data).shape == (2, 2)
    for broken in (sign + chunk(b"IHDR", b"\0\0\0\2") + data, sign + header + header + data, sign + chunk(b"IHDR", struct.pack(">IIBBBBB", 0, 2, 8, 0, 0, 0, 0)) + data):
        with pytest.raises(media.MediaError):
            media.read_png(broken)


def test_revisits_have_their_profile_and_ids_are_whole(spark, tmp_path):
    from citeloom.llm import warc

    raw = warc.record(7, "http://a/", None, "0" * 64, 120, 3)
    headers, block = warc.parse(raw)
    assert headers["warc-profile"] == warc.PROFILE and headers["warc-refers-to"] == "<urn:page:3>" and block == b""
    with pytest.raises(warc.ArchiveError):
        warc.parse(raw.replace(b"WARC-Profile", b"WARC-Else"))
    with pytest.raises(TypeError):
        warc.write_archives(spark.createDataFrame([("x", "u", "h")], "page_id string, url string, html string"), f"file://{tmp_path}")
    assert warc.archive_round_trip(spark.createDataFrame([(5, "u", "h" * 200), (6, "v", "h" * 200)], "page_id int, url string, html string")).where("record_type = 'revisit'").first()["refers_to"] == 5
