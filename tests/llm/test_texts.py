"""Encoders, storage and media: exact round trips, and the libraries' own results."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from densigrid.llm import bpe, dac, jpeg, queries
from densigrid.llm.ship import map_texts
from conftest import DATA

ODD = ["", None, " ", "  a  b ", "a\n\n b", "don't 's  it's\xa0 x", "\x1c \x1c a", "a" * 5000, "日本語 テスト 12３4", "x <|endoftext|> y", "%%%  ***\t\t x  ", "é" * 3000 + " " * 500, "same", "same"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, a repeated and a null id, and columns with clashing names."""
    rows = [(i if i != 12 else 11, t, "en", 1.0, 2, 3) for i, t in enumerate(ODD)] + [(None, "no id", None, 0.0, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, n_tokens int, ids int")


@pytest.fixture(scope="module")
def tables(odd, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    odd.write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def encoder():
    return bpe.load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'stlred.,!ab12é")), max_size=60))
def test_bpe_as_the_library(encoder, library, text):
    ids = encoder.encode(text)
    assert ids == library.encode_ordinary(text)
    assert encoder.decode(ids) == text.encode()


def test_bpe_query(spark, tables, library):
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op1_byte_bpe(spark, tables).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    texts = [t or "" for t in ODD] + ["no id"]
    assert got == sorted((len(i), sha(",".join(map(str, i)).encode()), sha(t.encode())) for t in texts for i in [library.encode_ordinary(t)])


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=60), st.data())
def test_appends_and_edits(encoder, piece, data):
    cut = data.draw(st.integers(0, len(piece)))
    last = encoder.last_tokens(piece[:cut])
    assert encoder.last_tokens(piece, last) == encoder.last_tokens(piece)
    at = data.draw(st.integers(0, len(piece)))
    gone = data.draw(st.integers(0, len(piece) - at))
    new = data.draw(st.binary(max_size=5))
    edited, tokens = encoder.edited(piece, last, at, gone, new)
    assert edited == piece[:at] + new + piece[at + gone :] and tokens == encoder.last_tokens(edited)


def test_an_empty_piece_has_no_last_tokens(encoder):
    new = bpe.PrefixBPE(encoder.ranks, P.PATTERN)  # remembers nothing yet
    assert new.last_tokens(b"") == [] and new.edited(b"", [], 0, 0, b"on") == (b"on", new.last_tokens(b"on")) and new.edited(b"on", new.last_tokens(b"on"), 0, 2, b"") == (b"", [])


def encoders_held(spark):
    """Encoders with their tables that live in the Python workers while another operator works there."""

    def make():
        import gc

        gc.collect()
        n = sum(type(x).__name__ in ("PrefixBPE", "WordTokens") for x in gc.get_objects())
        return lambda texts: {"n": [n] * len(texts)}

    rows = spark.range(64).repartition(8).selectExpr("cast(id as string) AS text")
    return max(r.n for r in map_texts(rows, make, "n long", []).collect())


def test_workers_drop_an_encoder_when_another_operator_works(spark, odd):
    bpe.encode_documents(odd.repartition(8), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, ["doc_id"]).collect()
    assert encoders_held(spark) == 0


def test_what_an_encoder_remembers_is_bounded(encoder):
    tables = (encoder.word, encoder.piece, encoder.heads, encoder.fits)
    assert sum(2 * t.limit for t in tables) <= 1_300_000  # before: 2.2 million entries, some 310 MB


def test_prefix_tokens_are_right_for_every_prefix(encoder):
    piece = b" thinthonrealish"
    last = encoder.last_tokens(piece)
    for n in range(1, len(piece) + 1):
        assert encoder.read_off(last[:n]) == encoder.merged(piece[:n])


def test_growing_text(encoder, library):
    grown, whole = bpe.GrowingText(encoder), ""
    for part in ["Hel", "lo  wor", "ld\n", " and", " it's", "  done "]:
        grown.append(part)
        whole += part
        assert grown.ids() == library.encode_ordinary(whole)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**26), max_size=1500), st.data())
def test_codes(ids, data):
    ids = np.array(ids, np.uint32)
    codes = dac.Codes(dac.pack(ids))
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert codes.between(a, b).tolist() == ids[a:b].tolist()
    if len(ids):
        places = data.draw(st.lists(st.integers(0, len(ids) - 1), max_size=20))
        assert codes.at(np.array(places, np.int64)).tolist() == ids[places].tolist() if places else True


def test_token_files(spark, tables):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = sorted([(11 if i == 12 else i, x or "") for i, x in enumerate(ODD)] + [(-1, "no id")], key=lambda r: (r[0], r[1]))
    want, start = [], 0
    for doc_id, text in rows:
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        want.append((None if doc_id < 0 else doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in queries.op6_addressable_tokens(spark, tables).orderBy("start").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_new_words_of_many_texts_are_one_call():
    from tokenizers import Tokenizer

    words, t = dac.WordTokens(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = [x or "" for x in ODD] + ["l'été, naïve\n 's x\u0303 Ωm \u0120a", "b\n", "'ll  \n  c ", " d'", "x" * 99 + " e"]
    for _ in range(2):  # the second time most words are remembered
        assert [i.tolist() for i in words.encode_all(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    calls, ids = [], words._ids
    words._ids = lambda text: calls.append(text) or ids(text)
    list(words.encode_all([f"new{i} word{i}, nëw{i}" for i in range(50)]))
    assert len(calls) == 51  # the first words, and all others at once; before, one for each word


def test_signs_behind_a_word_are_parted_from_it():
    words, sent = dac.WordTokens(P.path("byte_bpe_50k.json")), []
    ids = words._ids
    words._ids = lambda text: sent.append(text) or ids(text)
    texts = ["x tree, tree. l\u00e9a!! l\u00e9a", "x l\u00e9a. tree!! it's it's,", "x \u0101b, 3. ab\u0301, tree\n, tree,\nTree"] * 2
    got = [i.tolist() for i in words.encode_all(texts)]
    assert got == [words.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    spaced = [x for x in sent if x[:1] == " "]
    assert spaced == [" tree l\u00e9a it's it's, \u0101b, 3. ab\u0301, tree\n, tree,\nTree"]  # before, also "tree," "tree." ...
    assert {x for x in sent if x not in spaced} == {"x", ",", ".", "!!"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("    \n\t',.!ab12\u00e9\u00d7\x0b\x1c\x85\xa0\u2003")), max_size=6))
def test_split_words_in_columns(texts):
    want = [[first, *words] for first, words in map(bpe.spaced_words, texts)]
    assert dac.split_words(pa.array(texts, pa.string())).to_pylist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("    \n\t'stlred.,!ab12é\x1c\x85\u0120")), max_size=30), min_size=1, max_size=6))
def test_texts_together_as_the_library(texts):
    words = dac.load(P.path("byte_bpe_50k.json"))
    assert [i.tolist() for i in words.encode_all(texts)] == [words.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


def test_one_token_without_its_predecessors(spark, odd, tmp_path):
    dac.write_tokens(odd.where("doc_id < 10"), str(tmp_path / "t"), P.path("byte_bpe_50k.json"), 2)
    places = spark.createDataFrame([(7, 0), (7, 100), (3, 9999), (0, 0)], "doc_id long, place long")
    got = {(r.doc_id, r.place): r.id for r in dac.tokens_at(spark.read.parquet(str(tmp_path / "t")), places).collect()}
    ids = dac.load(P.path("byte_bpe_50k.json")).encode(ODD[7]).tolist()
    assert got == {(7, 0): ids[0], (7, 100): ids[100], (3, 9999): None, (0, 0): 2}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 2**32 - 1)), min_size=1, max_size=5))
def test_jpeg_round_trip(sizes):
    payloads = [np.random.default_rng(s).integers(0, 256, 576 * n).astype(np.uint8).tobytes() for n, s in sizes]
    media = jpeg.encode(payloads)
    assert [b"".join(t.tobytes() for *_, t in images) for images in jpeg.decode(media)] == payloads


def test_jpeg_of_other_widths(monkeypatch):
    monkeypatch.setattr(jpeg, "MOST_ROWS", 12)
    payload = np.random.default_rng(1).integers(0, 256, 576 * 40).astype(np.uint8).tobytes()
    media = jpeg.encode([payload])
    images = jpeg.decode(media)[0]
    assert len(images) > 1 and b"".join(t.tobytes() for *_, t in images) == payload


def test_jpeg_with_colour_and_ac_coefficients():
    """An image as cameras write them: 4:2:0 colour, AC coefficients, no restarts; written bit by bit here."""
    dc = jpeg.dht(0x00, {s: 4 for s in range(12)})
    ac = jpeg.dht(0x10, {0x00: 2, 0xF0: 3, 0x01: 3, 0x12: 3, 0x03: 4})
    codes = {0: {s: (n, c) for s, n, c in jpeg.canonical(list(dc[5:21]), list(dc[21:]))}, 1: {s: (n, c) for s, n, c in jpeg.canonical(list(ac[5:21]), list(ac[21:]))}}
    rng = np.random.default_rng(5)
    bits, luma, before = "", [], [0, 0, 0]

    def put(table, symbol, value=0, size=0):
        nonlocal bits
        n, c = codes[table][symbol]
        bits += format(c, f"0{n}b") + (format(value if value > 0 else value + (1 << size) - 1, f"0{size}b") if size else "")

    for _ in range(6):  # 3 x 2 MCUs of 4 + 1 + 1 blocks
        for c in (0, 0, 0, 0, 1, 2):
            v = int(rng.integers(-60, 60))
            d = v - before[c]
            before[c] = v
            put(0, abs(d).bit_length(), d, abs(d).bit_length())
            put(1, 0x12, -3, 2)
            put(1, 0xF0)
            put(1, 0x03, 5, 3)
            put(1, 0x00)
            if c == 0:
                luma.append(v)
    data = int(bits + "1" * (-len(bits) % 8), 2).to_bytes((len(bits) + 7) // 8, "big").replace(b"\xff", b"\xff\x00")
    frame = bytes([0xFF, 0xC0, 0, 17, 8, 0, 32, 0, 48, 3, 1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1])
    quant = b"".join(b"\xff\xdb\x00\x43" + bytes([i]) + bytes([q] * 64) for i, q in ((0, 16), (1, 20)))
    scan = bytes([0xFF, 0xDA, 0, 12, 3, 1, 0, 2, 0, 3, 0, 0, 63, 0])
    image = b"\xff\xd8\xff\xe0\x00\x04xx" + quant + frame + dc + ac + scan + data + b"\xff\xd9"
    [[(width, height, thumb)]] = jpeg.decode([image])
    blocks = np.array(luma).reshape(2, 3, 2, 2).transpose(0, 2, 1, 3).reshape(4, 6)
    assert (width, height) == (48, 32) and thumb.tolist() == np.clip(np.rint(blocks * 2 + 128), 0, 255).astype(int).tolist()
    with pytest.raises(ValueError):
        jpeg.decode([image.replace(b"\xff\xc0", b"\xff\xc2")])


def test_media_query(spark, tables):
    got = {r.doc_id: r for r in queries.op7_jpeg_media(spark, tables).collect()}
    for i, t in enumerate(ODD):
        if i in (11, 12):
            continue
        raw = (t or "").encode()
        padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
    assert got[0].media_sha256 == got[1].media_sha256 and got[0].feature == got[1].feature


def test_empty_table(spark, tmp_path, odd):
    odd.limit(0).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    for q in (queries.op1_byte_bpe, queries.op6_addressable_tokens, queries.op7_jpeg_media, queries.op3_near_duplicates, queries.op4_personal_data, queries.op2_language):
        assert q(spark, str(tmp_path)).count() == 0


def test_documents_round_trip(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = bpe.encode_documents(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, ["doc_id"])
    e = bpe.load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert all(e.decode(r.ids).decode() == texts[r.doc_id] for r in out.collect())
