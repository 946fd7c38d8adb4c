"""JPEG round trips, code lengths against a slow coder, held-out accuracy, and odd inputs."""

import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from arbor.llm import jpeg as j
from arbor.llm import language as lg
from arbor.llm import subword as sw
from arbor.llm import textbytes as tb

ODD = [(1, "x"), (2, None), (2, None), (3, ""), (4, "!?"), (5, "é" * 5000), (None, "word " * 40000), (6, "same"), (6, "same"), (7, "\x00\x00")]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4097, 64 * j.MOST_ROWS + 1])
def test_payloads_come_back(n):
    text = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    media = j.encode(j.pad(text))
    payload, feature = j.describe(media)
    assert payload == j.pad(text) and len(payload) % 64 == 0 and len(payload) > 0
    assert len(feature.split("+")) == -(-len(payload) // (64 * j.MOST_ROWS))


def test_constant_extremes_come_back():
    for byte in (0, 255, 128):
        assert j.describe(j.encode(bytes([byte]) * 128))[0] == bytes([byte]) * 128
    zigzag = bytes([0, 255] * 64)
    assert j.describe(j.encode(zigzag))[0] == zigzag


def test_colour_image_with_ac_and_subsampling():
    """A 32 x 16 image of 4:2:0 written symbol by symbol: the thumbnail is the luminance of its four by two blocks."""
    dc, dl = j._codes(j.DC_COUNTS, j.DC_VALUES)
    ac_counts, ac_values = (0, 2, *[0] * 14), (0x00, 0x11)
    ac, al = j._codes(ac_counts, ac_values)
    bits, rng = "", random.Random(4)
    want = np.zeros((2, 4), dtype=int)
    last = [0, 0, 0]
    for mcu in range(2):
        for comp, x, y in ((0, 0, 0), (0, 1, 0), (0, 0, 1), (0, 1, 1), (1, 0, 0), (2, 0, 0)):
            value = rng.randrange(-60, 60)
            diff, last[comp] = value - last[comp], value
            size = abs(diff).bit_length()
            bits += format(dc[size], f"0{dl[size]}b") + (format(diff if diff > 0 else diff + (1 << size) - 1, f"0{size}b") if size else "")
            for _ in range(rng.randrange(3)):
                bits += format(ac[0x11], f"0{al[0x11]}b") + rng.choice("01")
            bits += format(ac[0], f"0{al[0]}b")
            if comp == 0:
                want[y, mcu * 2 + x] = min(255, max(0, (value * 16 + 1028) >> 3))
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    frame = struct.pack(">BHHB", 8, 16, 32, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    file = b"\xff\xd8" + j._segment(0xDB, bytes([0, 16]) + bytes([1]) * 63) + j._segment(0xFE, b"comment") + j._segment(0xC0, frame)
    file += j._segment(0xC4, bytes([0x00, *j.DC_COUNTS, *j.DC_VALUES, 0x10, *ac_counts, *ac_values])) + j._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    ((width, height, thumb),) = j.thumbnails(file)
    assert (width, height) == (32, 16) and (thumb == want).all()


def test_broken_files_are_refused():
    media = j.encode(bytes(range(64)) * 4)
    for bad in (b"not a jpeg", media[:30], media.replace(b"\xff\xc0", b"\xff\xc2", 1), media[:-20]):
        with pytest.raises(ValueError):
            j.describe(bad)


def test_media_columns_of_odd_texts(spark):
    df = spark.createDataFrame([(i, t, "m") for i, t in ODD], "doc_id long, text string, media string")
    out = j.media_columns(df).collect()
    assert len(out) == len(ODD)
    want = {}
    for i, t in ODD:
        raw = j.pad((t or "").encode())
        want[i, t] = (len((t or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
    for r in out:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == want[r["doc_id"], r["text"]]
        assert (r["media_bytes"], r["media_sha256"]) == (len(r["media"]), hashlib.sha256(bytes(r["media"])).hexdigest())
    assert j.media_columns(df.where("false")).count() == 0


def slow_bits(texts, text):
    """Code length of the bytes of a text under counts of ``texts``: longest context first, escapes by method C, exclusion."""
    counts = {}
    for t in texts:
        s = [-1, -1, -1, *t.encode()]
        for i in range(3, len(s)):
            for k in range(4):
                counts.setdefault(tuple(s[i - k : i]), {}).setdefault(s[i], 0)
                counts[tuple(s[i - k : i])][s[i]] += 1
    total, s = 0.0, [-1, -1, -1, *text.encode()]
    for i in range(3, len(s)):
        gone = set()
        for k in (3, 2, 1, 0, -1):
            if k < 0:
                total += math.log2(256 - len(counts.get((), {})))
                break
            c = counts.get(tuple(s[i - k : i]), {})
            live = {x: n for x, n in c.items() if x not in gone}
            gone |= set(c)
            if not live:
                continue
            n = sum(live.values()) + len(live)
            if s[i] in live:
                total -= math.log2(live[s[i]] / n)
                break
            total -= math.log2(len(live) / n)
    return total


PROBE = ["the chat", "", "é", "zzz qq", "the cat sat on the mat and the rat sat on the hat", "là", "кот и пёс", "猫坐在垫子上", "\x00\x7f~", "кошка the 猫 là"]


def test_code_lengths_equal_a_slow_coder(monkeypatch):
    texts = ["the cat sat on the mat", "a hat that the rat had", "le chat est là", "un été à la mer", "кот сидит на ковре", "猫坐在垫子上，狗也在", ""]
    langs = ["en", "en", "fr", "fr", "ru", "zh", "en"]
    model = lg.fit(texts, langs)
    data, offs = np.frombuffer("".join(PROBE).encode(), dtype=np.uint8), np.cumsum([0, *(len(p.encode()) for p in PROBE)])
    for block in (1 << 20, 7):
        monkeypatch.setattr(tb, "BLOCK", block)
        got = lg.code_lengths(model, data, offs) / lg.SCALE
        for i, p in enumerate(PROBE):
            for k, lang in enumerate(model.languages):
                want = slow_bits([t for t, x in zip(texts, langs, strict=True) if x == lang], p)
                assert abs(got[i, k] - want) < 0.003 * max(1, len(p.encode())), (p, lang)


def test_probabilities_after_a_context_add_up():
    model = lg.fit(["the cat sat on the mat", "that hat", "un été à la mer"], ["en", "en", "fr"])
    for context in (b"", b"t", b"th", b"the", b"xth", b"x", "é".encode(), b"la ", bytes(range(200, 203))):
        texts = [context + bytes([x]) for x in range(256)]
        offs = np.cumsum([0, *map(len, texts)])
        bits = lg.code_lengths(model, np.frombuffer(b"".join(texts), dtype=np.uint8), offs) - lg.code_lengths(model, np.frombuffer(context, dtype=np.uint8), np.array([0, len(context)]))
        assert np.abs(np.exp2(-bits / lg.SCALE).sum(axis=0) - 1).max() < 0.003


def test_places_of_keys():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 40, 5000))
    places = lg.Places(keys)
    assert (places.of(keys) == np.arange(len(keys))).all()
    other = np.setdiff1d(rng.integers(0, 1 << 40, 5000), keys)
    assert (places.of(other) == -1).all() and (lg.Places(keys[:0]).of(keys) == -1).all() and lg.Places(keys[:1]).of(keys[:2]).tolist() == [0, -1]


def test_languages_held_out_and_odd_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = lg.train_on(docs)
    held = lg.identify(docs, model).where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1").select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)
    odd = spark.createDataFrame([(i, t, "s") for i, t in ODD], "doc_id long, text string, score string")
    out = lg.identify(odd, model).collect()
    assert len(out) == len(ODD)
    for r in out:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (r["score"] == 0) == (not letters)
    assert lg.identify(odd.where("false"), model).count() == 0
    none = lg.train_on(docs.where("false"))
    assert {r["lang_pred"] for r in lg.identify(odd, none).collect()} == {"und"}


def test_predictions_ignore_everything_but_the_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = lg.train_on(docs)
    same = docs.selectExpr("doc_id + 1000 as doc_id", "'xx' as lang", "'y' as source", "text")
    a = {r["text"]: r["lang_pred"] for r in lg.identify(docs.select("doc_id", "text"), model).collect()}
    assert all(a[r["text"]] == r["lang_pred"] for r in lg.identify(same, model).collect())


def test_subword_scores_equal_a_plain_average(monkeypatch):
    model = sw.train(["good text here", "BAD!! JUNK!!", "fine words", "BAD!! %%%"], ["1", "0", "1", "0"], sw.SubwordTraining(buckets=256, epochs=3))
    probe = ["good", "", "ab", "BAD!! words and good text", "é"]
    data, offs = np.frombuffer("".join(probe).encode(), dtype=np.uint8), np.cumsum([0, *(len(p.encode()) for p in probe)])
    z = sw.logits(model, data, offs)
    for i, p in enumerate(probe):
        raw = np.frombuffer(p.encode(), dtype=np.uint8)
        ids = np.concatenate([f for f, _ in sw.features(raw, np.array([0, len(raw)]), model.grams, 256)])
        mean = (model.scores[ids, 1] - model.scores[ids, 0]).mean() / sw.FIXED if len(ids) else 0.0
        assert abs((z[i, 1] - z[i, 0]) - (mean + model.bias[1] - model.bias[0])) < 1e-9


def test_quality_held_out_and_odd_texts(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"
    model = sw.train(*sw.labelled_sample(docs, labels.where(f"not ({held})"), "doc_id", "quality"))
    scored = sw.predict(docs.select("doc_id", "text"), model).join(labels.where(held), "doc_id").selectExpr("posterior[1] as score", "quality").collect()
    right = [(r["score"] >= 0.3) == (r["quality"] == 1) for r in scored]
    assert sum(right) >= 0.9 * len(right)
    odd = spark.createDataFrame([(i, t, "p") for i, t in ODD], "doc_id long, text string, posterior string")
    out = sw.predict(odd, model).collect()
    assert len(out) == len(ODD) and all(abs(sum(r["posterior"]) - 1) < 1e-9 for r in out)
    assert len({tuple(r["posterior"]) for r in out if not r["text"]}) == 1
    assert sw.predict(odd.where("false"), model).count() == 0
    assert sw.labelled_sample(docs, labels.where("false"), "doc_id", "quality") == ([], [])
    assert sw.predict(odd, sw.train([], [])).first()["posterior"] == []


def test_repetition_of_unseen_words_is_learned():
    """All pairs of a word with itself share one vector, so repetition is seen in words that the training never held."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6))
    varied = lambda: " ".join(word() for _ in range(40))
    repeated = lambda: " ".join(w for w in (word() for _ in range(8)) for _ in range(5))
    texts = [varied() for _ in range(150)] + [repeated() for _ in range(150)]
    model = sw.train(texts, ["1"] * 150 + ["0"] * 150)
    data, offs = tb.buffers(pa.array([varied() for _ in range(50)] + [repeated() for _ in range(50)]))
    good = sw.probabilities(sw.logits(model, data, offs))[:, 1]
    assert (good[:50] > 0.5).all() and (good[50:] < 0.5).all()


def test_long_texts_are_stored_image_by_image(spark):
    text = bytes(np.random.default_rng(1).integers(32, 127, 3 * tb.BLOCK + 77, dtype=np.uint8))
    row, media = j.store_long(text)
    whole = j.encode(j.pad(text))
    payload, feature = j.describe(whole)
    assert media == whole and row == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(whole), hashlib.sha256(whole).hexdigest(), feature)
    out = j.media_columns(spark.createDataFrame([(1, text.decode()), (2, "x"), (3, text.decode())], "doc_id long, text string")).collect()
    assert [r["media_sha256"] == row[5] for r in out] == [True, False, True]


def test_gradient_descent_equals_a_plain_one():
    p = sw.SubwordTraining(buckets=64, dims=3, epochs=2, grams=(2, 3))
    texts, labels = ["good words here", "bad", "", "çà et là", "bad bad"], ["a", "b", "a", "c", "b"]
    model = sw.train(texts, labels, p)
    rng = np.random.default_rng(p.seed)
    vectors = rng.uniform(-1 / p.dims, 1 / p.dims, (p.buckets, p.dims))
    output, bias, done = np.zeros((3, p.dims)), np.log(np.array([2, 2, 1]) / 5), 0
    for _ in range(p.epochs):
        for i in rng.permutation(5):
            raw = np.frombuffer(texts[i].encode(), dtype=np.uint8)
            ids = np.concatenate([f for f, _ in sw.features(raw, np.array([0, len(raw)]), p.grams, p.buckets)])
            rate, done = p.rate * (1 - done / 10), done + 1
            if not len(ids):
                continue
            mean = sum(vectors[k] for k in ids) / len(ids)
            z = [math.exp(sum(output[c] * mean) + bias[c]) for c in range(3)]
            error = np.array(z) / sum(z) - np.eye(3)["abc".index(labels[i])]
            step = rate * len(set(ids.tolist())) ** 0.5 / len(ids) * (output.T @ error)
            output -= rate * np.outer(error, mean)
            for k in ids:
                vectors[k] -= step
    assert np.abs(model.scores / sw.FIXED - vectors @ output.T).max() < 1e-4


def test_character_grams_equal_plain_ones(monkeypatch):
    texts = ["aé猫b", "", "x", "été là", "日本語の文字"]
    data, offs = np.frombuffer("".join(texts).encode(), dtype=np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    whole = list(sw.features(data, offs, (2, 3), 1 << 20))
    want = [[t[i : i + g] for t in texts for i in range(len(t) - g + 1)] for g in (2, 3)]
    for (ids, n), grams in zip(whole[2:], want, strict=True):
        assert len(ids) == len(grams) == n.sum() and len(set(zip(ids.tolist(), grams, strict=True))) == len(set(grams)) == len(set(ids.tolist()))
    monkeypatch.setattr(tb, "BLOCK", 5)
    parts = list(sw.features(data, offs, (2, 3), 1 << 20))[2:]
    assert sorted(np.concatenate([p[0] for p in parts]).tolist()) == sorted(np.concatenate([w[0] for w in whole[2:]]).tolist())
    assert (sum(p[1] for p in parts) == sum(w[1] for w in whole[2:])).all()
