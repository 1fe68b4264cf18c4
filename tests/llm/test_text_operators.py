"""Languages, quality and secrets: held-out accuracy, planted cases, edges."""

import base64
import bz2
import gzip
import lzma
import random
import re
import zlib
from urllib.parse import quote

import numpy as np
import pytest
from pyspark.sql import functions as F

from netstate.llm import language, quality, secret_scan

VOICES = {
    "en": "the and of that with this which from have were their would about there could".split(),
    "de": "der und nicht mit eine auch werden über nach können schön zwischen müssen".split(),
    "fr": "les des une dans pour être avec où très même après français était leur".split(),
}


def prose(rng, lang, n):
    return " ".join(rng.choice(VOICES[lang]) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        lang = rng.choice(list(VOICES))
        rows.append((i, prose(rng, lang, rng.randrange(4, 60)), lang, lang))
    rows += [(1000, None, "en", None), (1001, " 12 !? ", "en", None), (1002, "", None, None),
             (None, prose(rng, "fr", 20), "en", "fr"), (1003, prose(rng, "de", 3000), None, "de")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")


def test_languages(spark, labelled):
    docs = labelled.withColumn("language", F.lit("clash"))
    got = language.identify(docs, language.fit(docs)).withColumn(
        "held", language.held_out(F.col("doc_id"))).collect()
    assert len(got) == 305
    for r in got:
        assert r.language.lang == (r.truth or "und")
        assert 0 <= r.language.score <= 1 and (r.truth is None) == (r.language.score == 0)
        if r.doc_id is not None:
            assert r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_a_document_of_five_languages(spark):
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    voices = {f"x{i}": ["".join(rng.choice(letters[5 * i:5 * i + 6]) for _ in range(
        rng.randrange(3, 8))) for _ in range(40)] for i in range(5)}
    rows = [(100 * n + i, " ".join(rng.choice(words) for _ in range(60)), lang)
            for n, (lang, words) in enumerate(voices.items()) for i in range(30)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    text = " ".join(rng.choice(words) for words in voices.values() for _ in range(40))
    got = language.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model)
    found = got.first().language
    assert sorted(found.languages) == sorted(voices)
    assert all(abs(s - 0.2) < 0.05 for s in found.shares)


def slow_mixture(log_p, allowed):
    """Expectation-maximisation of one document, word by word."""
    share = [1 / sum(allowed) if a else 0.0 for a in allowed]
    for _ in range(language.ROUNDS):
        total = [0.0] * len(share)
        for row in log_p:
            parts = [s * np.exp(x) for s, x in zip(share, row, strict=True)]
            for i, p in enumerate(parts):
                total[i] += p / sum(parts)
        share = [t / len(log_p) for t in total]
    return share, sum(np.log(sum(s * np.exp(x) for s, x in zip(share, row, strict=True)))
                      for row in log_p)


def test_mixture_equals_a_slow_one():
    rng = np.random.default_rng(5)
    sizes = np.asarray([1, 7, 30])
    log_p = rng.normal(-9, 3, (sizes.sum(), 4)).astype(np.float32)
    at = np.asarray([0, 1, 8])
    allowed = np.asarray([[1, 1, 1, 1], [1, 0, 1, 1], [0, 1, 1, 0]], np.float32)
    share, likely = language.mixture(log_p, at, sizes, allowed)
    for i, (a, n) in enumerate(zip(at, sizes, strict=True)):
        want, value = slow_mixture(log_p[a:a + n].astype(float).tolist(), allowed[i].tolist())
        assert np.allclose(share[i], want, atol=1e-4) and abs(likely[i] - value) < 1e-2


def test_mixed_languages(spark, labelled):
    rng = random.Random(6)
    model = language.fit(labelled)
    mixed = [(1, prose(rng, "en", 60) + " " + prose(rng, "fr", 30)), (2, prose(rng, "en", 90))]
    got = {r.doc_id: r.language for r in language.identify(
        spark.createDataFrame(mixed, "doc_id long, text string"), model).collect()}
    assert got[1].languages == ["en", "fr"] and abs(got[1].shares[0] - 2 / 3) < 0.1
    assert got[2].languages == ["en"]


def test_no_language_is_known(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert language.identify(docs, model).first().language.lang == "und"
    assert language.identify(docs.where("false"), model).count() == 0


def test_prediction_ignores_label_source_and_id(spark, labelled):
    model = language.fit(labelled)
    other = labelled.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.lit(7))
    a = language.identify(labelled, model).select("text", "language.*").collect()
    b = language.identify(other, model).select("text", "language.*").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_quality(spark):
    rng = random.Random(8)
    rows, truth = [], {}
    for i in range(400):
        n = rng.randrange(30, 120)
        words = [rng.choice(VOICES["en"]) + rng.choice(["", "", "", ".", ","]) for _ in range(n)]
        kind = rng.randrange(12)
        truth[i] = kind > 3
        if kind == 0:
            words = [w.upper().strip(".,") + "!!" for w in words]
        elif kind == 1:
            words = [w for w in words[:8] for _ in range(12)]
        elif kind == 2:
            words = [x for w in words for x in (w.strip(".,") + "ation", "|")]
        elif kind == 3:
            words = [w.strip(".,") + "$$$%%" for w in words]
        rows.append((i, " ".join(words) + "."))
    rows += [(900, None), (901, ""), (902, "\n \t"), (None, rows[0][1]), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    got = quality.score_quality(docs).collect()
    assert len(got) == 405
    right = [r.keep == truth[r.doc_id] for r in got if r.doc_id is not None and r.doc_id < 900]
    assert sum(right) / len(right) > 0.97
    assert all(r.score == 0 and not r.keep for r in got if (r.doc_id or 0) >= 900)
    assert quality.score_quality(docs.where("false")).count() == 0


def test_quality_estimate_finds_the_careless_labeller():
    rng = random.Random(2)
    patterns = {}
    width = len(quality.LABELLERS)
    for _ in range(3000):
        good = rng.random() < 0.8
        votes = tuple(
            (int(good) if rng.random() < (0.55 if i == 0 else 0.95) else int(not good))
            if rng.random() < 0.7 else -1 for i in range(width))
        patterns[votes] = patterns.get(votes, 0) + 1
    share, accuracy, _ = quality.estimate(patterns)
    assert abs(share - 0.8) < 0.05 and accuracy.index(min(accuracy)) == 0
    assert all(abs(a - 0.95) < 0.04 for a in accuracy[1:])


SECRET = "password = hunter2hunter2"


def base_spans(text):
    """The contract's words, straight."""
    out = [("assign", *m.span()) for m in re.finditer(
        r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
        r"([A-Za-z0-9+/_.=-]+)", text, re.ASCII) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secret_scan.KINDS.index(s[0]), s[2]))


def test_base_spans():
    rng = random.Random(11)
    parts = ["password", "TOKEN", "api_key", "apikey", "ſecret", "toKen", "=", ":", " ", "'", '"',
             "abcdef", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "x", "\n", "é",
             "token=token:abcdefgh", "short", "%41", "\\u0041"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        base, spans = secret_scan.scan(text)
        assert base == base_spans(text)
        assert set(base) <= set(spans)


@pytest.mark.parametrize("wrap", [
    lambda s: quote(s, safe=""),
    lambda s: quote(quote(s, safe=""), safe=""),
    lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    lambda s: "".join(f"&#{ord(c)};" for c in s),
    lambda s: "".join(f"\\x{ord(c):02x}" for c in s),
    lambda s: base64.b64encode(s.encode()).decode(),
    lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="),
    lambda s: base64.b64encode(base64.b64encode(s.encode())).decode(),
    lambda s: base64.b64encode(gzip.compress(s.encode() * 3)).decode(),
    lambda s: base64.b64encode(zlib.compress(bz2.compress(s.encode()))).decode(),
    lambda s: quote(base64.b64encode(quote(s, safe="").encode()).decode(), safe=""),
])
def test_wrapped_secrets(wrap):
    hidden = wrap("some text, " + SECRET + " and more")
    text = f"Été {hidden} fin"
    base, spans = secret_scan.scan(text)
    assert base == [] and spans
    for kind, start, end in spans:
        assert kind == "assign" and 4 <= start < end <= 4 + len(hidden)


def escaped(data, mark):
    return "".join(f"{mark}{b:02x}" for b in data)


@pytest.mark.parametrize("odd", [b"\xef\xbb\xbf", b"\xc2\xa0", b"\xe2\x80\x8b", b"\x1b[31m",
                                 b"\x00", b"\x0c", b"\xff", b"\xe9t\xe9 "])
@pytest.mark.parametrize("wrap", [
    lambda b: base64.b64encode(b).decode(),
    lambda b: base64.b64encode(gzip.compress(b)).decode(),
    lambda b: base64.b64encode(b"\x00tar\x00" + lzma.compress(b) + b"\x00").decode(),
    lambda b: base64.b64encode(gzip.compress(b"a\n") + gzip.compress(b)).decode(),
    lambda b: escaped(b, "%"), lambda b: escaped(gzip.compress(b), "%"),
    lambda b: quote(zlib.compress(b), safe=""), lambda b: quote(zlib.compress(b, 9), safe=""),
    lambda b: escaped(b, "\\x"), lambda b: escaped(bz2.compress(b), "\\x"),
])
def test_odd_bytes_hide_nothing(odd, wrap):
    hidden = wrap(odd + b"some text, " + SECRET.encode() + odd + b" end")
    base, spans = secret_scan.scan(f"Été {hidden} fin")
    assert base == [] and spans
    for kind, start, end in spans:
        assert kind == "assign" and 4 <= start < end <= 4 + len(hidden)


def test_broken_streams_give_what_they_hold():
    rng = random.Random(5)
    noise = "".join(rng.choice("ghijklmn \n") for _ in range(5000))
    whole = gzip.compress((SECRET + " " + noise).encode())
    bad_sum = whole[:-8] + bytes(8)
    for data in (whole[:-9], whole[:len(whole) // 2], bad_sum):
        hidden = base64.b64encode(data).decode()
        assert secret_scan.scan(f"x {hidden} y")[1] == [("assign", 2, 2 + len(hidden))]
    late = gzip.compress((noise + SECRET).encode())
    hidden = base64.b64encode(late[:-8] + bytes(8)).decode()
    assert secret_scan.scan(f"x {hidden} y")[1] == [("assign", 2, 2 + len(hidden))]
    assert secret_scan.scan(r"\ud83d" + "".join(f"\\u{ord(c):04x}" for c in SECRET))[1]


def wrapped(data, width, mark="\n"):
    text = base64.b64encode(data).decode()
    return mark.join(text[i:i + width] for i in range(0, len(text), width))


@pytest.mark.parametrize("mark", ["\n", "\r\n", "\n  "])
@pytest.mark.parametrize("width", [10, 64, 76])
def test_wrapped_lines_are_joined(width, mark):
    rng = random.Random(9)
    noise = "".join(rng.choice("ghijklmn ") for _ in range(400))
    for at in range(0, 120, 7):
        plain = (noise[:at] + " " + SECRET + " " + noise).encode()
        for data in (plain, gzip.compress(plain), bz2.compress(plain)):
            hidden = wrapped(data, width, mark)
            for text in (f"see:\n{hidden}\n\nend", f"a word\n{hidden}\nend"):
                base, spans = secret_scan.scan(text)
                inside = text.index(hidden), text.index(hidden) + len(hidden)
                assert base == [] and spans
                assert all(inside[0] <= a < b <= inside[1] for _, a, b in spans)
                if data is plain:
                    first = inside[0] + (at + 1) * 4 // 3 // width * len(mark) + (at + 1) * 4 // 3
                    last = (at + len(SECRET)) * 8 + 7
                    end = inside[0] + last // 6 // width * len(mark) + last // 6 + 1
                    assert ("assign", first, end) in spans


@pytest.mark.parametrize("glue", ["/data/", "/", "a_", "my-", "x", "ab", "key_id-", "text/"])
@pytest.mark.parametrize("shape", [
    lambda b: b, gzip.compress, bz2.compress, lambda b: base64.b64encode(b)])
def test_glued_base64(glue, shape):
    hidden = base64.b64encode(shape(b"some text, " + SECRET.encode() + b" and more ")).decode()
    for behind in ("", "/next"):
        if behind:
            hidden = hidden.rstrip("=")
        text = f"<{glue}{hidden}{behind}>"
        base, spans = secret_scan.scan(text)
        assert base == [] and spans
        assert all(1 + len(glue) <= a < b <= len(text) - 1 for _, a, b in spans)


def test_what_is_skipped_holds_nothing():
    rng = random.Random(12)
    parts = [b"password=abcdef", b"secret", b"ToKen:'abcdefgh", b"AKIA", b"ABCDEFGH12345678",
             b"0123456789abcdef", b"%4", b"1", b"\\x41", b"&#65;", b"\n", b"\r", b" ", b"x", b"\x9c",
             b"\xda\x80", b"\x1f", b"\x8b", b"BZh9", b"abcdefgh", b"\xff", b"\xc3\xa9", b"\x00"]
    for _ in range(5000):
        data = b"".join(rng.choice(parts) for _ in range(rng.randrange(6)))
        if not secret_scan.WORTH.search(data):
            text = data.decode("utf-8", "surrogateescape")
            here = np.arange(len(text))
            layer = secret_scan.Layer(text, here, here + 1)
            assert secret_scan.base_spans(text) == [] and secret_scan.unwrap(layer) == []


def test_positions_of_url_and_base64():
    text = f"x={quote(SECRET, safe='')} y"
    (kind, start, end), = secret_scan.scan(text)[1]
    assert text[start:end] == quote(SECRET, safe="")
    inner = base64.b64encode(("ab " + SECRET + " cd").encode()).decode()
    (kind, start, end), = secret_scan.scan(f"<{inner}>")[1]
    assert start > 1 + 3 and end < 1 + len(inner)


def test_nothing_is_found_in_clean_text():
    rng = random.Random(3)
    for _ in range(200):
        text = " ".join("".join(rng.choice("thandioner") for _ in range(rng.randrange(2, 30)))
                        for _ in range(50))
        assert secret_scan.scan(text)[1] == base_spans(text)


def test_cycles_end():
    text = "%2525252541 \\u005cu0041 &#38;#38;#65;"
    assert secret_scan.scan(text) == ([], [])


def test_secret_rows(spark):
    rows = [(1, SECRET), (1, SECRET), (2, None), (3, ""), (None, "x " + SECRET)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit(1))
    got = sorted((str(r.doc_id), [tuple(s) for s in r.spans])
                 for r in secret_scan.find_secrets(docs).collect())
    span = ("assign", 0, len(SECRET))
    assert got == [("1", [span]), ("1", [span]), ("2", []), ("3", []),
                   ("None", [("assign", 2, 2 + len(SECRET))])]
    assert secret_scan.find_secrets(docs.where("false")).count() == 0
