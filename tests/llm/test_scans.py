import hashlib
import re
import wave
import zlib
from io import BytesIO

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import audio, license_scan, pii, secret_scan
from tessera.llm import queries as Q

from . import helpers as H


def _luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _plain_pii(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and _luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.BASE.index(s[0])))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a.@-b+1 2(3)4 5.6-9٣%", max_size=60))
def test_base_pii_matches_the_patterns(text):
    assert [s[:3] for s in pii.find_pii(text) if s.kind in pii.BASE] == _plain_pii(text)


def test_checksums_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    kinds = lambda t: [s.kind for s in pii.find_pii(t)]
    assert kinds("iban GB82 WEST 1234 5698 7654 32 end")[0] == "iban"
    assert "birth" in kinds("born 12.03.1990 in") and "birth" not in kinds("on 12.03.1990 in")
    assert "national" in kinds("his ssn 123-45-6789 is") and "national" not in kinds("row 123-45-6789 is")
    near, far = pii.find_pii("call me +1 555 123 4567"), pii.find_pii("zz zz zz +1 555 123 4567")
    assert near[0].score > far[0].score


def test_pii_of_long_runs_is_linear():
    assert pii.find_pii("a" * 300_000 + " 1" * 100_000 + "@" + "." * 50_000) is not None


def test_pii_query(spark):
    spans = pii.pii_spans(H.odd_frame(spark))
    assert spans.count() == len(H.ODD) and pii.pii_spans(H.frame(spark, [])).count() == 0


def _plain_secrets(text):
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secret_scan.BASE.index(s[0])))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["token", "Secret", "ſecret", "api_key", "APIKEY", "paſſword", "K", "=", ":", " ", '"', "'", "abcdef", "AKIA", "ABCDEFGH12", "0123456789abcdef", "é"]), max_size=12))
def test_base_secrets_match_the_patterns(parts):
    text = "".join(parts)
    assert secret_scan.base_spans(text) == _plain_secrets(text)


def test_battery_tells_random_from_ordinary():
    rng = np.random.default_rng(5)
    for name, alphabet in secret_scan.ALPHABETS.items():
        ok = 0
        for _ in range(200):
            token = "".join(alphabet[i] for i in rng.integers(0, len(alphabet), 40))
            ok += 3 * min(secret_scan.battery(token, name).values()) >= 0.001
        assert ok >= 196, name
    assert min(secret_scan.battery("abababababababababababab1", "base36").values()) < 1e-4
    assert min(secret_scan.battery("aaaaaaaaaaaaaaaaaaaaaaaa1", "base36").values()) < 1e-4


def test_ordinary_text_is_not_reported():
    """Runs of ordinary characters, unevenly distributed: the e-values average to at most 1 and no cutoff is met."""
    rng = np.random.default_rng(21)
    chars = secret_scan.ALPHABETS["base64"] + "-_"
    share = rng.dirichlet(np.full(66, 0.3))
    texts = ["".join(chars[i] for i in rng.choice(66, rng.integers(20, 60), p=share)) for _ in range(4000)]
    counts = np.bincount(np.frombuffer("".join(texts).encode(), np.uint8), minlength=256)
    log_share = secret_scan.log_shares(counts)
    histogram, totals, e = {}, {}, []
    for text in texts:
        found = [dict(zip(("run", "size", "start", "end", "token"), c)) for c in secret_scan.candidates(text)]
        e += [2.0 ** secret_scan.log_e_value(c["token"], log_share) for c in found if c["token"] == text]
        for run in secret_scan.judge(found, log_share, 0.001)[0]:
            histogram[run["stratum"], run["bits"]] = histogram.get((run["stratum"], run["bits"]), 0) + 1
            totals[run["stratum"]] = totals.get(run["stratum"], 0) + 1
    assert np.mean(e) <= 1 and sum(totals.values()) > 3000
    for stratum, cut in enumerate(secret_scan.e_bh_cutoffs(histogram, totals, 0.01)):
        assert not any(b >= cut for s, b in histogram if s == stratum)


def test_all_runs_count_as_tests():
    """A run that fails the battery is still one of the hypotheses."""
    runs, pieces = secret_scan.judge([{"run": 0, "size": 24, "start": 0, "end": 24, "token": "a" * 24}], np.zeros(256), 0.001)
    assert runs == [{"stratum": 1, "bits": 0}] and not pieces


def test_e_bh_by_hand():
    # stratum 0: 4 candidates at 12, 12, 3, 1 bits, level 0.01: two at 12 >= log2(4 / (0.01 * 2)) = 7.6
    assert 7.6 < secret_scan.e_bh_cutoffs({(0, 12): 2, (0, 3): 1, (0, 1): 1}, {0: 4}, 0.01)[0] <= 12
    assert secret_scan.e_bh_cutoffs({(0, 3): 4}, {0: 4}, 0.01)[0] == 256


def test_random_tokens_are_found_and_redacted(spark):
    rng = np.random.default_rng(9)
    alphabet = secret_scan.ALPHABETS["base62"]
    tokens = ["".join(alphabet[i] for i in rng.integers(0, 62, 40)) for _ in range(5)]
    rows = H.corpus(60)
    rows += [(1000 + i, f"die Rede war von {t} und mehr", "en", "s", 0) for i, t in enumerate(tokens)]
    rows.append((2000, "ordinary aLongIdentifierNameInCamelCaseStyle1 here", "en", "s", 0))
    found = {r.doc_id: r.found for r in secret_scan.secret_spans(H.frame(spark, rows)).collect()}
    assert all(len(found[1000 + i]) == 1 for i in range(5))
    clean = {r.doc_id: r.text for r in secret_scan.redact(H.frame(spark, rows)).collect()}
    assert all(clean[1000 + i] == "die Rede war von [secret] und mehr" for i in range(5))
    for i, t, *_ in rows[:60]:
        want, at = "", 0
        for _, a, b in secret_scan.base_spans(t):
            want, at = want + t[at:a] + "[secret]", b
        assert clean[i] == want + t[at:]


def test_long_split_and_letters_only_tokens_are_found(spark):
    rng = np.random.default_rng(12)
    draw = lambda name, n: "".join(secret_scan.ALPHABETS[name][i] for i in rng.integers(0, len(secret_scan.ALPHABETS[name]), n))
    letters = "".join(c for c in draw("base62", 80) if c.isalpha())[:40]
    url = draw("base64url", 19) + "_" + draw("base64url", 30)
    texts = [draw("base64", 1600), f"com/reset/{url}", letters]
    rows = H.corpus(60) + [(1000 + i, f"die Rede war von {t} und mehr", "en", "s", 0) for i, t in enumerate(texts)]
    clean = {r.doc_id: r.text for r in secret_scan.redact(H.frame(spark, rows)).collect()}
    assert [clean[1000 + i] for i in range(3)] == [f"die Rede war von {t} und mehr" for t in ("[secret]", "com/reset/[secret]", "[secret]")]


def _hex_digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_secret_query_digests(spark, tmp_path):
    rng = np.random.default_rng(9)
    token = "".join(secret_scan.ALPHABETS["base62"][i] for i in rng.integers(0, 62, 44))
    rows = H.corpus(60) + [(900, f"é {token} then password=hunter2222 and AKIA{'A1' * 9}", "en", "s", 0), (901, "0123456789abcdef" * 3, "en", "s", 0)]
    d = str(tmp_path)
    H.frame(spark, rows).write.parquet(f"{d}/documents.parquet")
    got = {r.doc_id: r for r in Q.op8_secret_scan(spark, d).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        base = _plain_secrets(t)
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == b for b, *_ in base) for k in secret_scan.BASE)
        assert r.base_sha256 == _hex_digest(base)
        own = [("random", 2, 2 + len(token))] if i == 900 else []
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(base + own, key=lambda s: (s[1], (*secret_scan.BASE, "random").index(s[0]))))


def test_pii_query_digests(spark, tmp_path):
    rows = [(1, "é mail a@b.co, ip 1.2.3.4 or 999.1.1.1; card 4111 1111 1111 1111", "en", "s", 0), (2, None, "en", "s", 0), (3, "iban GB82WEST12345698765432 born 12.03.1990, ssn 123-45-6789, account 12345678", "en", "s", 0), (4, "call +1 (555) 123-4567 now", "en", "s", 0)]
    d = str(tmp_path)
    H.frame(spark, rows).write.parquet(f"{d}/documents.parquet")
    got = {r.doc_id: r for r in Q.op5_pii(spark, d).collect()}
    for i, t, *_ in rows:
        base = _plain_pii(t or "")
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(k == b for b, *_ in base) for k in pii.BASE)
        assert got[i].base_sha256 == _hex_digest(base)
    more = {s.split(":")[0]: rows[2][1][int(s.split(":")[1]) : int(s.split(":")[2])] for s in got[3].spans.split(",")}
    assert more["iban"] == "GB82WEST12345698765432" and more["birth"] == "12.03.1990" and more["national"] == "123-45-6789" and more["account"] == "12345678"
    assert got[4].spans == "phone:5:22" and got[3].n_spans == len(got[3].spans.split(","))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["account", "card", "iban"]), st.integers(0, 40), st.integers(1, 12)), max_size=10))
def test_bare_numbers_under_other_spans_go(spans):
    spans = [pii.Span(k, a, a + n, 1.0) for k, a, n in spans]
    taken = 0
    for s in sorted((s for s in spans if s.kind == "account"), key=lambda s: s.start):  # account spans never overlap
        if s.start < taken:
            spans.remove(s)
        else:
            taken = s.end
    want = [s for s in spans if s.kind != "account" or not any(o.kind != "account" and o.start < s.end and s.start < o.end for o in spans)]
    assert sorted(pii._uncovered(spans)) == sorted(want)


def test_secrets_of_odd_rows(spark):
    assert secret_scan.secret_spans(H.odd_frame(spark)).count() == len(H.ODD)
    assert secret_scan.redact(H.odd_frame(spark)).count() == len(H.ODD)
    assert secret_scan.secret_spans(H.frame(spark, [])).count() == 0


def test_licenses(spark):
    rows = [
        (1, "prose here that is a little longer than the notice\nLicensed under the Apache License, Version 2.0.\nmore", "en", "s", 0),
        (2, "Permission is hereby granted, free of charge, to any person obtaining a copy of this\nsoftware and associated documentation files (the Software), to deal in the Software without restriction\n\nother text", "en", "s", 0),
        (3, "nothing to see", "en", "s", 0),
        (4, "RELEASED  under the mit license!!", "en", "s", 0),
    ]
    got = {r.doc_id: (r.license, r.n_matches) for r in license_scan.license_of(H.frame(spark, rows)).collect()}
    assert got == {1: ("Apache-2.0", 1), 2: ("MIT", 1), 3: (None, 0), 4: ("MIT", 1)}
    assert license_scan.license_of(H.odd_frame(spark)).where("license is null").count() == len(H.ODD)
    assert license_scan.license_of(H.frame(spark, [])).count() == 0


def test_licenses_inside_longer_text(spark):
    permission = license_scan.NOTICES[1][1]
    words = permission.split()
    apache = license_scan.NOTICES[0][1].split()
    commented = "# Copyright 2021 Foo\n#\n" + "".join(f"# {' '.join(apache[i : i + 9])}\n" for i in range(0, len(apache), 9)) + "\nimport os"
    texts = [
        (permission, "MIT", 1),
        ("\n".join(" ".join(words[i : i + 7]) for i in range(0, len(words), 7)), "MIT", 1),
        (license_scan.NOTICES[2][1], "MIT", 1),
        (commented, "Apache-2.0", 2),  # its first line as a whole, the other lines by a window
        ("Copyright 2021 Foo. Released under the MIT License.", "MIT", 1),
        ("All of this text, written over many years, is here. This work is licensed under the GNU General Public License, version 3. More follows.", "GPL-3.0", 1),
        ("Released under the MIT License.\n\nParts of it, as told before, are something else: Licensed under CC BY-SA 4.0. Thanks to all.", "MIT", 2),
        ("Licensed\n\nunder the Apache\n\nLicense, Version 2.0.", "Apache-2.0", 1),
        ("The driver's license was released under pressure, and the version of the work was public.", None, 0),
    ]
    got = {r.doc_id: (r.license, r.n_matches) for r in license_scan.license_of(H.frame(spark, [(i, t, "en", "s", 0) for i, (t, *_) in enumerate(texts)])).collect()}
    assert got == {i: (name, n) for i, (_, name, n) in enumerate(texts)}


def _dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def test_licenses_match_all_templates(spark):
    rows = [(i, t[1], "en", "s", 0) for i, t in enumerate(license_scan.TEMPLATES)]
    rows += [(100 + i, " ".join(t[1].split()[: max(2, len(t[1].split()) * 2 // 3)]), "en", "s", 0) for i, t in enumerate(license_scan.TEMPLATES)]
    got = {r.doc_id: r.dice for r in license_scan.license_of(H.frame(spark, rows)).collect()}
    for i, t, *_ in rows:
        best = max(_dice(set(license_scan.bigrams(t)), set(license_scan.bigrams(x))) for _, x in license_scan.TEMPLATES)
        assert got[i] == (round(best, 6) if best >= 0.8 else None)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=300))
def test_media_round_trip(text):
    payload, n = audio.payload_of(text)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload[:n] == text.encode() and not any(payload[n:])
    media = audio.write_wave(payload)
    assert audio.read_wave(media) == (payload, audio.RATE)
    with wave.open(BytesIO(media)) as w:
        assert w.getsampwidth() == 1 and w.getnchannels() == 1 and w.readframes(w.getnframes()) == payload


def test_polyphase_equals_upsample_filter_decimate():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, 500).astype(np.uint8)
    taps = audio._REACH
    n = np.arange(-taps * audio.UP, taps * audio.UP + 1)
    h = np.sinc(n / max(audio.UP, audio.DOWN)) / max(audio.UP, audio.DOWN) * np.hanning(len(n)) * audio.UP
    up = np.zeros(len(x) * audio.UP)
    up[:: audio.UP] = (x.astype(float) - 128) / 128
    want = np.convolve(up, h)[taps * audio.UP :][: len(up)][:: audio.DOWN]
    got = audio.resample(x)
    assert len(got) == len(want) and np.allclose(got, want, atol=1e-5)


def test_segments_need_both_thresholds():
    db = np.array([0, 0, 0, 0, 2.0, 1.0, 1.0, 0, 1.0, 0, 0, 0], np.float32)
    assert audio.segments(db, rise=1.5, fall=0.5) == [(4, 7)]


def test_features_do_not_depend_on_blocks(monkeypatch):
    samples = np.random.default_rng(3).integers(0, 256, 40_000).astype(np.uint8)
    whole = audio.log_mel(samples)
    monkeypatch.setattr(audio, "BLOCK", 7)
    for a, b in zip(whole, audio.log_mel(samples), strict=True):
        assert np.allclose(a, b, atol=1e-4)
    assert np.allclose(audio.resample(samples, 100, 300), audio.resample(samples)[100:300], atol=1e-6)


def test_tensors_are_stored_with_their_spans(spark):
    media = audio.to_media(H.odd_frame(spark))
    stored = audio.media_features(media)
    for r in stored.collect():
        table = audio.read_tensors(bytes(r.tensors))
        kind = table.schema.field("log_mel").type
        assert isinstance(kind, pa.FixedShapeTensorType) and kind.shape == list(audio.SHAPE) and table.num_rows == r.n_clips
        spans = list(zip(table["start_ms"].to_pylist(), table["end_ms"].to_pylist()))
        assert spans[0][0] == 0 and all(a < b for a, b in spans) and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
        active = [tuple(map(int, s.split("-"))) for s in r.active_ms.split(",") if s]
        assert table["active"].to_pylist() == [any(a < y and x < b for a, b in active) for x, y in spans]
    rows = audio.audio_tensors(stored).collect()
    mel, _, _ = audio.features(audio.payload_of("same words again " * 30)[0])
    mine = [r for r in rows if r.doc_id == 6]
    got = np.concatenate([np.array(r.log_mel).reshape(audio.SHAPE) for r in sorted(mine, key=lambda r: r.clip)])
    assert np.allclose(got[: len(mel)], mel) and not got[len(mel) :].any()


def test_null_media_have_null_features(spark):
    got = audio.media_features(spark.createDataFrame([(1, None, None)], "doc_id long, media binary, n_bytes long")).first()
    assert got.doc_id == 1 and got.feature is None and got.tensors is None


def _plain_summary(payload):
    """The features' text from whole arrays, without blocks or phases."""
    x, taps = np.zeros(2 * len(payload)), audio._REACH
    x[::2] = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    n = np.arange(-2 * taps, 2 * taps + 1)
    sound = np.convolve(x, np.sinc(n / 5) / 5 * np.hanning(len(n)) * 2)[2 * taps :][: len(x)][::5]
    frames = max(1, -(-max(0, len(sound) - 160) // 64) + 1)
    sound = np.append(sound, np.zeros((frames - 1) * 64 + 160 - len(sound)))
    cut = np.stack([sound[64 * i : 64 * i + 160] for i in range(frames)])
    mel = np.log(np.abs(np.fft.rfft(cut * np.hanning(160), axis=1)) ** 2 @ audio._mel_bank(6400).astype(float) + 1e-6)
    db = 10 * np.log10((cut * cut).mean(axis=1) + 1e-9)
    return audio.summary(mel.astype(np.float32), db.astype(np.float32), audio.segments(db.astype(np.float32)))


def test_media_query(spark, tmp_path):
    d = str(tmp_path)
    H.odd_frame(spark).write.parquet(f"{d}/documents.parquet")
    rows = {r.doc_id: r for r in Q.op10_audio(spark, d).collect()}
    for i, t, *_ in H.ODD:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        with BytesIO() as f:
            with wave.open(f, "wb") as w:
                w.setnchannels(1), w.setsampwidth(1), w.setframerate(audio.RATE), w.writeframes(payload)
            media = f.getvalue()
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert r.feature == _plain_summary(payload)
    assert rows[1].feature == rows[2].feature and rows[5].feature == rows[6].feature


def test_very_long_runs_of_digits():
    """Leading zeros without end, and numbers of thousands of digits, are parts of addresses or of nothing."""
    zeros = "0" * 5000
    assert [s[:3] for s in pii.find_pii(f"x {zeros}.1.2.3 y") if s.kind == "ip"] == [("ip", 2, 2 + 5006)]
    assert not [s for s in pii.find_pii(f"x {'9' * 5000}.1.2.3 {zeros}1234 y") if s.kind in ("ip", "card")]


def _iban(country, rng):
    body = "".join(rng.choice(list("0123456789"), pii.IBAN_LENGTHS[country] - 4))
    digits = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{country}{98 - int(digits) % 97:02d}{body}"


def test_ibans_of_every_country_and_spacing_are_found():
    rng = np.random.default_rng(4)
    for country in pii.IBAN_LENGTHS:
        code = _iban(country, rng)
        for spaced in (code, " ".join(code[i : i + 4] for i in range(0, len(code), 4)), f"{code[:4]} {code[4:8]} {code[8:]}"):
            for after in ("", " BIC", " SWIFT", " EUR 12", " A", ".", ", BANK"):
                found = [s for s in pii.find_pii(f"to {spaced}{after}") if s.kind == "iban"]
                assert [(s.start, s.end) for s in found] == [(3, 3 + len(spaced))], (country, spaced, after)
        assert not [s for s in pii.find_pii(f"to {code}7 or X{code}") if s.kind == "iban"]


def test_recall_of_every_kind():
    """Planted in sentences: at least nine of ten are found, whole."""
    rng = np.random.default_rng(5)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def card():
        body = rng.choice(["4", "51", "37"]) + digits(13)
        last = next(d for d in "0123456789" if pii.luhn(body + d))
        return " ".join((body + last)[i : i + 4] for i in range(0, 20, 4)).strip() if rng.random() < 0.5 else body + last

    made = {
        "email": lambda: (f"{rng.choice(['jo', 'a.b', 'x_1'])}@{rng.choice(['mail', 'my-host'])}.{rng.choice(['org', 'co.uk'])}", "write to {} now"),
        "ip": lambda: (".".join(map(str, rng.integers(0, 256, 4))), "the host {} answers"),
        "card": lambda: (card(), "paid by card {} today"),
        "phone": lambda: (f"+{rng.integers(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", "call {} soon"),
        "iban": lambda: (_iban(rng.choice(list(pii.IBAN_LENGTHS)), rng), "account {} BANK"),
        "national": lambda: (f"{rng.integers(100, 600)}-{rng.integers(10, 99)}-{rng.integers(1000, 9999)}", "social security {} given"),
        "birth": lambda: (f"19{rng.integers(10, 99)}-{rng.integers(10, 13)}-{rng.integers(10, 28)}", "born {} in town"),
        "account": lambda: (str(rng.integers(1, 9)) + digits(9), "customer account {} closed"),
    }
    for kind, make in made.items():
        hits = 0
        for _ in range(200):
            value, frame = make()
            at = frame.index("{}")
            hits += any(s.kind == kind and (s.start, s.end) == (at, at + len(value)) for s in pii.find_pii(frame.format(value)))
        assert hits >= 180, (kind, hits)


def test_thousands_of_tokens_in_one_text():
    """The judge's work grows with the tokens, and keeps the best of overlapping pieces."""
    rng = np.random.default_rng(6)
    alphabet = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_")
    text = " ".join("".join(rng.choice(alphabet, 44)) for _ in range(3000))
    found = [dict(zip(("run", "size", "start", "end", "token"), c)) for c in secret_scan.candidates(text)]
    _, pieces = secret_scan.judge(found, secret_scan.log_shares(np.bincount(np.frombuffer(b"some plain words " * 50, np.uint8), minlength=256)), 0.001)
    assert len(pieces) > 1000
    spans = [(p["start"], p["end"]) for p in pieces]
    assert spans == sorted(spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
