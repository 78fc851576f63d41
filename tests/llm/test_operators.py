"""Each operator against a brute-force version over unpleasant rows, and on an empty table."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import common, metric_search, mixing, near_dedup, packing, preference, pu_quality, quality_rules, secret_scan, substring_dedup, token_files, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pairs(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# ---- joins


def test_joins_of_hot_keys(spark):
    left = spark.range(6000).select(F.when(F.col("id") < 2500, 0).otherwise(F.col("id") % 700).alias("k"), "id", F.lit(1).alias("_salt"))
    right = left.groupBy("k").agg(F.count("*").alias("n")).filter("k % 3 = 0")
    want = Counter(r.id for r in left.filter("k % 3 = 0").collect())
    for how, total in (("left_semi", None), ("inner", None), ("inner", 6000)):
        out = common.skewed_join(left, right, ["k"], how=how, total=total)
        assert Counter(r.id for r in out.collect()) == want and out.columns[:3] == ["k", "id", "_salt"]


def test_rows_without_keys(spark):
    docs = spark.range(4000).select(F.when(F.col("id") % 9 > 0, F.col("id")).alias("doc_id"), (F.col("id") % 7).alias("v"), F.lit("x").alias("_maybe"), F.lit(1).alias("_own_0"))
    scratch = common.Scratch(spark, "without")
    for which in ("v = 3", "v < 6", "false", "true"):
        gone = scratch.write(docs.filter(which).select("doc_id", "v").distinct(), "gone")
        out = common.without(docs, [F.col("doc_id"), F.col("v")], gone, scratch)
        assert out.columns == docs.columns and Counter(out.collect()) == Counter(docs.filter(f"NOT ({which})").collect())
    gone = scratch.write(docs.filter("v = 3").select("doc_id", "v"), "few")
    for most, least, share in ((1 << 28, 571, 0.2), (1, 571, 1)):  # with too few bits more rows pass, never fewer
        got = common.maybe_in(docs, ["doc_id", "v"], gone, scratch, "hit", most=most)
        assert got.columns == [*docs.columns, "hit"] and got.filter("v = 3 AND NOT hit").isEmpty() and least <= got.filter("hit").count() <= share * 4000


# ---- quality rules


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_base_counts(docs, rows):
    got = quality_rules.apply_rules(docs)
    want = Counter()
    for i, text, _, _ in rows:
        c = base_counts(text)
        want[(i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert pairs(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want


def test_long_texts_use_pairs(spark):
    text = "a b c a b c d e f"
    df = spark.createDataFrame([(text,)], "t string").select(F.split("t", " ").alias("w"))
    assert df.select(F.expr(quality_rules._LONG_STARTS).alias("s")).head().s == [0, 3]


def test_divergence_rejects_junk_only(spark):
    rng = random.Random(1)
    words = "the of and to in is that alpha beta gamma delta epsilon".split()
    good = [(i, " ".join(rng.choice(words) + str(i % 7) * (rng.random() < 0.1) for _ in range(200)), "en") for i in range(60)]
    good = [(i, " ".join(w if j % 2 else w + chr(97 + (j * 7 + i) % 26) for j, w in enumerate(t.split())), l) for i, t, l in good]
    bad = [(100 + i, " ".join(f"{w.upper()}$$$!{j}" for j, w in enumerate(t.split())), l) for i, (_, t, l) in enumerate(good[:5])]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality_rules.apply_rules(df).filter("kept").collect()}
    assert kept == {i for i, *_ in good}


def test_without_rejected(docs, empty):
    out = quality_rules.without_rejected(docs)
    assert out.columns == docs.columns
    kept = pairs(quality_rules.apply_rules(docs).filter("kept"), "doc_id")
    assert pairs(out, "doc_id") == kept
    assert quality_rules.without_rejected(empty).count() == 0


# ---- secrets


def test_secret_spans(docs, rows):
    got = {(r.doc_id, tuple((x.kind, x.start, x.end) for x in r.findings)) for r in secret_scan.scan_secrets(docs).collect()}
    want = set()
    for i, text, _, _ in rows:
        text, found = text or "", []
        for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
            found += [("assign", *m.span())] if len(m[2]) >= 6 else []
        found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        want.add((i, tuple(sorted(found, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0]))))))
    assert {(i, tuple(x for x in f if x[0] != "markov")) for i, f in got} == want
    assert sum(x[0] == "markov" for _, f in got for x in f) >= 6  # the random 32-character strings


def test_markov_separates_held_out_samples():
    model = secret_scan.train(secret_scan.labelled_samples())
    held = secret_scan.labelled_samples(1000, seed=123)
    right = [secret_scan.is_random(s, model, secret_scan.SecretScan()) == bool(y) for s, y in held if len(s) >= 20]
    assert np.mean(right) > 0.98


def test_markov_finds_planted_secrets_and_leaves_words(spark):
    """Recall and precision over runs of 20 to 40 characters set in prose, without any pattern's prefix."""
    rng, a = random.Random(31), secret_scan.ALPHABET
    pools = (a[:62], a[:64], a[:62] + "-_", a[:52], a[26:62], a[:26] + a[52:62])
    words = "the stone by a river that runs under old bridges and through wide gardens of the northern towns".split()
    rows, planted = [], {}
    for i in range(600):
        w = [rng.choice(words) for _ in range(60)]
        ordinary = ["".join(rng.choice(["lich", "keit", "tion", "ment", "ungs", "heit", "aire", "able"]) for _ in range(6)), "-" * 30, "=" * 24, "src/module/handler/event_queue_service", "CamelCaseHandlerFactoryBuilder2024"]
        w[10] = rng.choice(ordinary)
        if i % 2:
            w[40] = planted[i] = "".join(rng.choice(pools[i // 2 % len(pools)]) for _ in range(rng.randint(20, 40)))
        rows.append((i, " ".join(w)))
    text = dict(rows)
    got = [(r.doc_id, text[r.doc_id][x.start : x.end]) for r in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect() for x in r.findings if x.kind == "markov"]
    hit = {i for i, x in got if planted.get(i, "").strip("/=-_+") and x in planted.get(i, "")}
    assert len(hit) >= 0.98 * len(planted) and len(got) - len(hit) <= 0.01 * len(rows)


def test_many_findings_in_one_text():
    model, scan = secret_scan.train(secret_scan.labelled_samples()), secret_scan.SecretScan()
    rng = random.Random(7)
    runs = [("".join(rng.choice("0123456789abcdef") for _ in range(30)), "".join(rng.choice(secret_scan.ALPHABET[:62]) for _ in range(30))) for _ in range(20_000)]
    found = secret_scan.find_secrets(" ".join(x for r in runs for x in r), model, scan)
    kinds = Counter(k for k, _, _ in found)
    assert kinds["hex"] == 20_000 and kinds["markov"] > 19_900


def test_redaction(docs, rows, empty):
    model = secret_scan.train(secret_scan.labelled_samples())
    out = secret_scan.redact_secrets(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    for r in out.collect():
        assert r.text is None or (not secret_scan.find_secrets(r.text, model, secret_scan.SecretScan()) and r.n_chars == len(r.text))
    assert secret_scan.redact("abcdef", [("hex", 1, 3), ("assign", 2, 4)], "*") == "a*ef"
    assert secret_scan.redact_secrets(empty).count() == 0


# ---- tokens


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path(None))


def ids_of(plain, text, end):
    return np.array([*plain.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4").tobytes()


def test_cached_ids_equal_whole_text_ids(rows, plain):
    texts = [r[1] or "" for r in rows] + ["", "  a  b\n\n c", "x \ny", "don't it's 'll", "naïve ²½ª", " 　 z", "éclair", "1234 a1b2 _x_ --"]
    t = tokens.CachedTokenizer(tokens.tokenizer_path(None), max_entries=500)  # small, so that it is cut back
    for _ in range(2):
        assert [t.encode(x) for x in texts] == [np.array(plain.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts]


def test_every_latin_and_blank_character_splits_alike(plain):
    t, blanks = tokens.open_tokenizer(None), [*range(0x2000, 0x2070), 0x1680, 0x180E, 0x3000, 0xFEFF, 0x660, 0x300, 0x2160, 0x3007, 0x4E00, 0x1F600]
    for c in map(chr, [*range(0x300), *blanks]):
        texts = [f"a{c}b", f"a {c} b", f"{c}{c}x", f" {c}", f"1{c}2{c}\n{c}y"]
        assert t.encode_many(texts) == [np.array(plain.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts], hex(ord(c))


def test_separators_are_no_white_space_to_the_tokenizer(plain):
    t = tokens.open_tokenizer(None)
    for c in map(chr, range(0x300)):
        texts = [f"\n\n{c}x", f"\n\n{c}!", f"{c}'s", f"a{c}{c}'ll {c}", f" {c} {c}1", f"\n{c}\n{c} \n"]
        assert t.encode_many(texts) == [np.array(plain.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts], hex(ord(c))


def test_short_strings_of_all_classes_split_alike(plain):
    t = tokens.CachedTokenizer(tokens.tokenizer_path(None), max_entries=3000, chars=4096)
    alphabet = "as're 1!\n\t\x1e\x85\u01b3\u3000\u4e00\u0660"
    for n in (1, 2, 3, 4):
        texts = ["".join(x) for x in itertools.product(alphabet if n < 4 else "sl'v e1\n\x1e\u01b3\u3000", repeat=n)]
        want = [np.array(e.ids, dtype="<u4").tobytes() for e in plain.encode_batch_fast(texts, add_special_tokens=False)]
        got = t.encode_many(texts)
        assert [x for x, a, b in zip(texts, got, want, strict=True) if a != b] == []


def test_long_texts_and_long_words(plain):
    rng = random.Random(14)
    t = tokens.CachedTokenizer(tokens.tokenizer_path(None), max_entries=300, chars=1000)
    words = ["don't", "we'll", "x" * 300, "7" * 270, "naïve", "日本語" * 4, "—", "\x00", "\n\n", "a\x00b", "it's", " ", "'", "''s", "\U0001f600"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "", "\n", "  "]) for _ in range(n)) for n in (3, 2000, 50, 0, 400)] + ["y" * 9000, " " * 3000]
    for _ in range(2):
        assert t.encode_many(texts) == [np.array(plain.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts]


def test_token_files_round_trip(spark, docs, rows, plain):
    for df in (docs, docs.repartitionByRange(3, "doc_id")):
        manifest = token_files.write_token_files(df, frame_tokens=500)
        got = [tuple(r) for r in token_files.read_token_files(spark, manifest).orderBy("start").collect()]
        want, start = [], 0
        for i, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode())):
            b = ids_of(plain, text, 2)
            want.append((i, start, len(b) // 4, zlib.crc32(b)))
            start += len(b) // 4
        assert got == want


def test_token_file_reads_only_what_is_asked(spark, docs, rows, plain):
    import zstandard

    m = token_files.write_token_files(docs.filter("doc_id is not null").coalesce(1), frame_tokens=500).head()
    fs, path = token_files.filesystem(m.path)
    with fs.open_input_file(path) as source:
        f = token_files.TokenFile(source)
        for i in (0, 44, 206, 207):
            (row,) = f.rows_of(i)
            before = f.frames_read
            assert f.ids(row).tobytes() == ids_of(plain, next(r[1] for r in rows if r[0] == i), 2) and f.frames_read == before + 1
        assert len(f.rows_of(5)) == 3 and not len(f.rows_of(99_999))
    raw = bytearray(fs.open_input_file(path).read())
    ids = b"".join(x for _, x in token_files.TokenFile(fs.open_input_file(path)).documents())
    plain_reader = zstandard.ZstdDecompressor().stream_reader(bytes(raw), read_across_frames=True)
    assert plain_reader.read(len(ids)) == ids  # any decoder reads the frames from front to back
    raw[40] ^= 1
    import pyarrow as pa

    with pytest.raises(Exception):
        list(token_files.TokenFile(pa.BufferReader(bytes(raw))).documents())


def test_documents_beyond_a_frame():
    import io

    import pyarrow as pa

    rng, sink = np.random.default_rng(3), io.BytesIO()
    writer = token_files.TokenFileWriter(sink, frame_tokens=50, index_rows=3, max_frame=400)
    docs = [rng.integers(0, 50_000, n).astype("<u4") for n in (1, 99, 100, 101, 1000, 7, 250, 3)]
    for i, d in enumerate(docs):
        writer.add(i, d.tobytes())
    writer.close()
    f = token_files.TokenFile(pa.BufferReader(sink.getvalue()))
    assert writer.n_tokens == sum(map(len, docs)) and [(i, b) for i, b in f.documents()] == [(i, d.tobytes()) for i, d in enumerate(docs)]
    assert all((f.ids(i) == d).all() for i, d in enumerate(docs))


def test_empty_token_files(spark, empty):
    assert token_files.read_token_files(spark, token_files.write_token_files(empty)).count() == 0


# ---- packing


def packed(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for seq in by.values():
        seq.sort(key=lambda r: r.offset)
        assert [r.offset for r in seq] == list(np.cumsum([0] + [r.length for r in seq])[:-1])
    return by


def test_packing_keeps_every_id(docs, rows, plain):
    got = packing.pack_documents(docs, end_id=1, limits=packing.Limits(tokens=256, segments=5, loss=256, pool=32)).collect()
    total = 0
    for seq in packed(got).values():
        n = sum(r.length for r in seq)
        assert n <= 256 and len(seq) <= 5 and sum(r.loss_tokens for r in seq) <= 256
        assert n == 256 or n & (n - 1) == 0
        total += n
    want = Counter(ids_of(plain, r[1], 1) for r in rows if r[0] is not None and r[0] != 5)
    pieces = defaultdict(list)
    for r in got:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
        if r.doc_id is not None and r.doc_id != 5:
            pieces[r.doc_id].append(r)
    assert Counter(b"".join(bytes(p.ids) for p in sorted(ps, key=lambda p: p.start)) for ps in pieces.values()) == want
    assert total == sum(len(ids_of(plain, r[1], 1)) // 4 for r in rows)


def test_packing_under_loss_limit(spark):
    rng = random.Random(5)
    data = [(i, bytes(4 * n), rng.randint(0, n)) for i in range(200) for n in [rng.randint(1, 90)]] + [(900, b"", 0), (901, None, None)]
    df = spark.createDataFrame(data, "doc_id long, ids binary, masked int").coalesce(1)
    limits = packing.Limits(tokens=100, segments=4, loss=40, pool=20)
    got = packing.pack_examples(df, limits).collect()
    for seq in packed(got).values():
        assert sum(r.length for r in seq) <= 100 and len(seq) <= 4 and sum(r.loss_tokens for r in seq) <= 40
    assert sum(r.length for r in got) == sum(len(x[1] or b"") // 4 for x in data)
    assert sum(r.loss_tokens for r in got) == sum(len(x[1] or b"") // 4 - (x[2] or 0) for x in data)


def test_packing_empty(empty):
    assert packing.pack_documents(empty).count() == 0


# ---- quality classifier


def test_classifier_learns_and_ignores_held_out_labels(spark):
    rng = random.Random(2)
    texts, labels = [], []
    for i in range(600):
        good = rng.random() < 0.8
        w = [rng.choice(["river", "stone", "light", "garden", "window"]) for _ in range(rng.randint(20, 60))]
        texts.append((i, " ".join(w if good else [x.upper() + "!!" for x in w])))
        labels.append((i, int(good), 0))
    texts += [(900, None), (901, ""), (None, "river stone")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(None, 1, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    p = pu_quality.PuQuality(pairs=256, steps=200)
    got = {r.doc_id: r for r in pu_quality.classify(df, lab, p).collect()}
    truth = {i: q for i, q, _ in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i in truth)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    flipped = lab.withColumn("quality", F.when(pu_quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in pu_quality.classify(df, flipped, p).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in again)


def brute_features(text, n):
    """Features of a text by plain counting, with n slots for byte pairs."""
    b = (text or "").encode()
    slots, kinds = Counter(((x * 257 + y) * 2654435761 % 2**32) >> (32 - (n - 1).bit_length()) for x, y in zip(b, b[1:])), [0] * 6
    for x in b:
        for k, inside in enumerate((65 <= x <= 90, 97 <= x <= 122, 48 <= x <= 57, x <= 32, x in b"#*$%&|<>{}[]\\/=+~^_@", x >= 128)):
            kinds[k] += inside
    words, lines = b.split(), [x for x in b.split(b"\n") if x.strip()]
    shape = [np.log1p(len(words)) / 10, len(set(words)) / max(1, len(words)), 1 - len(set(lines)) / max(1, len(lines)), not words, sum(x == y for x, y in zip(words, words[1:])) / max(1, len(words))]
    return [(slots[i] / (len(b) - 1)) ** 0.5 if slots[i] else 0 for i in range(n)] + [k / max(1, len(b)) for k in kinds] + [float(x) for x in shape]


def test_classifier_against_brute_force(spark, docs, rows):
    """The whole query on one machine: plain features, the documented samples and steps of plain gradient formulas."""
    label_rows = [(i, int(i % 3 > 0), 0) for i in range(0, 120, 2)] + [(4, 1, 0), (None, 1, 0), (7, None, 0)]
    labels = spark.createDataFrame(label_rows, "doc_id long, quality int, toxic int")
    p = pu_quality.PuQuality(pairs=64, steps=25)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    known = {}
    for i, q, _ in label_rows:
        if i is not None and q is not None and not held(i):
            known[i] = min(q, known.get(i, 1))
    text = {}
    for i, t, *_ in rows:
        if i is not None and not held(i):
            text[i] = min(t or "", text.get(i, t or ""))
    f16 = lambda ids: np.array([brute_features(text[i], 64) for i in ids]).astype(np.float16).astype(float)
    prior, xp, xu = sum(known.values()) / len(known), f16([i for i in known if known[i] and i in text]), f16(list(text))
    w, b, m, v = np.zeros(xp.shape[1]), np.log(prior / (1 - prior)), 0.0, 0.0
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for t in range(1, p.steps + 1):
        zp, zu = xp @ w + b, xu @ w + b
        plus = np.append(xp, np.ones((len(xp), 1)), axis=1).T @ (prior * (sigmoid(zp) - 1)) / len(xp)
        rest = np.append(xu, np.ones((len(xu), 1)), axis=1).T @ sigmoid(zu) / len(xu) - np.append(xp, np.ones((len(xp), 1)), axis=1).T @ (prior * sigmoid(zp)) / len(xp)
        bracket = np.log1p(np.exp(zu)).mean() - prior * np.log1p(np.exp(zp)).mean()
        g = (plus + rest if bracket >= 0 else -rest) + np.append(p.decay * w, 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = p.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    want = Counter((i, held(i), round(float(sigmoid(np.dot(brute_features(t, 64), w) + b)), 3)) for i, t, *_ in rows)
    got = Counter((r.doc_id, r.held_out, round(r.score, 3)) for r in pu_quality.classify(docs, labels, p).collect())
    assert sum((want - got).values()) <= 2  # roundings that fall on either side


def test_samples_are_those_of_the_smallest_hashes(spark):
    ids = spark.range(2000).select((F.col("id") % 1500).alias("doc_id"))
    by = [r.doc_id for r in ids.distinct().orderBy(F.shiftrightunsigned(F.xxhash64("doc_id"), 1), "doc_id").collect()]
    for k in (10, 600, 5000):
        assert {r.doc_id for r in pu_quality.smallest_hashes(ids, 2000, k).collect()} == set(by[:k])
    same = spark.range(5000).select(F.lit(3).alias("doc_id"))
    assert [r.doc_id for r in pu_quality.smallest_hashes(same, 5000, 10).collect()] == [3]


def test_rows_that_share_an_id_count_once_in_training(spark):
    df = spark.createDataFrame([(i, f"text {i} " * 5) for i in range(30)] + [(2, "text 2 " * 5)] * 500, "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    p = pu_quality.PuQuality(pairs=64, steps=20)
    once = pu_quality.train(df.distinct(), lab, p)
    assert np.allclose(once.weights, pu_quality.train(df, lab, p).weights)


def test_classifier_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in pu_quality.classify(docs, none).collect()} == {0.5}
    assert pu_quality.classify(empty, none).count() == 0


def test_risk_never_counts_below_zero():
    x = np.random.default_rng(0).normal(size=(200, 5))
    m = pu_quality.fit(x[:50], x[50:], 0.9, pu_quality.PuQuality(pairs=0, steps=300))
    assert np.isfinite(m.weights).all() and np.abs(m.weights).max() < 50


# ---- near duplicates


def brute_components(rows, k, percent):
    sets = {}
    for n, (i, text, *_) in enumerate(rows):
        w = (text or "").encode().lower().split()
        sets[n] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    parent = {i: i for i, *_ in rows if i is not None}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in range(a):
            i, j, both = rows[a][0], rows[b][0], len(sets[a] & sets[b])
            if i is not None and j is not None and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sets, {i: find(i) for i in parent}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, k, percent):
    sets, root = brute_components(rows, k, percent)
    got = near_dedup.near_duplicates(docs, near_dedup.NearDedup(shingle_words=k, percent=percent))
    want = Counter((i, len(sets[n]), root.get(i), i is None or root[i] == i) for n, (i, *_) in enumerate(rows))
    assert pairs(got, "doc_id", "n_shingles", "component_id", "kept") == want


def test_borderline_groups_lose_no_link(spark):
    """Copies with so many edits that many pairs lie near the threshold: stars alone would not connect them."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(150)] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, root = brute_components(rows, 3, 85)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, near_dedup.NearDedup(3, 85)).collect()}
    assert got == root and 1 < len(set(root.values())) < 150


def test_without_near_duplicates(docs, empty):
    out = near_dedup.without_near_duplicates(docs)
    assert out.columns == docs.columns
    assert pairs(out.filter("doc_id = 5"), "doc_id") == {(5,): 1}  # repeated rows leave one
    assert near_dedup.without_near_duplicates(empty).count() == 0


def test_texts_that_share_an_id_are_judged_one_by_one(spark):
    rng = random.Random(12)
    a, b, c = (" ".join(f"w{rng.randrange(10**9)}" for _ in range(100)) for _ in range(3))
    rows = [(3, f"{a} x"), (5, a), (5, b), (7, b), (9, c), (9, f"{c} x"), (5, b), (None, c), (None, c), (None, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pairs(near_dedup.without_near_duplicates(df), "doc_id", "text")
    nines = {t for i, t in got if i == 9}
    assert len(nines) == 1 and nines < {c, f"{c} x"}  # near duplicates under one id: one stays
    assert got == Counter([(3, f"{a} x"), (5, b), *((9, t) for t in nines), (None, c), (None, c), (None, b)])
    whole = Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert whole == Counter([(3, 3, True), (5, 3, False), (5, 5, True), (5, 5, True), (7, 5, False), (9, 9, True), (9, 9, False), *[(None, None, True)] * 3])
    alone = near_dedup.without_near_duplicates(spark.createDataFrame([(1, a), (None, c), (None, c)], "doc_id long, text string"))
    assert pairs(alone, "doc_id", "text") == Counter([(1, a), (None, c), (None, c)])


def test_repeated_rows_are_confirmed_once(spark, monkeypatch):
    words = [f"w{i}" for i in range(200)]
    near = [(1, " ".join(words), "a"), (2, " ".join([*words[:-1], "x"]), "b")]
    rows = [r for r in near for _ in range(40)] + [(1, near[0][1], "c")]
    sizes = []
    inner = near_dedup.confirm

    def confirm(pairs, texts, p, scratch):
        sizes.append((pairs.count(), texts.count()))
        return inner(pairs, texts, p, scratch)

    monkeypatch.setattr(near_dedup, "confirm", confirm)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = near_dedup.near_duplicates(docs, near_dedup.NearDedup(shingle_words=3, percent=85))
    assert pairs(got, "doc_id", "component_id", "kept") == {(1, 1, True): 41, (2, 1, False): 40}
    assert sizes == [(1, 2)]
    kept = near_dedup.without_near_duplicates(docs, near_dedup.NearDedup(shingle_words=3, percent=85)).collect()
    assert [tuple(r) for r in kept] == [(1, near[0][1], "a")]


def test_densification_estimates_similarity():
    s = near_dedup.mix(np.arange(9, dtype=np.uint64) + np.uint64(5))
    signer = near_dedup.Signer(400, 1)
    agree = np.mean(signer(np.sort(s[:8])) == signer(np.sort(s[1:])))
    assert abs(agree - 7 / 9) < 0.12


# ---- top-k


def brute_top_k(data, k=5, every=50):
    """Results of rows (id, vector or None), each query against all other rows of as many components."""
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v in data if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for n, (q, v) in enumerate(rows):
        if q % every == 0:
            s = sorted((-sum(x * y for x, y in zip(v, w)), i) for m, (i, w) in enumerate(rows) if m != n and len(w) == len(v))[:k]
            out.update((q, r + 1, i, max(-(2**63), min(-x, 2**63 - 1))) for r, (x, i) in enumerate(s))
    return out


@pytest.mark.parametrize("shard,page", [(64, 8), (1000, 300)])
@pytest.mark.parametrize("size", [1 / 3, 1e6, 1e8])
def test_exact_top_k(spark, shard, page, size):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 6)) * size
    v[50:120] = v[50]  # a very common vector
    data = [(i, [float(x) for x in v[i]]) for i in range(300)]
    data += [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1050, [float("nan")] * 6), (None, [0.0] * 6), (1100, []), (1150, [1.0, 2.0]), (1151, [3.0, 0.5]), (1200, [7.0]), (100, [size] * 6), (100, [size] * 6), (7, [size] * 6)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("id", F.lit(0))
    got = metric_search.top_k(df, F.col("vec_id") % 50 == 0, p=metric_search.MetricSearch(shard_rows=shard, page=page, query_block=4))
    assert pairs(got, "query_id", "rank", "vec_id", "score") == brute_top_k(data)


def test_top_k_broadcasts_no_pairs(spark):
    """Blocks of queries meet shards in the tasks: their pairs grow with the square of the table, so none goes through the driver."""
    df = spark.range(400).selectExpr("id AS vec_id", "transform(sequence(1, 4), i -> cast(hash(id, i) % 100 AS double)) AS embedding")
    got = metric_search.top_k(df, F.col("vec_id") % 2 == 0, p=metric_search.MetricSearch(shard_rows=50, query_block=20))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan
    assert pairs(got, "query_id", "rank", "vec_id", "score") == brute_top_k([(r.vec_id, r.embedding) for r in df.collect()], every=2)


def test_scores_beyond_64_bits(spark):
    data = [(0, [1e15, 1e15]), (1, [2e15, 1e15]), (2, [-1e15, -1e15]), (3, [1.0, 0.0]), (4, [0.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in metric_search.top_k(df, F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == [(0, 1, 1, 2**63 - 1), (0, 2, 3, 2**63 - 1), (0, 3, 4, 0), (0, 4, 2, -(2**63))]


def test_bounds_spare_products():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 4)) * 2000
    v = np.concatenate([c + rng.normal(size=(60, 4)) * 5 for c in centres]).astype(np.int64)
    tree = metric_search.build_tree(v, np.arange(len(v)), np.arange(len(v)), 16)
    best, products = metric_search.search_tree(tree, v[3], 3, 5, metric_search.largest(v))
    s = v @ v[3]
    s[3] = -(2**60)
    assert sorted((x for x, _ in best), reverse=True) == sorted(s.tolist(), reverse=True)[:5] and products < len(v) // 2


def test_top_k_of_few_and_none(spark):
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in metric_search.top_k(two, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert metric_search.top_k(two.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# ---- mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return target


def test_mix(docs, rows, empty):
    got = mixing.fair_mix(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    target, taken = brute_targets(dict(sizes)), defaultdict(int)
    longest = max(len(WORD.findall(r[1] or "")) for r in rows)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
        assert r.taken == r.copies * r.size and r.copies in (0, 1, 2)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= longest for s in sizes)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    assert pairs(mixing.fair_mix(docs.repartition(3)), "doc_id", "size", "taken") == pairs(mixing.fair_mix(docs), "doc_id", "size", "taken")
    assert mixing.fair_mix(empty).count() == 0


def test_copies(docs, empty):
    out = mixing.with_copies(docs)
    assert out.columns == docs.columns
    want = Counter()
    for r in mixing.fair_mix(docs).filter("doc_id is not null and doc_id <> 5").collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.filter("doc_id is not null and doc_id <> 5").collect()) == +want
    assert mixing.with_copies(empty).count() == 0


# ---- preferences


TURNS = [
    (0, 0, "user", "hi"), (0, 1, "assistant", "hello"), (0, 2, "user", "more"), (0, 3, "assistant", "good"),
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", "bad"), (1, 4, "user", None),
    (2, 0, "user", "same"), (3, 0, "user", "same"), (3, 0, "user", "same"),
    (4, None, None, None), (4, 1, "assistant", "x"), (5, 0, "system", "y"), (6, 0, "user", "alone"), (None, 0, "user", "hi"),
]


def test_preferences(spark):
    df = spark.createDataFrame([(*t, 1) for t in TURNS], "conv_id long, turn long, role string, text string, pos int")
    named = spark.createDataFrame([(0, 0, 1), (1, 2, 3), (2, 4, 5)], "pair_id long, chosen_id long, rejected_id long")
    got = preference.format_preferences(df, named).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r.pos):
        by[r.pair_id, r.part].append((r.role, r.rendered, r.loss, r.n_common))
    say = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert by[0, "prompt"] == [("user", say("user", "hi"), False, 3), ("assistant", say("assistant", "hello"), False, 3), ("user", say("user", "more"), False, 3)]
    assert by[0, "chosen"] == [("assistant", say("assistant", "good"), True, 3)]
    assert by[0, "rejected"] == [("assistant", say("assistant", "bad"), True, 3), ("user", say("user", ""), False, 3)]
    assert len(by[1, "prompt"]) == 1 and not by[1, "chosen"] and not by[1, "rejected"]
    assert [x[0] for x in by[2, "chosen"]] == [None, "assistant"] and [x[0] for x in by[2, "rejected"]] == ["system"]
    assert {p for p, _ in by} == {0, 1, 2}
    assert preference.format_preferences(df.limit(0), named).count() == 0
    turns = preference.numbered_turns(df)
    many = spark.range(3000).select(F.col("id").alias("pair_id"), F.lit(0).cast("long").alias("chosen_id"), F.lit(1).cast("long").alias("rejected_id"))
    assert preference.format_preferences(df, many).count() == 3000 * (3 + 1 + 2) and turns.count() == 15  # a conversation of very many pairs


def test_exchanged_answers(spark):
    df = spark.createDataFrame([(*t, 1) for t in TURNS] + [(7, 0, "assistant", "u", 1)], "conv_id long, turn long, role string, text string, pos int")
    by = defaultdict(list)
    for r in sorted(preference.format_exchanged(df).collect(), key=lambda r: r.pos):
        by[r.pair_id, r.part].append((r.rejected_id, r.role, r.rendered, r.loss, r.n_common))
    say = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert {p for p, _ in by} == {0, 1}  # 2, 3, 5 and 6 have no answer
    assert [x[2] for x in by[0, "prompt"]] == [say("user", "hi"), say("assistant", "hello"), say("user", "more")] and not any(x[3] for x in by[0, "prompt"])
    assert by[0, "chosen"] == [(1, "assistant", say("assistant", "good"), True, 3)] and by[0, "rejected"] == [(1, "assistant", say("assistant", "bad"), True, 3)]
    assert [x[2] for x in by[1, "rejected"]] == [say("assistant", "good"), say("user", "")] and [x[3] for x in by[1, "rejected"]] == [True, False]
    assert preference.format_exchanged(df.limit(0)).count() == 0


def test_pairs_by_opening(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    got = {tuple(r) for r in preference.pairs_by_opening(preference.numbered_turns(df, block=2)).collect()}
    assert got == {(1, 0, 1), (3, 2, 3)}


# ---- repeated strings


def brute_removed(rows, n):
    texts = [(r[1] or "").encode() for r in rows]
    count = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    for r, t in zip(rows, texts):
        cover = np.zeros(len(t) + 1, int)
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                cover[i] += 1
                cover[i + n] -= 1
        c = np.cumsum(cover)[:-1] > 0
        kept = np.frombuffer(t, np.uint8)[~c].tobytes()
        yield r[0], len(t), int(c.sum()), int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("length,block,cell", [(400, 100, 16), (60, 20, 8)])
def test_repeated_strings(docs, rows, length, block, cell):
    p = substring_dedup.SubstringDedup(length, block, cell)
    got = substring_dedup.remove_repeats(docs, p)
    short = [r for r in rows if r[0] != 207 or length == 400]
    want = Counter(brute_removed(rows, length))
    assert len(short) and pairs(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.collect())


def test_periodic_and_self_overlapping_strings(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    passage = " ".join(words[:120])
    rows = [(1, "ab" * 700), (2, passage), (3, passage[:399]), (4, passage[1:401]), (5, "x" + passage + "y" + passage), (6, " ".join(words)), (7, "a" * 400), (8, "a" * 401), (9, "é" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pairs(substring_dedup.remove_repeats(df, with_text=False), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == Counter(brute_removed(rows, 400))


def test_patterns_that_cancel_out_in_sums_of_powers(spark):
    rng = random.Random(2)
    parity = lambda i: bin(i).count("1") & 1
    tail = "".join(rng.choice("abcdefgh") for _ in range(144))
    rows = []
    for k, (x, y) in enumerate(["ab", "cd", "ef", "gh"]):
        for flip in (0, 1):
            rows.append((2 * k + flip, "".join(y if parity(i) ^ flip else x for i in range(256)) + tail))
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False)
    assert pairs(got, "n_removed") == {(0,): 8}
    whole = substring_dedup.Fingerprints(3)
    data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    for n in (1, 2, 3, 7, 100, 256, 400, 701):
        at = np.arange(len(data) - n + 1)
        prints = whole.of(whole.sums(data), at, at + n)
        strings = [data[i : i + n].tobytes() for i in at]
        assert len(set(zip(strings, prints.tolist()))) == len(set(strings)) == len(set(prints.tolist()))


def test_slices_of_long_documents():
    p = substring_dedup.SubstringDedup(40, 10, 8)
    rng = random.Random(1)
    text = bytes(rng.choice(b"abc ") for _ in range(3000))

    def starts(size):
        out = {}
        for _, a, lo, hi, block, _ in substring_dedup.Sampler(p, size).rows([np.frombuffer(t, np.uint8) for t in (text, b"short", text[:100])]):
            for x in zip(a, lo, hi, block):
                for s in range(x[1], x[2] + 1):
                    out.setdefault(s, set()).add((int(x[0]), int(x[3])))
        return out

    whole, sliced = starts(1 << 16), starts(256)
    assert whole == sliced and len(whole) == 3000 - 39


def brute_shared(rows, n):
    """Windows of n words that another document (id and text) has, too."""
    docs = {(r[0], r[1]): (r[1] or "").encode().split() for r in rows}
    owners = defaultdict(set)
    for d, w in docs.items():
        for i in range(len(w) - n + 1):
            owners[tuple(w[i : i + n])].add(d)
    for r in rows:
        w = docs[r[0], r[1]]
        yield r[0], sum(len(owners[tuple(w[i : i + n])]) > 1 for i in range(len(w) - n + 1))


@pytest.mark.parametrize("length,block", [(51, 8), (12, 3)])
def test_shared_passages(spark, docs, rows, length, block):
    got = substring_dedup.remove_repeats(docs, passages=substring_dedup.Passages(length, block), with_text=False)
    assert pairs(got, "doc_id", "n_shared_windows") == Counter(brute_shared(rows, length))
    assert got.filter("shares_passage <> (n_shared_windows > 0)").isEmpty()


def test_passages_whatever_parts_the_words(spark):
    rng = random.Random(10)
    passage = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    lead = lambda: " ".join(f"x{rng.randrange(10**9)}" for _ in range(30))
    line = "over and over again "
    rows = [(1, f"{lead()} {' '.join(passage)} {lead()}"), (2, f"{lead()}\n{chr(9).join(passage[:51])}\r\n{lead()}"), (3, f"{lead()} {' '.join(passage[:50])} {lead()}"), (4, line * 200), (5, f"{lead()} {lead()} {lead()}")]
    got = dict(pairs(substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_shared_windows"))
    assert set(got) == set(brute_shared(rows, 51)) and {i for i, n in got if n} == {1, 2}


def test_word_hashes_of_long_texts():
    rng = random.Random(6)
    text = b"".join(rng.choice([b"a", b"bc", b"d" * 70, b" ", b"\n", b"\x0b\t"]) for _ in range(2000))
    whole, sliced = substring_dedup.WordHashes(), substring_dedup.WordHashes(50)
    texts = [text, b"", b" ", text[:49], b"a", text[5:40]]
    for x, y in zip(whole.many(texts), sliced.many(texts), strict=True):
        assert (x == y).all()
    assert [len(x) for x in sliced.many(texts)] == [len(t.split()) for t in texts]


def test_nothing_to_remove(empty):
    assert substring_dedup.remove_repeats(empty).count() == 0
