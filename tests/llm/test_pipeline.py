"""The pipeline, stage by stage, against a brute-force version in plain Python."""

import hashlib
import math
import random
import uuid
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest

from siltstone.llm import secret_scan, tokens
from siltstone.llm.quality_rules import COMMON_WORDS, QualityRules
from tests.llm.test_operators import WORD, base_counts, brute_components, brute_targets

RULES = QualityRules()
LISTED = set(COMMON_WORDS)


def classes(t):
    ascii_ = [sum(a <= c <= b for c in t) for a, b in ("az", "AZ", "09")]
    space, symbol = sum(c in " \t\n\x0b\x0c\r" for c in t), sum(c in "#*$%&|<>" for c in t)
    mark = sum("!" <= c <= "~" for c in t) - sum(ascii_) - symbol
    return [*ascii_, space, mark, symbol, len(t) - sum(ascii_) - space - mark - symbol]


def distance(p, q):
    """Jensen-Shannon, base 2, of two distributions given as dicts."""
    total = 0.0
    for k in set(p) | set(q):
        a, b = p.get(k, 0), q.get(k, 0)
        total += sum(x * math.log2(2 * x / (a + b)) for x in (a, b) if x > 0)
    return math.sqrt(max(total / 2, 0))


def histogram(t):
    n = WORD.findall(t)
    hits = Counter(w for w in n if w in LISTED)
    out = {w: c / len(n) for w, c in hits.items()}
    out[None] = 1 - sum(out.values())
    return out


def kept_by_rules(rows):
    info = []
    for i, text, lang, _ in rows:
        t = text or ""
        c = base_counts(t)
        info.append((t, lang, c[0], c[0] < RULES.min_words or 100 * c[4] > RULES.max_repeat_percent * c[0]))
    def fit(chosen):
        per, refs = defaultdict(list), {}
        for t, lang, n, failed in chosen:
            if not failed and lang is not None and n >= RULES.min_words_for_histogram:
                per[lang].append(t)
        for lang, texts in per.items():
            if len(texts) >= RULES.min_reference_documents:
                hc = np.mean([np.array(classes(t)) / len(t) for t in texts], axis=0)
                hw = defaultdict(float)
                for t in texts:
                    for k, v in histogram(t).items():
                        hw[k] += v / len(texts)
                refs[lang] = dict(enumerate(hc)), dict(hw)
        return refs

    def class_distance(x, refs):
        t, lang, _, _ = x
        return distance({k: v / len(t) for k, v in enumerate(classes(t))}, refs[lang][0]) if lang in refs and len(t) >= RULES.min_chars else 0

    def far(x, refs):
        t, lang, n, _ = x
        by_word = lang in refs and n >= RULES.min_words_for_histogram and distance(histogram(t), refs[lang][1]) > RULES.max_word_distance + math.sqrt(RULES.word_noise / n)
        return by_word or class_distance(x, refs) > RULES.max_class_distance + math.sqrt(RULES.class_noise / max(1, len(t)))

    first = fit(info)
    refs = fit([x for x in info if class_distance(x, first) <= RULES.trim_class_distance])
    return [r for r, x in zip(rows, info) if not x[3] and not far(x, refs)]


def without_near(rows):
    _, root = brute_components(rows, 5, 80)
    kept = [r for r in rows if r[0] is None or root[r[0]] == r[0]]
    return list(dict.fromkeys(r[:2] for r in kept)), kept


def mixed(rows):
    sizes = defaultdict(int)
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    for r, n in zip(rows, size):
        sizes[r[3]] += n
    target = brute_targets(dict(sizes))
    place = lambda r: hashlib.md5(":".join(str(x) for x in ("mix", r[0], None if r[1] is None else hashlib.md5(r[1].encode()).hexdigest()) if x is not None).encode()).hexdigest()
    queue = []
    for s in sizes:
        mine = sorted(((place(r), -1 if r[0] is None else r[0], n, r) for r, n in zip(rows, size) if r[3] == s), key=lambda x: x[:2])
        for round_ in (0, 1):
            total = round_ * sizes[s]
            for p, i, n, r in mine:
                total += n
                if n and target[s]:
                    queue.append((total / target[s], s is None, s or "", round_, p, i, n, r))
    taken, total, out = 0, 1.5 * sum(sizes.values()), Counter()
    for x in sorted(queue, key=lambda x: x[:6]):
        taken += x[6]
        if taken > total:
            break
        out[x[7]] += 1
    return out


@pytest.fixture(scope="module")
def stages(spark, docs, tmp_path_factory):
    """Each stage's input and output, written and read again as the driver does."""
    folder = tmp_path_factory.mktemp("pipeline")
    df = docs.select("doc_id", "text", "lang", "source", "n_chars")
    df.write.parquet(str(folder / "documents.parquet"))
    data = spark.read.parquet(str(folder / "documents.parquet"))
    out = []
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        before = data
        f(spark, before, str(folder)).write.parquet(str(folder / f"out-{k}"))
        data = spark.read.parquet(str(folder / f"out-{k}"))
        out.append((name, before.collect(), data.collect(), data.columns))
    return out, str(folder)


def as_rows(collected):
    return [(r.doc_id, r.text, r.lang, r.source) for r in collected]


def test_each_stage(stages):
    steps, _ = stages
    assert [s[0] for s in steps] == ["quality rules", "near dedup", "secret scan", "source mix", "packing"]
    assert all(s[3] == ["doc_id", "text", "lang", "source", "n_chars"] for s in steps[:-1])
    _, before, after, _ = steps[0]
    assert Counter(as_rows(after)) == Counter(kept_by_rules(as_rows(before))) and 0 < len(after) < len(before)
    _, before, after, _ = steps[1]
    distinct, kept = without_near(as_rows(before))
    assert Counter(r[:2] for r in as_rows(after)) == Counter(distinct) and set(as_rows(after)) <= set(kept) and len(after) < len(before)
    _, before, after, _ = steps[2]
    model = secret_scan.train(secret_scan.labelled_samples())
    want = Counter((i, None if t is None else secret_scan.redact(t, secret_scan.find_secrets(t, model, secret_scan.SecretScan()), "[SECRET]"), lang, s) for i, t, lang, s in as_rows(before))
    assert Counter(as_rows(after)) == want and any("[SECRET]" in (r.text or "") for r in after) and all(r.text is None or r.n_chars == len(r.text) for r in after)
    _, before, after, _ = steps[3]
    assert Counter(as_rows(after)) == +mixed(as_rows(before))
    _, before, after, _ = steps[4]
    plain = tokens.open_tokenizer(None)
    by = defaultdict(list)
    for r in after:
        by[r.sequence_id].append(r)
    assert all(sum(p.length for p in ps) <= 2048 and len(ps) <= 64 for ps in by.values())
    texts = defaultdict(Counter)
    for r in before:
        texts[r.doc_id][plain.encode(r.text or "") + (1).to_bytes(4, "little")] += 1
    total = sum(len(b) // 4 * n for c in texts.values() for b, n in c.items())
    assert total == sum(r.length for r in after)
    for i, c in texts.items():
        pieces = Counter((r.start, bytes(r.ids)) for r in after if r.doc_id == i)
        whole = Counter()
        for (start, ids), n in pieces.items():
            assert any(b[4 * start : 4 * start + len(ids)] == ids for b in c)
            whole[start] += n
        assert whole[0] == sum(c.values())


def test_run(spark, stages):
    steps, folder = stages
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == steps[-1][3] and sum(r.length for r in out.collect()) == sum(r.length for r in steps[-1][2])


def test_empty_pipeline(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_small_memory_of_workers(spark, docs, tmp_path):
    """Batches are bounded by bytes; a table of few pieces takes little and finds the same as it grows."""
    corpus_pipeline.packing(spark, docs, str(tmp_path))
    assert spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() == 4 << 20
    table, rng = tokens.PieceTable(1_200_000), np.random.default_rng(1)
    assert table.slots.nbytes < 1 << 20
    a, b = rng.integers(0, 1 << 64, (2, 100_000), dtype=np.uint64)
    for lo in range(0, 100_000, 5_000):
        at = slice(lo, lo + 5_000)
        table.add(a[at], b[at], np.ones(5_000, np.int64), np.arange(lo, lo + 5_000, dtype=np.uint32))
    found = table.find(a, b)
    assert (found & np.uint64(0xFFFF) == 1).all() and (table.ids[(found >> np.uint64(16)).astype(np.int64)] == np.arange(100_000)).all()
    assert table.n == 100_000 <= 2 * len(table.slots) // 3 and not table.find(b, a).any()


def shuffled(spark, run):
    """Bytes that a function's jobs write to shuffles."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "shuffled")
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    sc.setJobGroup("", "")
    tracker = sc.statusTracker()
    ids = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    done = [sc._jsc.sc().statusStore().lastStageAttempt(s) for s in ids]
    return sum(s.shuffleWriteBytes() for s in done if s.status().toString() == "COMPLETE")


def test_texts_are_not_shuffled_for_a_verdict(spark, tmp_path):
    """Joins by broadcast would hide it on a small table, so they are off but where a stage asks for one or, for the mix, a table is tiny."""
    rng = random.Random(5)
    text = lambda n: " ".join(f"{rng.getrandbits(32):08x}" for _ in range(n))
    rows = [(i, text(10 if i % 10 == 0 else 1500), "en", f"src{i % 3}", 0) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " more", "en", "src0", 0) for i in range(1, 20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(str(tmp_path / "docs"))
    docs, size, before = spark.read.parquet(str(tmp_path / "docs")), sum(len(r[1]) for r in rows), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for k, threshold, most in ((0, "-1", 0.05), (1, "-1", 1), (3, "8k", 0.05)):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            got = shuffled(spark, lambda: corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out-{k}")))  # noqa: B023
            assert got < most * size, (corpus_pipeline.STAGES[k][0], got / size)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
