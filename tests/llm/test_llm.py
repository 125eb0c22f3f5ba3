"""Small fixtures against brute force, with nulls, empties, repeats and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import audio, bpe, components, importance, jaccard, lines, packing, queries, rules, shingles, stages, toxicity, urls, warc
from tessella.llm.base import written

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
ODD = [None, "", "   \n\t ", "one", "The Quick brown fox's 123 don't", "é É ñ Ñandú ß", "日本語 テキスト", "İstanbul ΑΣ Σ", "a\x1cb\x85c d　e", "<|endoftext|> x<|startoftext|>y", "café ẛ̣", "²³ ½ x²", "w" * 500 + " " + "ab" * 300, "🙂🙂 ok 🙂", "﻿x ​ y", "'S 'LL 'Ve d'accord"]


@pytest.fixture(scope="module")
def path():
    pytest.importorskip("public_tokenizers")
    return queries.vocabulary()


def texts(spark, values, **more):
    return spark.createDataFrame([(i, v, "s", *more.values()) for i, v in enumerate(values)], "doc_id long, text string, source string" + "".join(f", {k} int" for k in more))


def test_bpe_round_trip_is_the_library(spark, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    values = ODD + ODD[:4] + [" ".join(WORDS) * 50]
    out = bpe.decode(bpe.encode(texts(spark, values, ids=1), path, hot_words=5, task_words=7), path).collect()
    assert len(out) == len(values)
    for r in out:
        want = t.encode(values[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want, values[r.doc_id]
        assert r.decoded == t.decode(want, skip_special_tokens=False)
    assert bpe.encode(texts(spark, [None]).limit(0), path).count() == 0


def test_fast_words_match_library_on_table(spark, path, sf_dir):
    encoder = bpe.WordEncoder(path)
    words = sorted({w for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect() for w in r.text.split()})
    for w, e in zip(words, encoder.library.encode_batch(words, add_special_tokens=False), strict=True):
        assert np.frombuffer(encoder(w), "<u4").tolist() == e.ids


def test_packing_is_gapless_and_whole(spark, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    rng = np.random.default_rng(0)
    values = ODD + [" ".join(rng.choice(WORDS, n)) for n in (3, 50, 700, 5000, 9000, 300, 300, 299, 1200)]
    rows = packing.pack(texts(spark, values, tier=1).coalesce(2), path).collect()
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        docs[r.doc_id].append(r)
    padding = 0
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += len(r.ids) // 4
        assert 0 < at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding < 2 * 4096
    for i, v in enumerate(values):
        want = np.array([*t.encode(v or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        parts = sorted(docs[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in parts) == want and [r.start for r in parts] == list(np.cumsum([0] + [len(r.ids) // 4 for r in parts])[:-1])
        assert {r.doc_tokens for r in parts} == {len(want) // 4}


def test_packing_prefers_whole_documents():
    p = packing.Packer((8, 16))
    for i, n in enumerate([5, 3, 7, 9, 6, 2, 8, 4] * 30):
        p.add(i, bytes(4 * n))
    p.finish()
    pieces = Counter(r[0] for r in p.rows)
    assert sum(n > 1 for n in pieces.values()) < 60
    groups = defaultdict(int)
    for r in p.rows:
        groups[r[7]] += len(r[2]) // 4
    assert max(groups.values()) <= 1 << 16


def test_rule_counts_by_brute_force(spark):
    values = [*ODD, "a b c a b c\nx\nx\n\n \nx", "a a a a", "a b a b", "# $ a\n<b>", "x y\tz x y z\r\nx y z"]
    for r in rules.with_counts(texts(spark, values, n_words=3)).select("text", *rules.COUNTS).collect():
        x = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        grams, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
        for i in range(len(w) - 2):
            if grams[tuple(w[i : i + 3])] > 1:
                covered |= {i, i + 1, i + 2}
        have = [y for y in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), len(have) - len(set(have)), len(covered)), x


def test_rules_drop_junk_and_keep_clean(spark):
    rng = np.random.default_rng(1)
    clean = [". ".join(" ".join(w + str(k) for w, k in zip(rng.choice(WORDS, 8), rng.integers(0, 30, 8), strict=True)) for _ in range(25)) + "." for _ in range(80)]
    junk = [" ".join(w + "%%%" for w in rng.choice(WORDS, 120)) + "." for _ in range(15)]
    out = {r.doc_id for r in rules.filter_documents(texts(spark, [*clean, *junk, None, ""], kept=1)).collect()}
    assert out == set(range(80))
    assert rules.filter_documents(texts(spark, [None]).limit(0)).count() == 0


def test_outcomes_are_distributions():
    model = rules.maximise([((1, 0), 9000), ((0, -1), 300), ((1, -1), 300), ((-1, 0), 200), ((0, 0), 200)], ["a", "b"])
    assert np.allclose(model.outcomes.sum(2), 1) and np.isclose(model.shares.sum(), 1) and (model.outcomes > 0).all()
    none = rules.maximise([], ["a"])
    assert none.shares[0] == 0.85 and none.posterior((-1,)) < 0.5 < none.posterior((0,))


def test_planted_accuracies_are_recovered():
    """Four rules, four kinds of junk; what "c" knows "b" and "d" see too, so that "c" alone is a false alarm."""
    rng = np.random.default_rng(8)
    truth = np.array([[0.005, 0.005, 0.006, 0.005], [0.95, 0.01, 0.01, 0.01], [0.02, 0.95, 0.02, 0.8], [0.02, 0.9, 0.95, 0.9], [0.02, 0.1, 0.02, 0.95]])
    kind = rng.choice(5, 60_000, p=[0.8, 0.06, 0.05, 0.06, 0.03])
    votes = Counter(tuple(map(int, v)) for v in -(rng.random((len(kind), 4)) < truth[kind]).astype(int))
    model = rules.maximise(sorted(votes.items()), list("abcd"))
    assert np.abs(model.shares - [0.8, 0.06, 0.05, 0.06, 0.03]).max() < 0.02 and np.abs(model.outcomes[0, :, 0] - truth[0]).max() < 0.01
    assert np.abs(np.diag(model.outcomes[1:, :, 0]) - np.diag(truth[1:])).max() < 0.1
    assert model.posterior((0, 0, -1, 0)) > 0.5 > model.posterior((-1, 0, 0, 0))  # one bad vote is outvoted, another one isn't
    assert model.accuracy("a")[1] > 0.9


def test_verdict_by_brute_force(spark, sf_dir):
    """Posterior and verdict of the query, from the votes by Bayes' rule in plain numbers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    voted = rules.with_votes(rules.with_counts(docs)).collect()
    names = list(rules.rules())
    ballots = {r.doc_id: tuple(r[rules.PREFIX + x] for x in names) for r in voted}
    model = rules.maximise(sorted(Counter(ballots.values()).items()), names)
    for r in queries.op3_quality_rules(spark, sf_dir).collect():
        likely = [share * np.prod([row[v + 1] for row, v in zip(rows, ballots[r.doc_id], strict=True)]) for share, rows in zip(model.shares, model.outcomes, strict=True)]
        assert r.quality == pytest.approx(likely[0] / sum(likely), abs=1e-9)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed and r.quality >= 0.5)


def test_long_texts_need_distinct_words(spark):
    values = [" ".join(f"w{i % d}" for i in range(3000)) for d in (20, 700, 1100)]
    voted = rules.with_votes(rules.with_counts(texts(spark, values))).orderBy("doc_id").collect()
    assert [r["__rule_distinct"] for r in voted] == [-1, 0, 1]


def test_audio_is_lossless_and_deterministic(spark):
    values = [b"", None, b"a", bytes(range(256)) * 40, bytes(range(256)) * 40, b"\x00" * 64 + b"\xff" * 4000]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(values)], "doc_id long, payload binary, media int")
    got = {r.doc_id: r for r in audio.features(df).collect()}
    for i, v in enumerate(values):
        assert audio.samples(bytes(got[i].media))[1].tobytes() == (v or b"")
        t = audio.tensors(bytes(got[i].tensors))
        assert len(t) == -(-got[i].frames // audio.BLOCK)
        if len(t):
            assert t.schema.field("log_mel").type.shape == [audio.BLOCK, audio.MELS]
    assert (got[3].tensors, got[3].spans) == (got[4].tensors, got[4].spans)


def test_audio_features_by_brute_force(spark):
    """Log-mel frames by plain sums over the resampled clip; spans in seconds; clashing columns; an empty table."""
    t = np.arange(6000)
    loud = 127 + 100 * np.sin(t / 5) * ((t > 2000) & (t < 4000))
    df = spark.createDataFrame([(1, bytes(loud.astype(np.uint8).tolist()), "a", 2)], "doc_id long, payload binary, frames string, tensors int")
    r = audio.features(df).first()
    rate = audio.RATE * audio.UP / audio.DOWN
    assert audio.UP > 1 and audio.DOWN > 1  # more than one branch is in use
    y = audio.resample((loud.astype(np.uint8).astype(np.float32) - 128) / 128).astype(float)
    assert len(y) == -(-6000 * audio.UP // audio.DOWN)
    filters, window = audio.mel_filters(rate), np.hanning(audio.FRAME)
    whole = np.concatenate([y, np.zeros(audio.FRAME)])
    got = np.concatenate(list(audio.tensors(bytes(r.tensors)).column("log_mel").combine_chunks().to_numpy_ndarray()))
    for f in range(0, r.frames, 5):
        frame = whole[f * audio.HOP : f * audio.HOP + audio.FRAME] * window
        power = [abs(sum(frame * np.exp(-2j * np.pi * k * np.arange(audio.FRAME) / audio.FRAME))) ** 2 for k in range(audio.FRAME // 2 + 1)]
        assert np.allclose(got[f], np.log(np.maximum(np.array(power) @ filters, np.exp(float(audio.FLOOR)))), atol=2e-2)
    (span,) = r.spans
    assert abs(span.start - 2000 / audio.RATE) < 0.03 and abs(span.end - 4000 / audio.RATE) < 0.03
    starts = audio.tensors(bytes(r.tensors)).column("start").to_pylist()
    assert np.allclose(np.diff(starts), audio.BLOCK * audio.HOP / rate)
    assert audio.features(df.limit(0)).count() == 0


def test_polyphase_is_the_plain_filter():
    x = np.random.default_rng(2).normal(size=101).astype(np.float32)
    for up, down in ((1, 2), (2, 3), (3, 1), (3, 2)):
        bank = audio.branches(up, down)
        taps = bank.shape[1]
        h = np.zeros(up * taps)
        for p in range(up):
            h[p::up] = bank[p]
        wide = np.zeros(len(x) * up)
        wide[::up] = x
        full = np.convolve(wide, h)
        shift = (taps // 2 - 1) * up
        got = audio.resample(x, up, down)
        want = [full[n * down + shift] if n * down + shift < len(full) else 0.0 for n in range(len(got))]
        assert np.allclose(got[:-taps], want[:-taps], atol=1e-4), (up, down)


def test_hysteresis_segments():
    level = np.array([0, 0, 3, 6, 10, 6, 3, 0, 0, 3, 3, 0, 0, 9, 1, 0, 0, 0, 0], float)
    assert audio.segments(level) == [(3, 7), (13, 14)]
    assert audio.segments(np.zeros(0)) == [] and audio.segments(np.ones(5)) == []


def brute_components(values, k=5, num=75):
    sets = []
    for v in values:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), v or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("small", "names"), [(48, 64), (1, 64), (1, 5)])
def test_jaccard_join_by_brute_force(spark, monkeypatch, small, names):
    """With small = 1 all buckets take the way of large ones; with names of few bits many sets clash in one word."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    if names < 64:
        whole = shingles.fingerprint
        monkeypatch.setattr(jaccard, "fingerprint", lambda s: bytes([whole(s)[0] % (1 << names)]) + bytes(7) + whole(s)[8:])
    rng = np.random.default_rng(3)
    values = list(ODD)
    for n in (4, 6, 9, 20, 60, 150, 400, 5000):
        for _ in range(3 if n < 5000 else 1):
            base = list(rng.choice(WORDS, n))
            values.append(" ".join(base))
            for cut in (0.01, 0.02, 0.03, 0.05, 0.08):
                copy = list(base)
                for at in rng.choice(n, max(1, int(cut * n)), replace=False):
                    copy[at] = "changed" + str(rng.integers(1000))
                values.append(" ".join(copy))
            values.append(" ".join(base).upper())
            values.append(" ".join(base[: max(1, int(n * 0.8))]))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(texts(spark, values, n=1, sid=2)).collect()}
    assert [got[i] for i in range(len(values))] == brute_components(values)


def test_jaccard_join_on_empty_and_null_keys(spark):
    df = texts(spark, ["a b c d e f", "a b c d e f", None])
    assert jaccard.classes(df.limit(0)).count() == 0
    named = df.withColumn("doc_id", F.when(F.col("doc_id") != 1, F.col("doc_id")))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.classes(named).collect()) == [("0", 2, "0"), ("2", 0, "2"), ("None", 2, "0")]


def test_linked_sets_share_as_many_signatures_as_needed():
    """The bound itself, on random pairs right at the threshold, with frequent shingles among them."""
    rng = np.random.default_rng(4)
    shared_counts = [rng.integers(0, most, jaccard.COUNTERS).astype(np.uint8) for most in (10, 25, 60)]
    for trial in range(300):
        n = int(rng.choice([1, 2, 3, 5, 8, 13, 30, 77, 200, 700]))
        counts = shared_counts[trial % 3]
        a = np.unique(shingles.mix(rng.integers(0, 1 << 60, n).astype(np.uint64)))
        lost, gained = int(rng.integers(0, len(a) // 4 + 1)), 0
        while 100 * (len(a) - lost) >= 75 * (len(a) + gained + 1) and rng.random() < 0.9:
            gained += 1
        b = np.unique(np.concatenate([a[lost:], shingles.mix(rng.integers(1 << 61, 1 << 62, gained).astype(np.uint64))]))
        inter = len(np.intersect1d(a, b))
        if 100 * inter < 75 * (len(a) + len(b) - inter) or not len(b):
            continue
        (sa, na), (sb, nb) = jaccard.signatures(a, counts, 20, 75), jaccard.signatures(b, counts, 20, 75)
        assert len(np.intersect1d(sa, sb)) >= max(na, nb), (trial, n, lost, gained)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (500, 499)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), **dict.fromkeys(range(101, 130), 100), 500: 499}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    rng = np.random.default_rng(11)
    pairs = rng.integers(0, 400, (300, 2)).tolist()
    parent = list(range(400))
    for _ in range(400):
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r.node: r.label for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: p for i, p in enumerate(parent) if i != p}


def test_components_in_one_task_and_by_rounds(spark, monkeypatch):
    rng = np.random.default_rng(13)
    pairs = [*rng.integers(0, 60, (45, 2)).tolist(), *[(100 + i, 101 + i) for i in range(6)], (None, 3)]
    df = spark.createDataFrame(pairs, "a long, b long")
    plans = recorded(monkeypatch, components)
    few = sorted(map(tuple, components.components(df).collect()))
    assert len(plans) == 2
    monkeypatch.setattr(components, "LOCAL", 8)
    assert sorted(map(tuple, components.components(df).collect())) == few
    named = spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "y")], "a string, b string")
    assert sorted(map(tuple, components.components(named).collect())) == [("b", "a"), ("c", "a"), ("y", "x")]


def test_large_buckets_of_several_components_are_settled(spark, monkeypatch):
    """Documents that share one passage, and near copies among them that no hub links."""
    monkeypatch.setattr(jaccard, "SMALL", 1)
    monkeypatch.setattr(jaccard, "HUBS", 1)
    rng = np.random.default_rng(12)
    values, passage = [], [f"p{i}" for i in range(30)]
    for d in range(40):
        own = [f"w{d}x{i}" for i in range(60)]
        for _ in range(int(rng.integers(1, 4))):
            copy = list(own)
            copy[int(rng.integers(60))] = "changed" + str(rng.integers(10**6))
            values.append(" ".join(passage + copy))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(texts(spark, values)).collect()}
    assert [got[i] for i in range(len(values))] == brute_components(values)


def recorded(monkeypatch, module):
    """Label and plan of every table that ``module`` writes from now on."""
    plans, write = [], module.written

    def seen(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, label)

    monkeypatch.setattr(module, "written", seen)
    return plans


@pytest.mark.parametrize("first", [1, 16])
def test_lists_of_buckets_are_bounded_and_not_broadcast(spark, monkeypatch, first):
    """Near pairs of different components in 60 buckets, once each; with first = 1 they meet several times."""
    monkeypatch.setattr(jaccard, "FIRST", first)
    rng = np.random.default_rng(14)
    base = np.unique(shingles.mix(rng.integers(0, 1 << 60, 80).astype(np.uint64)))
    own = [np.unique(np.append(base[1:], np.uint64(i))) if i < 9 else shingles.mix(np.arange(i * 1000, i * 1000 + 80, dtype=np.uint64)) for i in range(12)]
    names = ["nid", "n", *jaccard.SKETCH]
    known = spark.createDataFrame([(i, len(s), *jaccard.sketch(s).tolist()) for i, s in enumerate(own)], ", ".join(f"{x} long" for x in names))
    inside = [(b, i) for b in range(60) for i in range(12) if rng.random() < 0.4]
    label = [0, 0, 0, 0, 4, 4, 6, 7, 8, 9, 10, 11]
    plans = recorded(monkeypatch, jaccard)
    tables = [written(spark.createDataFrame(rows, ddl), "given") for rows, ddl in ((inside, "bid long, nid long"), ([(i, x) for i, x in enumerate(label) if i != x], "node long, label long"))]
    got = sorted(map(tuple, jaccard.leftovers(*tables, known, 75).collect()))
    assert got == sorted({(a, b) for x, a in inside for y, b in inside if x == y and a < b < 9 and label[a] != label[b]})
    assert "collect_set" in plans[-1][1] and "Broadcast" not in plans[-1][1]


def test_members_of_large_buckets_are_broadcast_only_if_few(spark, monkeypatch):
    """A table of a few kilobytes, as its values repeat, of many rows."""
    plans = recorded(monkeypatch, jaccard)
    wide = spark.range(0, 300_000, 1, 2).select((F.col("id") % 100).alias("bid"), F.expr("id div 100").alias("a"), *[F.lit(None).cast("long").alias(x) for x in ("b", "shared", "need")])
    pairs, large = jaccard.candidates(wide)
    assert large.count() == 300_000 and pairs.count() > 0
    assert "Broadcast" not in dict(plans)["pairs"]
    pairs, large = jaccard.candidates(wide.where("a < 100"))
    assert large.count() == 10_000 and "Broadcast" in plans[-1][1]


def test_representatives_keep_one_of_each_group(spark):
    same = " ".join(WORDS)
    df = texts(spark, [same, same + " end", "other words entirely here now", None, ""])
    assert sorted(r.doc_id for r in jaccard.representatives(df).collect()) == [0, 2, 3, 4]
    twice = df.unionByName(df)
    assert sorted(r.doc_id for r in jaccard.representatives(twice).collect()) == [0, 2, 3, 4]


def test_representatives_tell_rows_of_one_id_apart(spark):
    same, other = " ".join(WORDS), "a text without any near copy at all"
    rows = [(0, same), (1, same), (1, other), (1, None), (2, same), (None, same)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    assert Counter((r.doc_id, r.text) for r in jaccard.representatives(df).collect()) == Counter([(0, same), (1, other), (1, None), (None, same)])


def test_line_dedup(spark):
    rows = [(i, f"own {i}\nfooter\n\n", "h") for i in range(20)] + [(100 + i, f"footer\nown {i}", "other") for i in range(3)] + [(200, None, "h"), (201, "footer", None)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, n_lines int")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lines.dedup(df).collect()}
    assert got[0] == ("own 0\n\n", 4, 1) and got[100] == ("footer\nown 0", 2, 0) and got[200] == (None, 0, 0) and got[201] == ("footer", 1, 0)
    assert lines.dedup(df.limit(0)).count() == 0


def test_line_stage_drops_what_many_pages_repeat(spark):
    rows = [(i, f"own {i % 700}\nshort {i % 400}" + "\nlicense" * (i % 100 == 0) + "\nfew" * (i < 4), "h") for i in range(1000)]
    rows += [(2000 + i, f"own {i}\nlicense", "small") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in stages.dedup_lines(spark, df, "").collect()}
    assert {i: x.replace("\nlicense", "") if i < 2000 else x for i, x, _ in rows} == got


def test_url_list_is_as_of(spark):
    entries = spark.createDataFrame([("bad.com", "add", 10), ("bad.com", "remove", 20), ("x.bad.com", "add", 15), ("tie.com", "add", 5), ("tie.com", "remove", 5), (None, "add", 1)], "domain string, action string, at int")
    caps = spark.createDataFrame([(1, "http://www.bad.com/a", 9), (2, "http://u@BAD.com:80/a", 10), (3, "http://bad.com", 20), (4, "https://x.bad.com./", 30), (5, "http://notbad.com", 15), (6, None, 15), (7, "http://tie.com", 6), (8, "http://bad.com", None), (2, "http://u@BAD.com:80/a", 10)], "page_id int, url string, fetched_at int")
    got = sorted((r.page_id, r.blocked, r.matched_domain, r.since) for r in urls.evaluate(caps, entries).collect())
    assert got == [(1, False, None, None), (2, True, "bad.com", 10), (2, True, "bad.com", 10), (3, False, None, None), (4, True, "x.bad.com", 15), (5, False, None, None), (6, False, None, None), (7, False, None, None), (8, False, None, None)]
    assert not any(r.blocked for r in urls.evaluate(caps, entries.limit(0)).collect())


def test_revisits(spark):
    h = lambda **k: [(n.replace("_", "-"), v) for n, v in k.items()]
    rows = [
        (1, "http://A.com/x?utm_source=f#t", 1, 200, h(ETag='"1"', Content_Length="9", Date="d1")),
        (2, "https://a.com:443/x/", 2, 304, h(etag='W/"1"', Content_Length="0", Date="d2", Age="3")),
        (3, "http://a.com/x", 3, 200, h(ETag='"2"')),
        (4, "http://a.com/x", 4, 304, h(ETag='"1"')),
        (5, "http://b.com/", 4, 304, h(ETag='"1"')),
        (6, "http://a.com/x", 5, 304, None),
        (7, None, 5, 304, None),
        (8, "http://c.com", 1, 200, h(Last_Modified="m")),
        (9, "http://c.com", 9, 304, h(Last_Modified="m", Content_Type="t")),
        (10, "http://d.com", 1, 200, h(ETag='"4"')),
        (11, "http://d.com", 2, 404, h(ETag='"5"')),
        (12, "http://d.com", 3, 206, h(ETag='"5"')),
        (13, "http://d.com", 4, None, h(ETag='"5"')),
        (14, "http://d.com", 5, 304, h(ETag='"4"')),
        (15, "http://e.com", 7, 200, h(ETag='"6"')),
        (16, "http://e.com", 7, 304, h(ETag='"6"')),
        (17, "http://e.com", 7, 200, h(ETag='"7"')),
        (18, "http://e.com", 7, 304, [("ETag", '"7"'), (None, "x"), ("X", None)]),
    ]
    df = spark.createDataFrame(rows, "capture_id int, url string, t int, status int, headers array<struct<name:string,value:string>>").withColumn("fetched_at", F.timestamp_seconds("t")).drop("t")
    got = {r.capture_id: r for r in warc.resolve(df).collect()}
    assert {k: (r.resolution, r.source_key) for k, r in got.items()} == {1: ("full", None), 2: ("resolved", 1), 3: ("full", None), 4: ("mismatch", 3), 5: ("orphan", None), 6: ("unverified", 3), 7: ("invalid", None), 8: ("full", None), 9: ("resolved", 8),
        10: ("full", None), 11: ("other", None), 12: ("other", None), 13: ("other", None), 14: ("resolved", 10), 15: ("full", None), 16: ("resolved", 15), 17: ("full", None), 18: ("resolved", 17)}
    assert sorted(tuple(x) for x in got[2].headers) == [("Age", "3"), ("Content-Length", "9"), ("Date", "d2"), ("etag", 'W/"1"')]
    assert warc.resolve(df.limit(0)).count() == 0
    again = warc.resolve(df.unionByName(df.where("capture_id in (2, 11)")).withColumns({"k": F.lit(1), "src": F.lit("x"), "resolution": F.lit(3)}))
    assert sorted((r.capture_id, r.resolution) for r in again.collect()) == sorted([(k, r.resolution) for k, r in got.items()] + [(2, "resolved"), (11, "other")])


def test_revisits_by_brute_force(spark, monkeypatch):
    """Several full responses a URL, ties in time, few spans: the latest earlier full response by scanning all."""
    monkeypatch.setattr(warc, "BUCKETS", 3)
    rng = np.random.default_rng(13)
    rows = [(i, f"http://h/{rng.integers(3)}", int(rng.integers(25)), int(rng.choice([200, 304, 304, 404])), [("ETag", str(rng.integers(3)))]) for i in range(200)]
    df = spark.createDataFrame(rows, "capture_id int, url string, t int, status int, headers array<struct<name:string,value:string>>").withColumn("fetched_at", F.timestamp_seconds("t")).drop("t")
    got = {r.capture_id: (r.resolution, r.source_key) for r in warc.resolve(df).collect()}
    for k, u, t, s, h in rows:
        before = max(((x[2], x[0], x[4]) for x in rows if x[1] == u and x[3] == 200 and (x[2], x[0]) < (t, k)), default=None)
        want = ("full", None) if s == 200 else ("other", None) if s == 404 else ("orphan", None) if before is None else ("resolved" if before[2] == h else "mismatch", before[1])
        assert got[k] == want


def test_toxicity_learns_interactions_and_holds_out():
    rng = np.random.default_rng(5)
    rows, y = [], []
    for _ in range(1500):
        x = [int(i) for i in np.flatnonzero(rng.random(12) < 0.3)]
        rows.append(x)
        y.append(float(0 in x and 1 in x))
    w0, w, v = toxicity.train_machine(rows[:1000], np.array(y[:1000]), 12, epochs=80)
    model = toxicity.Machine(np.arange(12), w0, w, v)
    hits = [(model.logit(x) > 0) == bool(t) for x, t in zip(rows[1000:], y[1000:], strict=True)]
    assert np.mean(hits) > 0.97


def test_toxicity_edges(spark):
    df = texts(spark, ["you moron", None, "", "fine words"] * 8)
    labels = spark.createDataFrame([(i, 1 if i % 4 == 0 else 0) for i in range(28)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, min_docs=1)
    got = {r.doc_id: r.score for r in toxicity.score(df.withColumn("score", F.lit("x")), model).collect()}
    assert got[28] > 0.5 > got[31] and got[29] == got[30] and all(0 <= x <= 1 for x in got.values())
    none = toxicity.fit(df, labels.limit(0))
    assert all(r.score < 1e-9 for r in toxicity.score(df, none).collect())


def test_toxicity_trains_on_labels_that_have_texts(spark):
    df = texts(spark, ["you moron", "fine words"] * 20)
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(40)] + [(i, 0) for i in range(1000, 3000)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(df, toxicity.fit(df, labels, max_rows=40)).collect()}
    assert got[0] > 0.5 > got[1]


def test_toxicity_on_held_out_rows(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = queries.op9_toxicity(spark, d).join(labels, "doc_id").where("held_out").collect()
    assert docs.count() == 1000 and np.mean([r.predicted == r.toxic for r in got]) > 0.85


def test_importance_threshold_is_exact(spark):
    values = [int(x) for x in np.random.default_rng(6).integers(-(2**40), 2**40, 500)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 7, 250, 500):
        assert importance.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    assert importance.kth_largest(df, "v", 501) is None


def test_digits_order_as_doubles_do(spark):
    rng = np.random.default_rng(9)
    values = sorted({0.0, 1.0, -1.0, 1 - 2**-53, 1 + 2**-52, 2 - 2**-52, 2.0, 3e-300, -3e-300, 1e300, *rng.normal(0, 1, 300).tolist(), *(rng.normal(0, 1, 300) * 10.0 ** rng.integers(-30, 30, 300)).tolist()})
    got = [r.d for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", importance.digits(F.col("v")).alias("d")).orderBy("v").collect()]
    assert all(a < b for a, b in zip(got, got[1:], strict=False))


def test_resampling_by_brute_force(spark):
    """Log weights and the chosen set, from n-gram counts in plain Python; and equal weights are drawn equally often."""
    rng = np.random.default_rng(10)
    values = [" ".join(rng.choice(WORDS, int(rng.integers(1, 60)))) for _ in range(60)] + [None, "", "Alpha  alpha\nBETA", "long " * 20_000] + ["alpha beta"] * 3
    good = set(range(0, 40, 3)) | {61}
    labels = spark.createDataFrame([(i, 1) for i in good] + [(i, 0) for i in range(1, 40, 3)] + [(2, None), (None, 1), (999, 1)], "doc_id long, quality int")
    table = importance.Hashes()
    grams = [Counter(table.grams(v or "").tolist()) for v in values]
    raw, target = np.ones(importance.BUCKETS), np.ones(importance.BUCKETS)
    for i, g in enumerate(grams):
        for b, n in g.items():
            raw[b] += n
            target[b] += n * (i in good)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    df = texts(spark, values, kept=1, n_grams=2)
    out = {r.doc_id: r for r in importance.resample(df, labels, share=0.4).collect()}
    for i, g in enumerate(grams):
        assert out[i].n_grams == sum(g.values()) and out[i].log_weight == pytest.approx(sum(n * ratio[b] for b, n in g.items()), rel=1e-9, abs=1e-9)
    noise = {r.doc_id: r.g for r in df.select("doc_id", importance.gumbel(F.col("doc_id"), 1).alias("g")).collect()}
    order = sorted(out, key=lambda i: -(out[i].log_weight + noise[i]))
    assert {i for i in out if out[i].kept} == set(order[: round(0.4 * len(values))])
    same = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("alpha").alias("text"))
    shares = [importance.resample(same, labels, share=0.3, seed=s).agg(F.avg(F.col("kept").cast("int")), F.avg(F.when(F.col("doc_id") < 1000, F.col("kept").cast("int")))).first() for s in (1, 2)]
    assert all(abs(x - 0.3) < 0.001 and abs(y - 0.3) < 0.05 for x, y in shares)


def test_importance_prefers_target(spark):
    good, bad = [" ".join(WORDS[:10]) + f" {i}" for i in range(30)], [" ".join(WORDS[10:]) + f" {i}" for i in range(30)]
    df = texts(spark, [*good, *bad, None, ""])
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)], "doc_id long, quality int")
    out = importance.resample(df, labels, share=0.4).collect()
    kept = {r.doc_id for r in out if r.kept}
    assert len(out) == 62 and len(kept) == 25 and len(kept & set(range(30))) >= 23
    assert importance.resample(df.limit(0), labels).count() == 0


def test_query_digests(spark, sf_dir, path):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op4_audio_features(spark, sf_dir).collect():
        b = docs[r.doc_id].encode()
        padded = b + bytes(64 if not b else -len(b) % 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def test_token_queries_by_the_library(spark, sf_dir, path):
    """Digests of ids, text and pieces of all documents, recomputed with the tokenizers library."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    ids = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op1_bpe_round_trip(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(ids) and len(got) == len(ids)
    for r in got:
        want = ids[r.doc_id]
        digest = hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), digest, hashlib.sha256(t.decode(want, skip_special_tokens=False).encode()).hexdigest())
    seen, places = defaultdict(int), defaultdict(list)
    for r in queries.op7_packing(spark, sf_dir).collect():
        whole = [*ids[r.doc_id], 2]
        assert r.doc_tokens == len(whole) and r.ids_crc32 == zlib.crc32(np.array(whole[r.start : r.start + r.length], "<u4").tobytes())
        seen[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert seen == {k: len(v) + 1 for k, v in ids.items()}
    for parts in places.values():
        ends = np.cumsum([0] + [n for _, n in sorted(parts)])
        assert [at for at, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= 4096


def test_join_query_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    want = brute_components([r.text for r in docs])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op5_ngram_jaccard_join(spark, sf_dir).collect()}
    assert got == {r.doc_id: (n, docs[at].doc_id) for r, (n, at) in zip(docs, want, strict=True)}


def test_machine_by_brute_force():
    """The logit is the sum over all pairs of terms; training follows the numeric gradient of the loss."""
    rng = np.random.default_rng(14)
    w, v = rng.normal(0, 1, 9), rng.normal(0, 1, (9, 4))
    x = [0, 2, 5, 8]
    pairs = sum(float(v[i] @ v[j]) for n, i in enumerate(x) for j in x[:n])
    assert toxicity.Machine(np.arange(9), 0.3, w, v).logit(x) == pytest.approx(0.3 + w[x].sum() + pairs) and toxicity.Machine(np.arange(9), 0.3, w, v).logit([]) == 0.3
    rows, y = [[0, 1], [0], [1], [2]] * 50, np.array([1.0, 0, 0, 0] * 50)
    loss = lambda m: float(np.mean([np.logaddexp(0, m.logit(r)) - t * m.logit(r) for r, t in zip(rows, y, strict=True)]))
    losses = [loss(toxicity.Machine(np.arange(3), *toxicity.train_machine(rows, y, 3, epochs=n))) for n in (0, 1, 5, 40)]
    assert all(a > b for a, b in zip(losses, losses[1:], strict=False)) and losses[-1] < 0.2


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, one id on two texts, and columns named like helpers."""
    words = [" ".join(WORDS[(i * j + j) % len(WORDS)] + str(j % 7) for j in range(60 + i)) + "." for i in range(6)]
    rows = [(i, words[i % 6], "en", "s", 1) for i in range(12)]
    rows += [(12, None, None, None, None), (None, words[0], "en", "s", 1), (None, None, None, None, None), (13, "", "en", None, 0), (14, " \n\t ", "en", "s", 4), (15, "one", "en", "s", 3)]
    rows += [rows[0]] * 3 + [(1, words[3], "en", "s", 1), (16, "long words stand here. " * 20_000, "en", "s", 0)]
    clash = ("__toxicity", "__h", "__nid", "__row", "__text", "__key", "score", "kept", "quality", "n_words", "n_lines", "component_id", "ids", "start", "__K")
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({x: F.lit(f"own {x}") for x in clash})


def test_stages_on_odd_documents(spark, sf_dir, path):
    docs = odd_documents(spark)
    before = docs.collect()
    known = {r.doc_id for r in before}
    for stage in (stages.quality, stages.toxic, stages.dedup_lines, stages.dedup_documents):
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, stage
        rows = out.collect()
        assert {r.doc_id for r in rows} <= known
        assert all(r[x] == f"own {x}" for r in rows for x in docs.columns[5:]), stage
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        if stage is stages.quality:
            assert not [r for r in rows if not r.text or not r.text.strip()]
        if stage is stages.toxic or stage is stages.dedup_lines:
            assert len(rows) == len(before)
        if stage is stages.dedup_documents:
            assert {(r.doc_id, r.text) for r in rows if r.doc_id in (12, 13, 14, 15, 16)} == {(r.doc_id, r.text) for r in before if r.doc_id in (12, 13, 14, 15, 16)}
            assert sum(r.doc_id is None for r in rows) == 2 and len({r.text for r in rows if r.doc_id is not None and r.doc_id < 12}) == 6
    pieces = stages.pack(spark, docs, sf_dir).collect()
    whole = {}
    for r in pieces:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
    assert whole[12] == whole[13] == 1 and set(whole) == known
    assert stages.pack(spark, docs.limit(0), sf_dir).count() == 0


def test_toxicity_trains_on_one_text_an_id(spark):
    df = texts(spark, ["you moron", "fine words"] * 10)
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(20)], "doc_id long, toxic int")
    model, repeated = toxicity.fit(df, labels, min_docs=1), toxicity.fit(df.unionByName(df).unionByName(df.where("doc_id = 0")), labels, min_docs=1)
    assert np.array_equal(model.buckets, repeated.buckets) and np.array_equal(model.w, repeated.w) and model.w0 == repeated.w0


def test_pipeline_keeps_its_promises(spark, sf_dir, path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(corpus_pipeline.STAGES) - 1:
            from tessella.llm.base import written

            docs = written(docs, name)
            assert docs.columns == columns
            now = [r.doc_id for r in docs.select("doc_id").collect()]
            assert set(now) <= ids and len(now) == len(set(now))
            ids = set(now)
    assert {r.doc_id for r in docs.collect()} == ids
