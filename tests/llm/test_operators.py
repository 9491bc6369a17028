"""The operators against brute force, on small fixtures with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from streamcontract.llm import exact_topk, hmm, media, mixing, near_dedup, pieces, quality, sharding, token_counts, toxicity
from streamcontract.llm.common import Words, mix, remainder, utf8

BPE = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, word string"


def made(spark, rows):
    """Documents with clashing extra columns; rows are (id, text) or (id, text, lang, source)."""
    return spark.createDataFrame([(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), 0, 0.5, "x") for r in rows], DOCS)


def sentence(rng, n, letters="abcdefg"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(n))


def odd_texts():
    rng = random.Random(1)
    return [None, "", "   \n\t", "a", "Hello, World! it's 12345\n\n  x", "é€𝄞 ünï", "a" * 3000, "don't  stop\t\t\n", "<|endoftext|> mid <|endoftext|>", "日本語のテキスト", " \x0b\x0c\x1c\x85\xa0x", sentence(rng, 2000), "Same text here", "Same text here", " " * 500, "'s 're 've", "x" * 40 + "\n" * 40]


def words(text):
    return bytes(text or "", "utf8").translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()


# ---------------------------------------------------------------- common


def test_words_are_the_ascii_words():
    import pyarrow as pa

    texts = [*odd_texts(), None, "B c"]
    data, at = utf8(pa.array(texts, pa.string()))
    w = Words(data, at, 0, len(texts))
    want = [(d, x) for d, t in enumerate(texts) for x in words(t)]
    low = bytes(data).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    assert [(d, low[s:e]) for d, s, e in zip(w.doc, w.start, w.end, strict=True)] == want
    by = {}
    for (_, x), h in zip(want, w.hash, strict=True):
        assert by.setdefault(x, h) == h
    assert len(set(by.values())) == len(by)


# ---------------------------------------------------------------- 1


def test_splicing_equals_the_library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    rng = random.Random(2)
    bits = ["hello ", "'s", "  ", "\n\n", "<|endoftext|>", "don't", "𝄞", "é", "1234", "!!", "x" * 90, " " * 80, "日本"]
    total = 0
    for seed in range(60):
        rng.seed(seed)
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 300)))
        for chunk, overlap in ((130, 70), (200, 100), (1000, 90)):
            c = token_counts.Counter(BPE, chunk, overlap)
            assert c.encode(text) == tok.encode(text, add_special_tokens=False).ids
            total += c.resynced
    assert total > 100
    c = token_counts.Counter(BPE, 100, 70)
    assert c.encode("a" * 1000) == tok.encode("a" * 1000, add_special_tokens=False).ids
    assert c.widened


def test_token_counts(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    texts = odd_texts()
    got = {r.doc_id: r for r in token_counts.token_counts(made(spark, list(enumerate(texts))), BPE, chunk=1000, overlap=100).collect()}
    for i, t in enumerate(texts):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512), repr(t)
    assert token_counts.token_counts(made(spark, []), BPE).count() == 0


# ---------------------------------------------------------------- 2


def brute_topk(rows, is_query, k):
    top = 2**63 - 1
    fit = lambda x: max(-top - 1, min(top, math.floor(1024 * x) if math.isfinite(1024 * x) else math.copysign(2.0**70, x)))
    v = [(i, [int(fit(a)) for a in x]) for i, x in rows if i is not None and x is not None and all(a is not None and math.isfinite(a) for a in x)]
    out, by = [], {}
    for q, x in v:
        if is_query(q):
            by.setdefault(q, []).extend((-max(-top, min(top, sum(a * b for a, b in zip(x, y, strict=True)))), i) for i, y in v if i != q and len(y) == len(x))
    for q, scores in by.items():
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("bins", [4, 1024])
def test_topk(spark, bins):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(a)) for a in rng.normal(0, 0.1, 6)]) for i in range(60)]
    rows += [(100 + i, rows[5][1]) for i in range(40)]  # ties
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, rows[0][1]), (0, rows[1][1]), (204, [0.5, 0.5]), (210, [0.25, 0.5]), (10, rows[10][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = exact_topk.exact_topk(df, F.col("vec_id") % 10 == 0, k=5, bins=bins, block=7 if bins == 4 else 2048)
    assert sorted(tuple(r) for r in got.collect()) == brute_topk(rows, lambda i: i % 10 == 0, 5)
    assert exact_topk.exact_topk(df.where("vec_id < 0"), F.col("vec_id") % 10 == 0).count() == 0


def test_topk_of_large_components(spark):
    """Finite components of any size take part; a score beyond 64 bits is the nearest long."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(a) for a in rng.normal(0, 10.0 ** (i % 9), 3)]) for i in range(80)]
    rows += [(100, [1e300, -1e300, 1.0]), (101, [3e6, 3e6, 3e6]), (110, [1.7e308, 1.0, 0.0]), (111, [-1e15, 2e15, 5.0]), (120, [0.0, 0.0, 1e-300]), (121, [9e15, 9e15, -9e15])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = exact_topk.exact_topk(df, F.col("vec_id") % 10 == 0, k=7)
    assert sorted(tuple(r) for r in got.collect()) == brute_topk(rows, lambda i: i % 10 == 0, 7)


# ---------------------------------------------------------------- 3


def labelled(spark, n=300):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        w = sentence(rng, rng.randint(5, 40)).split()
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["idiotq", "scumq", "vequabc", "vequxyz"]))
        rows.append((i, " ".join(w), "en" if i % 2 else None, "s"))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "idiotq"), (1003, "..."), (None, "abc")]
    return made(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = toxicity.learn(docs, labels, may_learn=remainder(F.col("doc_id"), 3) != 1)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((got[i].score >= toxicity.CUT) == (i % 3 == 0) for i in held)
    assert right / len(held) > 0.9
    assert len(got) == 305
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[1000].score == got[1001].score == got[1003].score
    assert got[1002].score > got[1001].score
    assert toxicity.learn(docs, labels.where("toxic = 0")) is None
    assert {r.score for r in toxicity.toxicity(docs, None).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), model).count() == 0


def test_long_texts_are_in_the_sample(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, sentence(rng, 2100, "ab") + " idiotq" * (i % 3 == 0), "en", "s") for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int")
    fit, seen = toxicity.fit, []
    monkeypatch.setattr(toxicity, "fit", lambda docs, y: seen.extend(map(len, docs)) or fit(docs, y))
    model = toxicity.learn(made(spark, rows), labels, per_class=60)
    assert model is not None
    assert len(seen) == 120
    assert min(seen) >= 2100
    assert set(model.thresholds) == {"en"}  # of 120 texts 24 are set aside; all labelled ones that were not trained on count


def test_pooling_is_the_convolution():
    rng = np.random.default_rng(0)
    m = toxicity.train([rng.integers(0, 1000, (9, 4)).astype(np.int32)] * 4, np.array([0, 1, 0, 1]), epochs=1)
    docs = [rng.integers(0, 1000, (n, 4)).astype(np.int32) for n in (1, 2, 7, 0)]
    flat = np.concatenate(docs)
    top, _ = toxicity.pooled(m, flat, np.arange(len(flat)), np.array([len(d) for d in docs]))
    for i, d in enumerate(docs):
        e = np.vstack([m.table[d].sum(1), np.zeros((3, toxicity.DIM))]) if len(d) else None
        for k, w in enumerate(toxicity.WIDTHS):
            want = np.max([sum(e[t + j] @ m.filters[w][j] for j in range(w)) for t in range(len(d))], axis=0) if len(d) else 0
            np.testing.assert_allclose(top[i, k * toxicity.FILTERS : (k + 1) * toxicity.FILTERS], want, atol=1e-5)


# ---------------------------------------------------------------- 4


def test_sharding(spark, tmp_path):
    docs = made(spark, [(i, "x" * (i % 50) if i % 7 else None) for i in range(500)] + [(3, "again"), (None, None)]).repartition(6)
    s = sharding.shard(docs, str(tmp_path / "a"), arrivals=6, target=20_000)
    key = lambda df: sorted(((r.doc_id, r.text, r.word) for r in df.collect()), key=str)
    assert key(s.read()) == key(docs)
    m = s.manifest().collect()
    assert sum(r["rows"] for r in m) == 502
    assert s.versions() == [2]
    # a new arrival is a new version; the old one stays readable until vacuum
    s.append(made(spark, [(9000, "new")]))
    assert s.versions()[-1] == 3
    assert s.read(3).count() == 503
    assert s.read(2).count() == 502
    for i in range(4):
        s.append(made(spark, [(9001 + i, "new")]))
    before = len({r["run"] for r in s.manifest().collect()})
    s.compact()
    assert len({r["run"] for r in s.manifest().collect()}) < before
    assert s.vacuum() == []  # nothing is old enough
    s.vacuum(grace=0)
    assert s.read().count() == 507
    with pytest.raises(sharding.ConflictError):
        s.commit(s.manifest(), s.versions()[-1] - 1)
    empty = sharding.shard(made(spark, []), str(tmp_path / "b"))
    assert empty.manifest().count() == 0


def test_sharding_keeps_all_columns(spark, tmp_path):
    """Columns named like the store's own."""
    df = spark.createDataFrame([(1, "a", 5, "f", "g", "m"), (None, None, None, None, None, None)], "doc_id long, text string, __arrival int, __file string, file string, _metadata string")
    s = sharding.shard(df, str(tmp_path / "a"), arrivals=2)
    assert sorted(map(tuple, s.read(file_column="x").drop("x").select(df.columns).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id for r in sharding.op4_sharding(spark, str(tmp_path)).collect()} == {1, None}


def test_sharding_writers(spark, tmp_path, monkeypatch):
    """Of two writers one fails; one that dies at any step leaves the version before, and the next one goes on."""
    path = str(tmp_path / "a")
    one, two = sharding.Store(spark, path), sharding.Store(spark, path)
    one.append(made(spark, [(1, "a")]))
    late = two.manifest()
    one.append(made(spark, [(2, "b")]))
    with pytest.raises(sharding.ConflictError):
        two.commit(late, 1)

    class Died(Exception):
        pass

    def die(*_):
        raise Died

    for step in (lambda m: m.setattr(sharding.Store, "commit", die), lambda m: m.setattr(sharding.Versions, "write", die), lambda m: m.setattr(sharding.Versions, "publish", lambda self, n, line: (self.write(line), die()))):
        with monkeypatch.context() as m:
            step(m)
            with pytest.raises(Died):
                two.append(made(spark, [(3, "c")]))
        assert one.versions() == [1, 2] and one.read().count() == 2
    two.append(made(spark, [(4, "d")]))
    assert sorted(r.doc_id for r in one.read().collect()) == [1, 2, 4]
    assert one.vacuum() == []  # what is not old may still be committed
    assert len(one.vacuum(grace=0)) == 3
    assert one.read().count() == 3
    with pytest.raises(Exception, match="(?i)denied|directory|exist|mkdirs") as other:  # no conflict, another error
        (tmp_path / "b").write_text("a file")
        sharding.Versions(spark, str(tmp_path / "b")).publish(1, "x")
    assert not isinstance(other.value, sharding.ConflictError)


def test_tiers_by_brute_force(spark, tmp_path):
    """Runs and tiers after each append and compaction equal a simulation; merged files have about the target's size."""
    rng = np.random.default_rng(5)
    s = sharding.Store(spark, str(tmp_path / "a"), target=100_000, fan_in=3)
    for i in range(8):
        text = lambda: rng.bytes(600).hex()
        s.append(made(spark, [(i * 1000 + k, text()) for k in range(int(rng.integers(20, 160)))]).repartition(3))
        runs = {}
        for r in s.manifest().collect():
            runs.setdefault((r.run, r.tier), []).append(r.bytes)
        for (_, tier), sizes in runs.items():
            assert tier == max(0, math.floor(math.log(sum(sizes) / sharding.SMALLEST, 3)))
        loose = Counter(t for (_, t), sizes in runs.items() if np.mean(sizes) < 50_000)
        before = {name for name, _ in runs}
        s.compact()
        after = {r.run for r in s.manifest().collect()}
        for (name, tier), sizes in runs.items():
            assert (name in after) == (loose[tier] < 3 or np.mean(sizes) >= 50_000)
        assert (after != before) == any(n >= 3 for n in loose.values())
        again = Counter(t for (_, t), sizes in _runs(s).items() if np.mean(sizes) < 50_000)
        assert all(n < 3 for n in again.values())
    merged = [sizes for (name, _), sizes in _runs(s).items() if "/" not in name and sum(sizes) > 200_000]
    assert merged
    for sizes in merged:
        assert max(sizes) < 1.4 * 100_000 and np.median(sizes) > 0.5 * 100_000
    ids = [r.doc_id for r in s.read().collect()]
    assert len(ids) == len(set(ids)) == sum(r["rows"] for r in s.manifest().collect())


def _runs(store):
    out = {}
    for r in store.manifest().collect():
        out.setdefault((r.run, r.tier), []).append(r.bytes)
    return out


# ---------------------------------------------------------------- 5


def corpus():
    rng = random.Random(9)
    texts = [sentence(rng, rng.randint(0, 60), "ab" if i % 2 else "xyz") for i in range(80)] + [None, "", "A b a B", "\x0b\x1cq é É", "a b a b"]
    return list(enumerate(texts))


def plain_likelihood(h, flat):
    """Forward recursion in logarithms, one symbol after the other."""
    total, v = 0.0, h.start
    for i, x in enumerate(flat):
        v = (v if i == 0 else h.move.T @ v) * h.emit[x]
        total += math.log(v.sum())
        v = v / v.sum()
    return total


@pytest.mark.parametrize("small", [False, True])
def test_hmm(spark, monkeypatch, small):
    """All columns against one loop over the texts, with the words' counts gathered plainly; small: sliced texts, many segments, few frequent words."""
    if small:
        monkeypatch.setattr(hmm, "SLICE", 200)
        monkeypatch.setattr(hmm, "ROW_BYTES", 1000)
    options = {"frequent": 20, "segment": 16} if small else {}
    models = []
    train = hmm.train
    monkeypatch.setattr(hmm, "train", lambda rows, letters, **x: models.append((letters, train(rows, letters, **x))) or models[-1][1])
    rows = [*corpus(), (10, corpus()[3][1]), (10, corpus()[3][1]), (None, "a b"), (11, None)]
    got = hmm.language_model(made(spark, rows), rounds=2, **options).collect()
    letters, h = models[0]
    assert h.emit.sum(0) == pytest.approx(np.ones(hmm.STATES))
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update([*words(t), b"\n"])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        tokens = [*words(t), b"\n"]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        score = 0.0
        flat = []
        for w in words(t):
            import pyarrow as pa

            x = Words(*utf8(pa.array([w.decode()])), 0, 1)
            s = int(letters.of(x.hash, hmm._class(x))[0])
            flat.append(s)
            if s >= letters.rest:
                u, c = letters.unseen[s - letters.rest], letters.count[s]
                score += math.log10((1 - u) * counts[w] / c if counts[w] else u)
            else:
                assert counts[w] == letters.count[s]
        score += plain_likelihood(h, [*flat, hmm.END]) / math.log(10)
        want.append((i, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 5), round(score, 5)))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got), key=key) == [pytest.approx(x) for x in sorted(want, key=key)]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_hmm_empty(spark):
    assert hmm.language_model(made(spark, [])).count() == 0
    none = hmm.language_model(made(spark, [(None, "a b")])).collect()  # no training rows
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in none] == [(3, 0, 0)]


def small_hmm(k=3, symbols=5):
    rng = np.random.default_rng(4)
    return hmm.Hmm(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(symbols), k).T)


def brute_paths(h, seq):
    from itertools import product

    for path in product(range(len(h.start)), repeat=len(seq)):
        p = h.start[path[0]] * h.emit[seq[0], path[0]]
        for a, b, s in zip(path[:-1], path[1:], seq[1:], strict=True):
            p *= h.move[a, b] * h.emit[s, b]
        yield path, p


SEQUENCES = [[0], [2, 3, 4, 0], [4, 4], [3, 2, 2, 4, 3], [1, 2, 3, 4, 1, 2, 0]]


@pytest.mark.parametrize("segment", [1, 2, 3, 100])
def test_forward_is_exact(segment):
    h = small_hmm()
    h.segment = segment
    got = hmm.log_likelihood(h, np.concatenate(SEQUENCES), np.array([len(s) for s in SEQUENCES]))
    for s, g in zip(SEQUENCES, got, strict=True):
        assert math.exp(g) == pytest.approx(sum(p for _, p in brute_paths(h, s)), rel=1e-6)
        op, log = hmm.whole_operator(h, np.array(s))
        assert math.log((op @ h.start).sum()) + log == pytest.approx(g)


@pytest.mark.parametrize("segment", [1, 2, 3, 100])
def test_baum_welch_counts(segment):
    """Counts of whole texts, whatever the segments."""
    h = small_hmm()
    m = len(SEQUENCES)
    cut = hmm.Cut.of(np.concatenate(SEQUENCES), np.array([len(s) for s in SEQUENCES]), segment)
    yes = np.ones(m, bool)
    start, moved, seen = hmm.expected_counts(h, cut, np.tile(h.start, (m, 1)), np.ones((m, 3)), yes, yes)
    a, b, c = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s in SEQUENCES:
        total = sum(p for _, p in brute_paths(h, s))
        for path, p in brute_paths(h, s):
            a[path[0]] += p / total
            for x, y in zip(path[:-1], path[1:], strict=True):
                b[x, y] += p / total
            for x, y in zip(s, path, strict=True):
                c[x, y] += p / total
    for x, y in ((start, a), (moved, b), (seen, c)):
        np.testing.assert_allclose(x, y, atol=1e-4)


def test_slices_cut_at_white_space():
    import pyarrow as pa

    from streamcontract.llm.common import slices

    texts = ["a bb ccc dddd", "", None, "x" * 50, "y " * 30]
    data, at = utf8(pa.array(texts))
    cuts, doc = slices(data, at, 5)
    parts = [bytes(data[a:b]).decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    assert ["".join(p for p, d in zip(parts, doc, strict=True) if d == i) for i in range(5)] == [t or "" for t in texts]
    assert [w for p in parts for w in p.split()] == [w for t in texts for w in (t or "").split()]


# ---------------------------------------------------------------- 6


def symbols_of(text):
    out, before = [], None
    data = (text or "").encode()
    out += words(text)
    marks = [int(quality.CLASS[b]) for b in data]
    at = 0
    low = data.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    for w in out:
        at = low.index(w, at)
        if w == before:
            marks[at] = quality.REPEAT
        before, at = w, at + len(w)
    return [*marks, quality.END]


def brute_kneser_ney(texts):
    counts = Counter()
    for t in texts:
        s = [0, 0, 0, *symbols_of(t)]
        counts.update(tuple(s[i - 3 : i + 1]) for i in range(3, len(s)))
    by = {4: counts}
    for k in (3, 2, 1):
        by[k] = Counter(g[1:] for g in by[k + 1])
    model = {}
    for k in (1, 2, 3, 4):
        n1, n2, n3, n4 = (sum(v == i for v in by[k].values()) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d = [min(max(x, 0.05), i - 0.05) for i, x in ((1, 1 - 2 * y * n2 / max(n1, 1)), (2, 2 - 3 * y * n3 / max(n2, 1)), (3, 3 - 4 * y * n4 / max(n3, 1)))]
        total, kept = Counter(), Counter()
        for g, n in by[k].items():
            total[g[:-1]] += n
            kept[g[:-1]] += d[min(n, 3) - 1]
        model[k] = (by[k], d, total, kept)

    def p(g):
        if not g:
            return 1 / 64
        c, d, total, kept = model[len(g)]
        h = g[:-1]
        if not total[h]:
            return p(g[1:])
        n = c[g]
        return (max(0, n - d[min(n, 3) - 1]) if n else 0) / total[h] + kept[h] / total[h] * p(g[1:])

    return p


def test_kneser_ney(spark):
    rng = random.Random(3)
    texts = [sentence(rng, 30) for _ in range(12)] + ["Go go go. STOP!", None, ""]
    model = quality.kneser_ney(quality.ngram_counts(made(spark, list(enumerate(texts)))))
    p = brute_kneser_ney(texts)
    tests = [*texts[:3], "zz ZZ $$$ a a a", "", None, "unseen é ü", "Go go go. STOP!"]
    got = {r.doc_id: r for r in quality.perplexities(made(spark, list(enumerate(tests))), model).collect()}
    for i, t in enumerate(tests):
        s = [0, 0, 0, *symbols_of(t)]
        logs = [math.log10(p(tuple(s[j - 3 : j + 1]))) for j in range(3, len(s))]
        assert got[i].n_symbols == len(logs)
        assert got[i].perplexity == pytest.approx(10 ** -(sum(logs) / len(logs)), rel=1e-4), t
    dense = 10 ** model.dense().reshape(-1, 64).astype(np.float64)
    np.testing.assert_allclose(dense.sum(1), 1, rtol=1e-4)


def test_quality(spark):
    rng = random.Random(3)
    rows = [(i, sentence(rng, 40), "en" if i % 2 else None, "s") for i in range(200)] + [(500, "@@@ ### !!!" * 20, "en", "s"), (501, "Abc " * 60, "en", "s"), (502, None, "en", "s"), (503, " ", "en", "s"), (504, "AAAA BBBB " * 9, "xx", "s")]
    labels = spark.createDataFrame([(i, 1) for i in range(150)] + [(500, 0), (3, 0)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality.quality(made(spark, rows), labels, quantile=0.99, least=15).collect()}
    assert sum(got[i] for i in range(200)) >= 190
    assert not any(got[i] for i in (500, 501, 502, 503, 504))
    none = quality.quality(made(spark, rows), labels.where("quality = 2")).collect()
    assert {r.doc_id for r in none if not r.kept} == {502, 503}
    assert quality.quality(made(spark, []), labels).count() == 0


def test_keep_and_stored_give_the_drivers_memory_back(spark, monkeypatch):
    from types import SimpleNamespace as Some

    from streamcontract.llm import common

    heap, collected = [90], []
    runtime = Some(totalMemory=lambda: heap[0], maxMemory=lambda: 100)
    jvm = Some(java=Some(lang=Some(Runtime=Some(getRuntime=lambda: runtime), System=Some(gc=lambda: collected.append(1)))))
    session = Some(sparkContext=Some(_jvm=jvm))
    monkeypatch.setattr(common, "_tidied", [-100.0])
    common.tidy(session)
    common.tidy(session)  # too soon
    assert len(collected) == 1
    common._tidied[0], heap[0] = -100.0, 10  # little is committed
    common.tidy(session)
    assert len(collected) == 1
    turns = []
    monkeypatch.setattr(common, "tidy", turns.append)
    assert common.keep(spark.range(3)).count() == common.stored(spark.range(3)).count() == 3
    assert len(turns) == 2


def test_tidy_lets_the_drivers_heap_shrink(spark, monkeypatch):
    from streamcontract.llm import common

    jvm = spark.sparkContext._jvm
    kind = jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean")
    options = jvm.java.lang.management.ManagementFactory.getPlatformMXBean(kind)
    monkeypatch.setattr(common, "COMMITTED", 0.0)
    monkeypatch.setattr(common, "_tidied", [-100.0])
    common.tidy(spark)
    assert {name: int(options.getVMOption(name).getValue()) for name in ("MinHeapFreeRatio", "MaxHeapFreeRatio")} == {"MinHeapFreeRatio": 20, "MaxHeapFreeRatio": 40}


def test_tidy_executors(spark, monkeypatch):
    from types import SimpleNamespace as Some

    from streamcontract.llm import common

    ran = []

    def session(executors):
        status = Some(size=lambda: executors + 1)
        frame = Some(select=lambda *columns: Some(collect=lambda: ran.append("gc" in str(columns))))
        return Some(sparkContext=Some(_jsc=Some(sc=lambda: Some(getExecutorMemoryStatus=lambda: status))), range=lambda lo, hi, step, parts: ran.append((hi, parts)) or frame)

    monkeypatch.setattr(common, "_rested", [-100.0])
    common.tidy_executors(session(3))
    common.tidy_executors(session(3))  # too soon
    assert ran == [(3, 3), True]
    common._rested[0] = -100.0
    common.tidy_executors(session(0))  # the driver does all
    assert len(ran) == 2
    assert spark.range(0, 2, 1, 2).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).count() == 2
    turns = []
    monkeypatch.setattr(common, "tidy_executors", turns.append)
    assert common.keep(spark.range(3)).count() == common.stored(spark.range(3)).count() == 3
    assert len(turns) == 2


def test_workers_drop_a_models_tables_with_its_broadcast(spark):
    """Tables that workers made of the models of quality and pieces are gone in tasks that do not use them."""
    docs = made(spark, [(i, "plain words of a text") for i in range(40)]).repartition(4)
    model = quality.kneser_ney(quality.ngram_counts(docs))

    def held(batches):
        from streamcontract.llm import common, pieces, quality

        for b in batches:
            n = len(getattr(quality, "_dense", ())) + len(getattr(pieces, "_loaded", ())) + len(getattr(common, "_made", ()))
            yield pa.record_batch([pa.array([n] * b.num_rows, pa.int64())], ["n"])

    for out in (quality.perplexities(docs, model), pieces.pieces(docs, pieces.public_model())):
        assert out.count() == 40
        assert out.collect()
        spark.range(0, 16, 1, 16).mapInArrow(held, "n long").collect()  # the workers learn what is no longer used
        assert spark.range(0, 16, 1, 16).mapInArrow(held, "n long").agg({"n": "max"}).first()[0] == 0


def test_dense_table_has_nothing_of_its_size_beside_it():
    import tracemalloc

    model = quality.Model(np.array([5]), np.array([-1.0], np.float32), np.arange(64**3, dtype=np.float32), np.arange(64**3, dtype=np.float32) / 7)
    tracemalloc.start()
    try:
        out = model.dense()
        assert tracemalloc.get_traced_memory()[1] < 1.5 * out.nbytes
    finally:
        tracemalloc.stop()
    g = np.array([0, 5, 64, 64**3 + 70, 64**4 - 1])
    want = np.where(g == 5, -1.0, model.backoff[g // 64] + model.lower[g % 64**3])
    np.testing.assert_allclose(out[g], want, rtol=1e-6)


def test_small_tables_need_no_python_worker(spark, monkeypatch):
    """A list given to createDataFrame passes through workers of their own, which stay; an Arrow table does not."""
    given, create = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: given.append(type(data)) or create(self, data, *a, **b))
    docs, labels = spark.range(60).selectExpr("id doc_id", "IF(id % 2 = 0, 'a bad word', 'fine words') text", "'en' lang", "'s' source"), spark.range(60).selectExpr("id doc_id", "CAST(id % 2 = 0 AS INT) toxic")
    assert toxicity.learn(docs, labels) is not None
    assert mixing.mix(docs).count() == 60
    assert given and set(given) <= {pa.Table}, given


def test_quality_model_reads_the_texts_once(spark):
    read = spark.sparkContext.accumulator(0)

    def through(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rng = random.Random(4)
    docs = made(spark, [(i, sentence(rng, 12)) for i in range(40)])
    assert quality.kneser_ney(quality.ngram_counts(docs.mapInArrow(through, docs.schema))) is not None
    assert read.value == 40


def test_kneser_ney_stores_bounded_tables_in_few_files(spark, monkeypatch):
    parts, keep = [], quality.keep
    monkeypatch.setattr(quality, "keep", lambda df: parts.append((out := keep(df)).rdd.getNumPartitions()) or out)
    monkeypatch.setattr(quality, "FEW", 2, raising=False)
    rng = random.Random(5)
    assert quality.kneser_ney(quality.ngram_counts(made(spark, [(i, sentence(rng, 20)) for i in range(30)])).repartition(4, "g")) is not None
    assert len(parts) == 7 and parts[0] == 4 and max(parts[1:]) <= 2, parts


def test_quality_learns_from_all_trusted_rows(spark, monkeypatch):
    n, counts, seen = 25_000, quality.ngram_counts, []
    docs = spark.range(n + 500).selectExpr("id doc_id", "concat('plain words ', id % 97) text", "'en' lang")
    docs = docs.unionByName(docs.where("doc_id < 40"))  # repeated rows
    labels = spark.range(n).selectExpr("id doc_id", "1 quality")
    monkeypatch.setattr(quality, "ngram_counts", lambda texts: seen.append(texts.count()) or counts(texts))
    assert quality.quality(docs, labels).count() == n + 540
    of_ids = "pmod(xxhash64(doc_id, 7), 5) <> 0 AND doc_id < 25000"
    assert seen == [docs.where(of_ids).count()] and seen[0] > 19_000
    ids = spark.createDataFrame([(1,), (None,), (-5,)], "doc_id long")
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (-5, "e")], "doc_id long, text string")
    assert sorted(quality.with_ids(rows, ids).collect()) == [(-5, "e"), (1, "a"), (1, "b")]


def test_ngram_counts_of_large_partitions(spark):
    text = "ab " * 1_500_000  # its last run fills the buffer
    got = quality.ngram_counts(made(spark, [(0, text)]).coalesce(1)).agg({"n": "sum"}).first()[0]
    assert got == len(text) + 1


def test_quality_thresholds_of_small_languages(spark):
    """A language that is rare in the sample has its own threshold if it has `least` trusted texts in all."""
    rng = random.Random(4)
    rows = [(i, sentence(rng, 40), "en", "s") for i in range(1500)] + [(2000 + i, sentence(rng, 40, "xyzw!QZ"), "xx", "s") for i in range(80)] + [(None, sentence(rng, 40), "en", "s"), (None, "@@@ ### !!!" * 20, "en", "s")]
    labels = spark.createDataFrame([(r[0], 1) for r in rows if r[0] is not None], "doc_id long, quality int")
    got = quality.quality(made(spark, rows), labels, sample=200, least=50).collect()
    assert len(got) == len(rows)
    assert len({r.threshold for r in got}) == 2
    assert sum(r.kept for r in got if r.lang == "xx") >= 78
    kept = quality.filter_quality(made(spark, rows), labels, sample=200, least=50)
    assert kept.columns == made(spark, rows).columns
    assert [r.text for r in kept.where("doc_id IS NULL").collect()] == [rows[-2][1]]


# ---------------------------------------------------------------- 7


def brute_targets(sizes, most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w >= most * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / w for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, sentence(rng, rng.randint(0, 80)), "en", rng.choice(["big"] * 9 + ["a", "b", "ü", "Z", None, ""])) for i in range(600)] + [(700, None, "en", "empty"), (701, "", "en", "empty"), (702, "word", "en", "tiny"), (5, "one two three", "en", "a"), (None, "q w", "en", "a")]
    got = mixing.mix(made(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    want = brute_targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(6, 0.02 * t), s
    again = mixing.mix(made(spark, rows).repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(made(spark, [])).count() == 0


def test_copies_by_brute_force(spark):
    """Each row's copies from the rates, the running miss over sizes and the ranks; a third of the rows is one text, half are empty."""
    rng = random.Random(18)
    rows = [(i, "same words again here", "en", "hot") for i in range(3000)] + [(10_000 + i, "", "en", "hot") for i in range(4000)] + [(20_000 + i, sentence(rng, rng.randint(1, 30)), "en", rng.choice(["hot", "b", "c"])) for i in range(1500)]
    got = mixing.mix(made(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, {}).setdefault(r.size, []).append(r.copies)
    for r in got[:1]:
        assert r.target
    targets = {r.source: r.target for r in got}
    for source, sizes in by.items():
        total = sum(s * len(c) for s, c in sizes.items())
        low, high = -60.0, 60.0
        rate = lambda x, s: min(3.0, math.exp(min(60.0, x * s)))
        for _ in range(200):
            mid = (low + high) / 2
            if sum(s * len(c) * rate(mid, s) for s, c in sizes.items()) < targets[source]:
                low = mid
            else:
                high = mid
        full = targets[source] >= 3 * total * (1 - 1e-12)
        miss = 0.0
        for s in sorted(sizes, reverse=True):
            c = sizes[s]
            if s:
                miss += s * len(c) * (3 if full else rate(low, s))
                k = min(3 * len(c), max(0, math.floor(miss / s + 0.5)))
                miss -= k * s
                assert abs(sum(c) - k) <= 1  # the last digits of the rates
                assert max(c) - min(c) <= 1
            else:
                assert not any(c)
    again = mixing.mix(made(spark, rows).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_rates_are_tilted(spark):
    rows = [(i, "w " * (i % 20 + 1), "en", "a" if i < 100 else "b") for i in range(200)]
    sizes = made(spark, rows).select("source", mixing.word_count(F.col("text")).alias("size")).withColumn("last", F.lit(False))
    h = sizes.groupBy("source", "last", "size").agg(F.count("*").alias("m"))
    src = spark.createDataFrame([("a", False, 1050, 500.0), ("b", False, 1050, 1600.0)], "source string, last boolean, total long, target double")
    for r in mixing.solve_rates(h, src).collect():
        reached = sum(n * 5 * min(3.0, math.exp(r.lam * n / r.scale)) for n in range(1, 21))
        assert reached == pytest.approx(r.target, rel=1e-6)


def test_rates_of_heavy_tails(spark):
    """Few long texts hold most words and the target is near `most` times the size, or near nothing."""
    hist, src = [], []
    for name, long, n, share in [("a", 200_000, 20, 2.5), ("b", 200_000, 20, 2.9), ("c", 100_000, 100, 2.9), ("d", 5_000_000, 3, 2.99), ("e", 200_000, 20, 0.001), ("f", 5_000_000, 3, 1.0)]:
        own = [*((name, False, w, 18) for w in range(1 if name == "d" else 50, 601)), (name, False, long, n)]
        total = sum(w * m for _, _, w, m in own)
        hist += own
        src.append((name, False, total, share * total))
    h = spark.createDataFrame(hist, "source string, last boolean, size long, m long")
    sources = spark.createDataFrame(src, "source string, last boolean, total long, target double")
    got = mixing.solve_rates(h, sources).collect()
    assert len(got) == len(src)
    for r in got:
        reached = sum(w * m * math.exp(min(r.lam * w / r.scale, math.log(3))) for s, _, w, m in hist if s == r.source)
        assert reached == pytest.approx(r.target, rel=1e-6), r.source
    with pytest.raises(RuntimeError):
        mixing.solve_rates(h, sources, rounds=2)


# ---------------------------------------------------------------- 8


def test_media(spark):
    texts = odd_texts()
    got = {r.doc_id: r for r in media.digest(made(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-576:]))
        file = media.write_avi(media.encode_frames(want))
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
    assert got[12].feature == got[13].feature
    clips = media.clips(media.to_media(made(spark, [(1, "x" * 600), (2, None)]))).collect()
    assert sum(c.n_frames for c in clips if c.doc_id == 1) == 2
    assert all(c.start_s < c.end_s for c in clips)
    assert media.digest(made(spark, [])).count() == 0


def test_media_query(spark, tmp_path):
    """The query's exact columns by its contract: the checksum is of the last 32 bytes of the payload."""
    texts = [*odd_texts(), "\x00" * 576, "é" * 288, *("x" * n + "y" for n in (30, 31, 32, 543, 544, 575, 576, 1151))]
    rows = [*enumerate(texts), (None, "no id"), (None, None), (3, "another text of id 3")]
    made(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[len(payload) - 32 :])))
    got = media.op8_media(spark, str(tmp_path)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect()
    assert Counter(map(tuple, got)) == Counter(want)
    with pytest.raises(ValueError):
        media.digest(made(spark, []), tail=0)


def test_general_jpeg_decoder():
    rng = np.random.default_rng(6)
    payload = rng.integers(0, 256, 1152, dtype=np.uint8).tobytes()
    file = media.write_avi(media.encode_frames(payload))
    for f in media.read_avi(file).frames:
        j = media.parse_jpeg(bytes(f))
        fast = media.coefficients(j)
        j.huffman = {k: ([1, 1] + [0] * 14, b"\x08\x00") for k in j.huffman}  # another table with the same first code
        np.testing.assert_array_equal(media.coefficients(j), fast)
    flat = np.zeros((9, 64))
    flat[:, 0] = 8 * 20
    assert (media.luminance(flat, np.ones(64), 3) == 148).all()
    for bad in (b"RIFF", file[:200], b"x" * 50):
        with pytest.raises((ValueError, struct.error)):
            media.read_payload(bad)


def test_shots():
    h = np.zeros((30, 16))
    h[:, 0] = 1
    h[12:, 0], h[12:, 9] = 0, 1
    assert media.shots(h).tolist() == [0, 12]
    assert media.shots(h[:0]).tolist() == []


# ---------------------------------------------------------------- 9


def library(proto):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=pieces.unigram_proto(proto))


def test_the_public_file_as_unigram():
    sp, bpe = library(pieces.public_model()), pieces.public_model()
    assert pieces.unigram_proto(pieces.unigram_proto(bpe)) == pieces.unigram_proto(bpe)
    import sentencepiece

    old = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert [sp.id_to_piece(i) for i in range(32000)] == [old.id_to_piece(i) for i in range(32000)]
    assert sp.is_byte(3) and sp.is_control(1) and sp.is_unknown(0) and sp.unk_id() == 0
    plain = sorted((i for i in range(259, 32000)), key=lambda i: (-old.get_score(i), i))
    assert [sp.get_score(i) for i in plain] == [-round(32 * math.log(1 + r)) / 32 for r in range(1, len(plain) + 1)]


def test_pieces(spark):
    """Every text's ids are the library's; chunk=64: by the scan."""
    sp = library(pieces.public_model())
    texts = [*odd_texts(), "a  b   c " * 50, "\u2581 x \u2581y", "ab" * 4000, "\U0001f9ff\u0378 x" * 90, "x" * 64, "y" * 65]
    for chunk in (64, pieces.CHUNK):
        got = {r.doc_id: r for r in pieces.pieces(made(spark, [*enumerate(texts), (None, texts[-3])]), pieces.public_model(), chunk=chunk).collect()}
        assert got[None].ids == got[len(texts) - 3].ids
        for i, t in enumerate(texts):
            ids = sp.encode(t or "")
            if chunk == pieces.CHUNK:
                assert got[i].ids == ids, repr(t)
            assert sum(map(sp.get_score, got[i].ids)) == sum(map(sp.get_score, ids)), repr(t)
            assert got[i].n_pieces == len(got[i].ids)
            assert got[i].ids_crc32 == zlib.crc32(np.array(got[i].ids, "<i4").tobytes())
            assert sp.decode(got[i].ids) == sp.decode(ids)
            assert got[i].decoded_crc32 == zlib.crc32(sp.decode(ids).encode())
            assert got[i].round_trip == (sp.decode(ids) == (t or ""))
    assert pieces.pieces(made(spark, []), pieces.public_model()).count() == 0


def test_trace_of_a_batch_of_many_chunks():
    """Memory follows RUN_CHARS, not the rows of a batch; each chunk's ids are those of the chunk alone."""
    import tracemalloc

    import pyarrow as pa

    u = pieces.Unigram(pieces.unigram_proto(pieces.public_model()))
    rng = random.Random(31)
    parts = [("".join(rng.choice("abcdefghijklmnop ") for _ in range(pieces.CHUNK))).replace(" ", "▁") for _ in range(64)]
    n = len(parts)
    b = pa.record_batch([pa.array(["t"] * n), pa.array(range(n), pa.int32()), pa.array([len(p) for p in parts], pa.int32()), pa.array(parts), pa.array([0] * n, pa.int32()), pa.array([0] * n, pa.int32())], ["key", "k", "m", "part", "before", "after"])
    list(pieces.trace(u, [b.slice(0, 1)]))
    tracemalloc.start()
    out = list(pieces.trace(u, iter([b])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    got = [r for x in out for r in x.to_pylist()]
    assert [r["k"] for r in got] == list(range(n))
    for i in (0, 7, 8, n - 1):
        assert got[i]["ids"] == u.encode(*pieces.points([parts[i]]))[0].tolist()
    assert list(pieces.trace(u, [b.slice(0, 0)])) == []


def test_pieces_of_a_table(spark):
    """All documents, long ones by the scan: the library's ids."""
    sp = library(pieces.public_model())
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.ids for r in pieces.pieces(made(spark, [tuple(r) for r in rows]), pieces.public_model(), chunk=200).collect()}
    differ = [r for r in rows if got[r.doc_id] != sp.encode(r.text or "")]
    assert len(differ) <= 5
    for r in differ:  # another of several best paths
        assert sum(map(sp.get_score, got[r.doc_id])) == sum(map(sp.get_score, sp.encode(r.text)))
    assert max(len(r.text or "") for r in rows) > 64 * 200  # two levels of products


def unigram_model(vocabulary):
    """A hand-written unigram model file."""

    def field(n, kind, body):
        if kind == 2:
            return bytes([n << 3 | 2]) + varint(len(body)) + body
        return bytes([n << 3 | kind]) + body

    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    def piece(text, score, kind):
        return field(1, 2, field(1, 2, text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, varint(kind)))

    out = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3)
    out += b"".join(piece(t, s, 1) for t, s in vocabulary.items())
    return out + field(2, 2, field(3, 0, varint(1))) + field(3, 2, field(1, 2, b"identity") + field(3, 0, varint(1)))


def some_unigram(rng, letters="abcd"):
    vocabulary = {c: -8.0 - 0.01 * i for i, c in enumerate(letters + "\u2581")}
    while len(vocabulary) < 60:
        t = "".join(rng.choice(letters + "\u2581") for _ in range(rng.randint(2, 7)))
        vocabulary.setdefault(t, -rng.uniform(4, 30))
    return unigram_model(vocabulary)


def scan(u, text, chunk):
    """The scan as one process's loop."""
    n = max(1, len(text) // max(chunk, u.reach))
    at = [len(text) * i // n for i in range(n + 1)]
    ms = [u.transfer(pieces.points([text[a : b + u.reach - 1]])[0], b - a) for a, b in zip(at[:-1], at[1:], strict=True)]
    whole = ms[0]
    for m in ms[1:]:
        whole = pieces.max_plus(whole, m)
    return whole[0, 0]


def test_max_plus_scan_equals_the_library(spark):
    """A model with pieces over spaces and letters alike, and unknown characters without byte pieces."""
    rng = random.Random(10)
    proto = some_unigram(rng)
    u = pieces.Unigram(proto)
    texts = []
    for seed in range(40):
        rng.seed(seed)
        texts.append("".join(rng.choice("abcd " if seed % 4 else "abcdxy ") for _ in range(rng.randint(0, 400))).strip())
    total = lambda ids: sum(map(u.sp.get_score, ids))
    got = {r.doc_id: r.ids for r in pieces.pieces(made(spark, list(enumerate(texts))), proto, chunk=20).collect()}
    ids, sizes, scores = u.encode(*u.codes(texts))
    for i, (t, part) in enumerate(zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True)):
        want = u.sp.encode(t)
        assert part.tolist() == want
        if not set("xy") & set(t):
            assert scores[i] == pytest.approx(total(want), abs=1e-3)
            assert "".join(u.sp.id_to_piece(k) for k in got[i]) == u.sp.normalize(t)
        assert total(got[i]) == pytest.approx(total(want), abs=1e-3), (t, got[i], want)
        for chunk in (u.reach, 16, 37):
            if t:
                assert scan(u, u.sp.normalize(t), chunk) == pytest.approx(scores[i])


def test_many_chunks(spark):
    """Three levels of products; nothing but the scan can part this text."""
    rng = random.Random(3)
    proto = some_unigram(rng, "ab")
    text = "".join(rng.choice("ab") for _ in range(64 * 64 * 7 + 500))
    u = pieces.Unigram(proto)
    r = pieces.pieces(made(spark, [(1, text)]), proto, chunk=7).collect()[0]
    assert sum(u.score[r.ids]) == pytest.approx(u.encode(*u.codes([text]))[2][0])
    assert r.round_trip


def test_max_plus_is_associative():
    rng = np.random.default_rng(1)
    a, b, c = rng.normal(size=(3, 4, 4))
    np.testing.assert_allclose(pieces.max_plus(pieces.max_plus(a, b), c), pieces.max_plus(a, pieces.max_plus(b, c)))


# ---------------------------------------------------------------- 10


def brute_near(rows, width, percent=80):
    sets = []
    for i, t in rows:
        w = words(t)
        s = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets.append((i, s))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            same_id = sets[a][0] is not None and sets[a][0] == sets[b][0] and x and y
            if same_id or (x and y and 100 * len(x & y) >= percent * len(x | y)):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)), key=str)


def near_rows():
    rng = random.Random(12)
    rows = [(i, t) for i, t in enumerate(odd_texts())]
    n = len(rows)
    for g in range(12):
        w = sentence(rng, rng.choice([3, 5, 12, 40, 200])).split()
        for _ in range(rng.choice([1, 2, 5, 14])):
            rows.append((n, " ".join(w)))
            n += 1
            for _ in range(rng.choice([0, 0, 1, 2])):  # a chain of edits
                w[rng.randrange(len(w))] = sentence(rng, 1)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, width):
    rows = near_rows()
    got = near_dedup.near_duplicates(made(spark, rows), width=width).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_near(rows, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_buckets_are_dealt_out(spark, monkeypatch):
    """Parts of three members and no passes: all pairs go through the bound, across parts and batches."""
    monkeypatch.setattr(near_dedup, "PART", 3)
    rows = near_rows()
    got = near_dedup.near_duplicates(made(spark, rows), width=4, passes=0).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_near(rows, 4)


def test_large_groups(spark, monkeypatch):
    """Ten thousand copies, as many empty texts, and a hub with hundreds of near copies, whose edges go to many parts."""
    monkeypatch.setattr(near_dedup, "PART", 16)
    base = [f"w{i}" for i in range(60)]
    near = [(50_000 + i, " ".join([*base[:58], f"x{i}", f"y{i}"])) for i in range(300)]
    rows = [(i, "one text of some words that many rows repeat") for i in range(10_000)] + [(20_000 + i, None if i % 2 else " ") for i in range(10_000)] + [(49_999, " ".join(base)), *near]
    got = {r.doc_id: r for r in near_dedup.near_duplicates(made(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].component_id == 0 for i in range(10_000))
    assert all(got[20_000 + i].kept and got[20_000 + i].n_shingles == 0 for i in range(10_000))
    assert {got[i].component_id for i, _ in near} == {49_999}


def test_near_duplicates_odd_ids(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (5, "p q r s t"), (5, "k l m n o"), (4, "k l m n o"), (None, "a b c d e"), (None, "u v w x y"), (None, None), (7, "")]
    got = near_dedup.near_duplicates(made(spark, rows)).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted(
        [(1, 1, True), (1, 1, True), (2, 1, False), (5, 4, False), (5, 4, False), (4, 4, True), (None, 1, False), (None, None, True), (None, None, True), (7, 7, True)], key=str
    )
    assert near_dedup.near_duplicates(made(spark, [])).count() == 0


def test_densification_is_complete():
    h = mix(np.arange(1, 4, dtype=np.uint64))
    h.sort()
    s = near_dedup.signatures(h, np.array([3]))
    assert set(s[0].tolist()) <= set(h.tolist())
    assert len(near_dedup.bands(s)[0]) == near_dedup.BANDS


def test_plain_split_is_the_published_one():
    import regex

    published = regex.compile(public_tokenizers.PATTERN)
    rng = random.Random(4)
    some = [chr(c) for c in range(0x250) if token_counts._PLAIN.fullmatch(chr(c))]
    assert len(some) > 400
    for seed in range(300):
        rng.seed(seed)
        text = "".join(rng.choice(rng.choice([some, list(" \n\t'sdtrevlm_0aZ")])) for _ in range(200))
        assert token_counts.SPLIT.findall(text) == published.findall(text)
    assert not token_counts._PLAIN.fullmatch("²")
