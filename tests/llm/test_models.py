import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from frameflow.llm import langid, lm, quality, queries


def out_of_training(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds == 0


@pytest.fixture(scope="module")
def sf_larger():
    return "/root/testdata/sf0.01"


# -- language

PIECES = langid.Pieces(["a", "b", "ab", "ba", "▁", "▁a", "bab"])


def all_segmentations(word, p):
    if not word:
        return 1.0
    return sum((p[word[:n]] if word[:n] in p else langid.UNKNOWN if n == 1 else 0.0) * all_segmentations(word[n:], p) for n in range(1, min(len(word), langid.MAX_PIECE) + 1))


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(2)
    table = np.zeros((len(PIECES.texts) + 2, 2))
    table[0] = langid.UNKNOWN
    table[1:-1] = rng.dirichlet(np.ones(len(PIECES.texts)), 2).T
    model = langid.Model(["x", "y"], PIECES, table)
    words = ["▁a", "▁bab", "▁abba", "▁c", "▁acab", "▁" + "ab" * 8]
    got = model.log_probabilities(words)
    for k in range(2):
        p = {t: table[n + 1, k] for n, t in enumerate(PIECES.texts)}
        for w, v in zip(words, got[:, k]):
            assert math.isclose(v, math.log(all_segmentations(w, p)), rel_tol=1e-9)
    assert math.isclose(model.log_probabilities(["▁" + "ab" * 400])[0, 0] * 2, model.log_probabilities(["▁" + "ab" * 800])[0, 0], rel_tol=0.02)


def test_expectation_maximisation_raises_the_likelihood():
    counts = {"x": Counter({"abab": 5, "ba": 3}), "y": Counter({"bbb": 4, "ab": 1})}
    last = None
    for rounds in (1, 2, 4, 8):
        model = langid.fit(PIECES, counts, rounds)
        fit = sum(n * model.log_probabilities(["▁" + w])[0, k] for k, lang in enumerate(model.languages) for w, n in counts[lang].items())
        assert last is None or fit >= last - 0.05
        last = fit


def test_flows_are_shares_of_all_segmentations():
    rng = np.random.default_rng(3)
    table = np.zeros((len(PIECES.texts) + 2, 1))
    table[0] = langid.UNKNOWN
    table[1:-1, 0] = rng.dirichlet(np.ones(len(PIECES.texts)))
    points = langid._points([langid.START + "abab", langid.START + "bbab"])
    short, log = ({k: sum(f[w, 0] for number, f in flows(PIECES, table, points) for w in range(2) if number[w] == k) for k in range(1, 8)} for flows in (langid._flows, langid._log_flows))
    assert all(math.isclose(short[k], log[k], abs_tol=1e-9) for k in short)
    long = langid.fit(PIECES, {"x": Counter({"ab" * 300: 1}), "y": Counter({"b" * 300: 1})})
    p = dict(zip(PIECES.texts, long.table[1:-1, 0]))
    assert p["ab"] + p["bab"] > p["a"] + p["b"] and np.isfinite(long.table).all()


def test_language_score_against_brute_force(spark, sf, monkeypatch):
    """Predictions of the query, from the model's own piece probabilities and a sum over segmentations a text at a time."""
    kept, fit = {}, langid.fit
    monkeypatch.setattr(langid, "fit", lambda *a: kept.setdefault("model", fit(*a)))
    rows = {r["doc_id"]: r for r in queries.op9_langid(spark, sf).collect()}
    model = kept["model"]
    number = {t: k + 1 for k, t in enumerate(model.pieces.texts)}

    def log_sum(word):
        sums = [np.zeros(len(model.languages))]
        for j in range(1, len(word) + 1):
            terms = [sums[i] + np.log(model.table[number.get(word[i:j], 0)]) for i in range(max(0, j - 16), j) if word[i:j] in number or j - i == 1]
            sums.append(np.logaddexp.reduce(terms))
        return sums[-1]

    for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 3000").limit(60).collect():
        words = langid._WORD.findall((r["text"] or "").lower())
        total = sum((log_sum(langid.START + w) for w in words), np.zeros(len(model.languages)))
        best = int(np.argmax(total))
        want = (model.languages[best], float(1 / np.exp(total - total[best]).sum())) if words else ("und", 0.0)
        got = rows[r["doc_id"]]
        assert got["lang_pred"] == want[0] and math.isclose(got["score"], want[1], abs_tol=1e-6)


def test_language_query_held_out(spark, sf_larger):
    lang = {r[0]: r[1] for r in spark.read.parquet(f"{sf_larger}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op9_langid(spark, sf_larger).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and all(r["held_out"] == out_of_training(r["doc_id"], 5) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.98


def test_language_edge_cases(spark, edge_docs, no_docs):
    rows = langid.language(edge_docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == edge_docs.count() and [(by[k]["lang_pred"], by[k]["score"]) for k in (1, 2, 3)] == [("und", 0.0)] * 3
    assert not by[None]["held_out"] and langid.language(no_docs, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    unlabelled = edge_docs.selectExpr("* except (lang)", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in langid.language(unlabelled, public_tokenizers.path("piece_bpe_32k.model")).collect()} == {"und"}


# -- quality

def test_quality_query_held_out(spark, sf_larger):
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{sf_larger}/labels.parquet").select("doc_id", "quality").collect()}
    rows = queries.op5_quality(spark, sf_larger).collect()
    assert all(r["held_out"] == out_of_training(r["doc_id"], 5) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.93


def test_quality_score_against_brute_force(spark, sf, monkeypatch):
    """Scores of the query, from the model's own vectors and weights a word at a time."""
    kept, fit = {}, quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a: kept.setdefault("model", fit(*a)))
    scores = {r["doc_id"]: r["score"] for r in queries.op5_quality(spark, sf).collect()}
    m = kept["model"]
    for r in spark.read.parquet(f"{sf}/documents.parquet").limit(80).collect():
        words = (r["text"] or "").encode().split()
        a, b = np.zeros(quality.DIMS), np.zeros(quality.DIMS)
        for k, w in enumerate(words):
            word, shape = quality.keys(w)
            a, b = a + m.words[word], b + m.shapes[shape]
            if k and words[k - 1] == w:
                b = b + m.shapes[quality.AGAIN]
        x = np.concatenate([a / max(1, len(words)), b / max(1, len(words)), [np.log1p(len(words))]])
        z = (x - m.mean) / m.scale
        logit = sum(math.tanh(float(z @ m.w1[:, h]) + m.b1[h]) * m.w2[h] for h in range(len(m.w2))) + m.b2
        assert math.isclose(scores[r["doc_id"]], 1 / (1 + math.exp(-logit / m.temperature)), abs_tol=1e-4)


def test_quality_edge_cases(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(k, k % 2 if k % 5 else None) for k in range(20, 40)] + [(99, 1), (None, 1)], "doc_id bigint, quality int")
    rows = quality.quality(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1
    for some in (labels.where("quality = 1"), labels.where("false")):
        assert len({r["score"] for r in quality.quality(edge_docs, some).collect()}) == 1
    assert quality.quality(no_docs, labels).count() == 0


# -- language model

def test_lm_base_against_brute_force(spark, sf):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    tokens = {d: [*bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split(), None] for d, t in docs.items()}
    count = Counter(w for d, ws in tokens.items() if not out_of_training(d, 10) for w in ws)
    n, v = sum(count.values()), len(count)
    for local in (lm.LOCAL, 700):
        table = spark.read.parquet(f"{sf}/documents.parquet")
        rows = lm.score(table, local=local).collect()
        assert len(rows) == len(docs)
        for r in rows:
            ws = tokens[r["doc_id"]]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ws), sum(count[w] > 0 for w in ws), n, out_of_training(r["doc_id"], 10))
            assert math.isclose(r["base_score"], sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        held = [r for r in rows if r["held_out"]]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def naive(model, context, target):
    """The target's log-probability, one product at a time."""
    q = sum(np.asarray(t[c], float) for t, c in zip(model.places, context))
    of = lambda v, b: np.array([float(q @ x) + float(y) for x, y in zip(np.asarray(v, float), b)])
    bounds = [*model.starts.tolist(), len(model.bias)]
    place = int(model.order[target])
    cls = next(c for c in range(len(model.starts)) if bounds[c] <= place < bounds[c + 1])
    log = lambda s, k: s[k] - math.log(np.exp(s).sum())
    return log(of(model.class_vectors, model.class_bias), cls) + log(of(model.vectors[bounds[cls] : bounds[cls + 1]], model.bias[bounds[cls] : bounds[cls + 1]]), place - bounds[cls])


def test_lm_is_normalised_and_learns():
    rng = np.random.default_rng(1)
    target = rng.integers(0, 40, 30_000)
    windows = np.stack([(target * 7 + 3) % 40, rng.integers(0, 40, 30_000), (target + rng.integers(0, 2, 30_000)) % 40, target], 1)
    base = np.bincount(target, minlength=40) / len(target)

    def run(step, tables, fixed, seed):
        step(tables, windows, fixed, seed)
        return tables

    model = lm.train(run, base, classes=8)
    contexts = np.repeat(windows[:50, :3], 40, 0)
    log = model.log_probabilities(contexts, np.tile(np.arange(40), 50)).reshape(50, 40)
    assert np.allclose(np.exp(log).sum(1), 1, atol=1e-5) and len(model.starts) == 8
    assert all(math.isclose(log[k, t], naive(model, windows[k, :3], t), abs_tol=1e-4) for k in range(3) for t in range(40))
    assert model.log_probabilities(windows[:, :3], target).mean() > np.log(base)[target].mean() + 1


def test_lm_trains_in_groups_whose_mean_learns(spark, monkeypatch):
    """Windows grow with the corpus, groups with the windows; a parameter is the mean over the groups that moved it."""
    monkeypatch.setattr(lm, "WINDOWS", 100)
    monkeypatch.setattr(lm, "EVERY", 2)
    monkeypatch.setattr(lm, "CHUNK", 64)
    rng = np.random.default_rng(6)
    own = {b"w%d" % k: k for k in range(30)}
    texts = [" ".join(f"W{(k + i) % 30}" for i in range(rng.integers(20, 60))) for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").repartition(3, "id")
    windows = lm.sampled_windows(docs, own, 0.5, 4)
    tokens = sum(len(t.split()) + 1 for t in texts)
    rows = np.concatenate([np.frombuffer(r["w"], "<u2").reshape(-1, 4) for r in windows.collect()])
    assert abs(len(rows) - tokens / 2) < 4 * tokens**0.5 and {r["grp"] for r in windows.collect()} == set(range(4))
    inside = rows[(rows < 30).all(1)]
    assert ((inside[:, 0] + 1) % 30 == inside[:, 3]).all()

    def step(tables, own_rows, fixed, seed):
        tables[0].value[:2] += len(own_rows)
        tables[0].seen[:2] += 1

    start = [lm.Table.of(np.ones((5, 3)))]
    sizes = Counter()
    for r in windows.collect():
        sizes[r["grp"]] += len(r["w"]) // 8
    got = lm.groups_of(windows, 30)(step, start, None, 1)[0]
    assert np.allclose(got.value[:2], 1 + sum(sizes.values()) / 4) and np.allclose(got.value[2:], 1) and np.allclose(got.seen[:2], 1.001)
    base = np.bincount(rows[:, 3], minlength=32) + 0.1
    model = lm.train(lm.groups_of(windows, 30), base / base.sum(), classes=4)
    assert model.log_probabilities(inside[:, :3].astype(int), inside[:, 3].astype(int)).mean() > -1.5 > np.log(1 / 30)
    nothing = lm.groups_of(windows.where("false"), 30)(step, [lm.Table.of(np.ones((5, 3)))], None, 1)[0]
    assert (nothing.value == 1).all()


def test_lm_score_against_brute_force(spark, monkeypatch, no_docs):
    """Scores of documents in one row and in slices, from the model's own tables a token at a time."""
    rng, kept = np.random.default_rng(4), {}
    texts = [" ".join(rng.choice([f"W{k}" for k in range(60)], rng.integers(0, 40))) + (" rare%d" % k) * (k % 3) for k in range(90)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id bigint, text string, row int")
    train = lm.train
    monkeypatch.setattr(lm, "train", lambda *a, **k: kept.setdefault("model", train(*a, **k)))
    rows = lm.score(docs, targets=20, classes=4, local=40).collect()
    tokens = [t.lower().split() for t in texts]
    count = Counter(w for k, ws in enumerate(tokens) if not out_of_training(k, 10) for w in ws)
    own = {w: k for k, (w, _) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0]))[:20])}
    kinds = len(count) - len(own)
    other = sum(c for w, c in count.items() if w not in own) + 0.1 * (kinds + 1)
    for r in rows:
        chain, want = [21, 21, 21, *[own.get(w, 20) for w in tokens[r["doc_id"]]], 21], 0.0
        for k in range(3, len(chain)):
            want += naive(kept["model"], chain[k - 3 : k][::-1], chain[k])
        want = want / math.log(10) + sum(math.log10((count[w] + 0.1) / other) for w in tokens[r["doc_id"]] if w not in own)
        assert math.isclose(r["score"], want, rel_tol=1e-5)


def test_lm_edge_cases(spark, edge_docs, no_docs):
    rows = lm.score(edge_docs).collect()
    assert len(rows) == edge_docs.count() and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows) and lm.score(no_docs).count() == 0
    alone = spark.createDataFrame([(None, "a b")], "doc_id bigint, text string")
    r = lm.score(alone).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0) and math.isfinite(r["score"])


def test_lm_learns_from_all_positions(spark, monkeypatch):
    """Every position of the training fold is a window, also where there are more than WINDOWS of them."""
    monkeypatch.setattr(lm, "WINDOWS", 50)
    monkeypatch.setattr(lm, "DRAWN", 100)
    docs = spark.createDataFrame([(k, f"a b w{k % 9} a " * (k % 5)) for k in range(200)], "doc_id bigint, text string")
    seen, make = [], lm.sampled_windows
    monkeypatch.setattr(lm, "sampled_windows", lambda *args: seen.append(make(*args)) or seen[-1])
    tokens = lm.score(docs, targets=20, classes=4).first()["train_tokens"]
    assert sum(len(r["w"]) // 8 for r in seen[0].collect()) == tokens > 1000


def test_lm_windows_are_kept_as_one_number_a_position(spark, monkeypatch):
    """Windows of all positions, over chunks of long documents too, from two bytes a position: neither written nor shuffled."""
    monkeypatch.setattr(lm, "CHUNK", 50)
    monkeypatch.setattr(lm, "DRAWN", 100)
    own = {b"w%d" % k: k for k in range(30)}
    texts = [None, "", *(" ".join(f"w{(k * i) % 33}" for i in range(k * 5)) for k in range(40))]
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").repartition(3, "id")
    df = lm.sampled_windows(docs, own, 1.0, 4)
    rows = df.collect()
    want = Counter()
    for t in texts:
        chain = [31, 31, 31, *[own.get(w.encode(), 30) for w in (t or "").split()], 31]
        want += Counter(tuple(chain[k - i] for i in (1, 2, 3, 0)) for k in range(3, len(chain)))
    got = Counter(tuple(map(int, x)) for r in rows for x in np.frombuffer(r["w"], "<u2").reshape(-1, 4))
    assert got == want and max(want.values()) > 1
    stored = spark.read.parquet(*df.inputFiles())
    assert stored.columns == ["grp", "ids"] and sum(len(r["ids"]) for r in rows) < sum(len(r["w"]) for r in rows) / 3
    seen = []
    monkeypatch.setattr(type(df), "groupBy", lambda self, *c, of=type(df).groupBy: seen.append(self) or of(self, *c))
    lm.groups_of(df, 30)(lambda *a: None, [lm.Table.of(np.ones((5, 3)))], None, 1)
    assert seen[0].columns == ["grp", "ids", "share"] and "windows" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_lm_words_of_a_column_and_its_parts():
    """Words are told apart and numbered a column at a time; only ASCII white space parts them."""
    import pyarrow as pa

    texts = ["", None, " \n\t ", "A\x0bb\x0cC  d\r", "x\x1cy z\x85w\u2003v \x00", "É é ẞ 中中 👍", "long " * 300, "last"]
    column = pa.array(texts, pa.string())
    want = [bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split() for t in texts]
    parts = list(lm._parts(column.slice(1), 40))
    assert [x for p in parts for x in p.to_pylist()] == texts[1:] and len(parts) > 2 and all(len(p) == 1 or sum(len((x or "").encode()) for x in p.to_pylist()) <= 40 for p in parts)
    words, lengths = lm._words(column)
    assert words.to_pylist() == [w for ws in want for w in ws] and lengths.tolist() == [len(ws) for ws in want]
    assert lm._numbers(words, pa.array([b"last", b"long"])).tolist() == [{b"last": 0, b"long": 1}.get(w, -1) for ws in want for w in ws]
    flat, at = lm._chain(np.arange(len(words)), lengths, -2, -1)
    assert [flat[k] for k in at if flat[k] >= 0] == list(range(len(words))) and (flat[at] == -1).sum() == len(texts) and (flat == -2).sum() == lm.PLACES * len(texts)


def test_lm_rare_words_meet_their_counts_without_sorting(spark, monkeypatch):
    """A hash join where a partition's share of the distinct words is bounded, any join otherwise; the results are equal."""
    docs = spark.createDataFrame([(k, " ".join(f"w{k * i % 97}" for i in range(k % 30))) for k in range(120)], "doc_id bigint, text string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    hashed = lm.score(docs, targets=20, classes=4, local=40)
    monkeypatch.setattr(lm, "HASHED", 0)
    other = lm.score(docs, targets=20, classes=4, local=40)
    assert "ShuffledHashJoin" in plan(hashed) and "SortMergeJoin" not in plan(hashed) and "ShuffledHashJoin" not in plan(other)
    assert all(x[:5] == y[:5] and math.isclose(x["base_score"], y["base_score"], rel_tol=1e-12) for x, y in zip(sorted(hashed.collect()), sorted(other.collect()), strict=True))


def test_lm_classes_of_frequent_targets_are_small():
    """Each target is in one class; one as likely as a class is alone, and the frequent eighth has half of the classes."""
    rng, base = np.random.default_rng(2), 1 / np.arange(1, 4097)
    base /= base.sum()
    groups = lm._classes(rng.normal(size=(4096, 4)), base, 32)
    alone = int((base >= 1 / 32).sum())
    assert sorted(np.concatenate(groups).tolist()) == list(range(4096)) and len(groups) == 32 + alone and alone > 1
    assert [len(g) for g in groups[:alone]] == [1] * alone
    assert sum(base[g].sum() * len(g) * (len(g) > 1) for g in groups) < 0.6 * 4096 / 32


def test_lm_sparse_steps_against_rows_one_by_one():
    rng = np.random.default_rng(8)
    for width in (4, 5):
        for rows in (np.array([3, 1, 3, 3, 7, 0, 7, 9]), np.array([2, 5, 8]), np.array([4, 4, 4])):
            start, grad = rng.normal(size=(11, width)).astype(np.float32), rng.normal(size=(len(rows), width)).astype(np.float32)
            table = lm.Table.of(start)
            assert (table.take(rows) == start[rows]).all()
            table.step(grad, rows)
            for r in range(11):
                total = grad[rows == r].sum(0, dtype=float)
                assert np.allclose(table.seen[r], 1e-3 + total**2, rtol=1e-5) and np.allclose(table.value[r], start[r] + lm.RATE * total / np.sqrt(1e-3 + total**2), rtol=1e-5, atol=1e-6)
