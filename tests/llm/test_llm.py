"""Every operator against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from assayer.llm import chat, leaks, mixing, neardup, neighbours, quality, repeats, suffixes, tokens, toxicity, urls

RNG = np.random.default_rng(5)
VOCABULARY = ["alpha", "Beta", "gamma,", "délta", "eps.", "zeta", "eta", "Theta", "iota", "kappa", "la", "mu", "nu", "ξι", "pi", "rho"]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCABULARY, n))


EDGE = [(0, None), (1, ""), (2, "   "), (3, "one"), (4, prose(60, 1)), (5, prose(60, 1)), (5, prose(60, 1)), (None, prose(60, 1)), (None, "!!! ???"), (6, prose(5000, 2)), (7, "a" * 3000)]
SCHEMA = "doc_id long, text string, score string, node string, size string, count string, label string, _x string"


def docs(spark, rows, parts=3):
    full = [(i, t, "s", "n", "z", "c", "l", "x") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def test_clashing_text_columns(spark):
    rows = [(i, prose(40, i) if i % 3 else "x | y %% idiot " * 20) for i in range(120)]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, score string, predicted string, n_tokens int")
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    model, other = quality.quality_model(plain, labels), toxicity.fit_toxicity(plain, labels, quality.F.lit(True))
    for score, m in ((quality.score_quality, model), (toxicity.score_toxicity, other)):
        assert Counter((r.doc_id, r.score) for r in score(d, m, "score").collect()) == Counter((r.doc_id, r.score) for r in score(plain, m).collect())
    P = pytest.importorskip("public_tokenizers")
    got = tokens.count_tokens(d, P.path("byte_bpe_50k.json"), "score", keep=("doc_id", "n_tokens", "doc_id"))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and got.count() == 120


def test_sample_is_bounded(spark):
    d = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None), (3, "c")] + [(1, "b")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (4, 1), (3, None)], "doc_id long, quality int")
    got = quality.labelled_sample(d, labels, quality.F.lit(True), "quality", 10).collect()
    assert sorted((r._id_, r.y, r._text_) for r in got) == [(1, 1, "a"), (2, 1, None)]


def additive_by_hand(model, x):
    """The model's score of one row, looked up bin by bin."""
    at = lambda edges, v: sum(v >= e for e in edges)
    total = model.base + sum(model.tables[f][at(model.edges[f], v)] for f, v in enumerate(x))
    total += sum(grid[at(model.coarse[f], x[f])][at(model.coarse[g], x[g])] for (f, g), grid in zip(model.pairs, model.grids, strict=True))
    return 1 / (1 + np.exp(-min(max(total, -30), 30)))


def quality_features_by_hand(text):
    raw = (text or "").encode()
    share = lambda n, of: n / max(of, 1)
    out = [share(sum(b in set(members) for b in raw), len(raw)) for members in quality._CLASSES.values()]
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    low = [x.lower() for x in w]
    mean = lambda flags, of: share(sum(flags), len(of))
    marks, word = set(b"#$%&*+=@^_~\\|<>[]{}/"), re.compile(rb"[0-9A-Za-z\x80-\xff]")
    lines = [x for x in raw.split(b"\n") if x]
    out += [np.log1p(len(raw)), np.log1p(len(w)), share(sum(map(len, w)), len(w)), mean((len(x) <= 3 for x in w), w), mean((len(x) > 14 for x in w), w), mean((bool(marks & set(x)) for x in w), w), mean((not word.search(x) for x in w), w)]
    out += [share(len(set(low)), len(w)), share(len(set(zip(low, low[1:]))), len(w) - 1), share(max(Counter(low).values(), default=0), len(w))]
    out += [np.log1p(len(lines)), np.log1p(share(len(raw), len(lines))), share(len({x.lower() for x in lines}), len(lines)), mean((len(x) < 30 for x in lines), lines), mean((x[-1:] in b'.!?"' for x in lines), lines)]
    return out + [mean((2 * len(re.findall(rb"[A-Z]", x)) > len(x) for x in w), w), share(sum(x == y for x, y in zip(low, low[1:])), len(w))]


MIXED = [*(t for _, t in EDGE if t is not None), "Say: YES\n\nno! no no\tend\r\n|x| #y z_z", "<b>A</b> - - ... 12 34 \"q\" é É", "x\ny\nx\nlonger line of more than thirty bytes.", "ABC DEF ghi abc"]


def test_quality_scores_by_hand(spark):
    rows = [(i, prose(40, i) if i % 3 else "x | y %% " * 20) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.quality_model(d, spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id long, quality int"))
    texts = [*MIXED, *(t for _, t in rows[:20]), None]
    got = {r.doc_id: r.score for r in quality.score_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert model.pairs and all(got[i] == pytest.approx(additive_by_hand(model, quality_features_by_hand(t)), abs=1e-9) for i, t in enumerate(texts))


def toxicity_features_by_hand(text, automaton, weights):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    w = [(m.start(), m.end()) for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]
    data = np.frombuffer(low, np.uint8)
    kinds = [int(automaton.run(data, np.array([a]), np.array([b]))[0]) for a, b in w]
    hits = []
    for k, kind in enumerate(kinds):
        if kind:
            lo, hi = max(k - 6, 0), min(k + 6, len(w) - 1)
            quote = re.compile(rb"[\"`]")
            near_words = {low[a:b].decode() for a, b in w[lo : hi + 1]}
            quoted = bool(quote.search(low[w[lo][0] : w[k][0]])) and bool(quote.search(low[w[k][1] : w[hi][1]]))
            hits.append((weights[kind], kind % 2 == 0, quoted, bool(near_words & set(toxicity.REPORTING)), bool(near_words & set(toxicity.ADDRESS))))
    if not hits:
        return [0.0] * 11 + [np.log1p(len(w))]
    good = sum(max(h[0], 0) for h in hits)
    n = lambda k, want=True: np.log1p(sum(h[k] == want for h in hits))
    return [np.log1p(len(hits)), max(0, *(h[0] for h in hits)), np.log1p(good), good / len(w), n(1, False), n(1), max([0, *(h[0] for h in hits if h[1])]), n(2), n(2, False), n(3), n(4), np.log1p(len(w))]


def test_toxicity_scores_by_hand(spark):
    rows = [(i, prose(30, i) + (" you idiot scum " if i % 4 == 0 else " fine ") + prose(20, i + 500)) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit_toxicity(d, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int"), toxicity.F.lit(True))
    texts = [*MIXED, *(t for _, t in rows[:12]), "you idiott", 'he said "what an idiot" today', "`idiot` scum", "x " * 9 + '" ' + "y " * 7 + "idiot", "idiot " * 30, None]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert all(got[i] == pytest.approx(additive_by_hand(model.model, toxicity_features_by_hand(t, model.automaton, model.weights)), abs=1e-9) for i, t in enumerate(texts))


def test_registered_queries(spark, tmp_path):
    """Every opN query over small whole tables: its columns, one row per row, and its folds."""
    rows = [(i, prose(30 + i % 50, i) if i % 4 else "x | y %% you idiot " * 12) for i in range(160)] + [(200, prose(30, 5)), (201, None), (202, "")]
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(15, 7))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, RNG.standard_normal(8).tolist(), 0) for i in range(250)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, "http://www.example.com/en/x", ""), (2, None, "")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    from assayer.llm.queries import QUERIES

    columns = {
        "op1": "doc_id held_out score predicted", "op2": "doc_id n_bytes n_tokens over_limit", "op3": "page_id host path rule verdict", "op4": "doc_id size source_size target taken", "op5": "doc_id class_id class_docs",
        "op6": "doc_id n_words n_hit n_items items_sha256 contaminated n_near", "op7": "doc_id n_bytes n_removed n_spans kept_sha256 n_passages n_passage_bytes",
        "op8": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op9": "query_id rank vec_id score", "op10": "doc_id held_out score predicted",
    }
    counts = {"op3": 2, "op8": 2, "op9": 30}
    for name, query in QUERIES.items():
        op = name.split("_")[0]
        out = query(spark, str(tmp_path))
        got = out.collect()
        assert out.columns == columns[op].split() and len(got) == counts.get(op, len(rows)), name
        if op in ("op1", "op10"):
            n, fold = (5, 0) if op == "op1" else (4, 2)
            assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == fold) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert len(QUERIES) == 10


def test_quality(spark):
    rows = [(i, prose(40, i) if i % 3 else "x | y %% " * 20) for i in range(300)] + EDGE
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(1, None), (None, 1)], "doc_id long, quality int")
    d = docs(spark, rows)
    out = quality.score_quality(d, quality.quality_model(d, labels))
    got = out.select("doc_id", "score", "predicted", "node").collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.doc_id is not None and 10 < r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 30 and np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.97
    empty = quality.score_quality(d.limit(0), quality.quality_model(d.limit(0), labels.limit(0)))
    assert empty.count() == 0


def test_tokens(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    extra = ["it's we'll  two\n\n three<|endoftext|>four <|endoftext|>", "aaaaaaaaa" * 50, "日本語テキスト 🎉🎉 ½ ²", "\u00a0\u2003x\r\n\t y", "<|endoftext", "naïve façade " * 30]
    rows = EDGE + [(100 + i, t) for i, t in enumerate(extra)]
    t = Tokenizer.from_file(path)
    expected = Counter((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows)
    got = tokens.count_tokens(docs(spark, rows), path).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == expected
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)

    rng = random.Random(5)
    long = ["a" * 3001, " " * 2500, *("".join(rng.choices(letters, k=4000)) for letters in ("abcdefghijklmnopqrstuvwxyz", "aab", "äöüßжш漢字", "=-_*", ("the", "ing", "ation", "er", "re")))]
    got = tokens.count_tokens(docs(spark, list(enumerate(long))), path).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(long)}
    assert tokens.count_tokens(docs(spark, rows).limit(0), path).count() == 0


def test_urls(spark):
    listed = ["http://a.Example.com/en/x?y#z", "https://WWW.example.com/en/", "https://x.net/es/1", "http://net/fr/", "nothing", None, "http://", "ftp://q.org", "http://example.com", "http://a.com?x://y/z", "http://notexample.com/en/", "http://x..com/"] * 2
    pages = spark.createDataFrame([(i % 9 if i % 5 else None, u, "k", "h") for i, u in enumerate(listed)], "page_id long, url string, key string, host string")
    rules = spark.createDataFrame([*urls.RULES, ("com", "/", "allow")], "host string, path string, verdict string")

    def judge(u):
        host, path = "", ""
        if u and "://" in u:
            m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1])
            host, path = re.sub("[A-Z]", lambda x: x.group().lower(), m[1]), m[2]
        fit = [(len(h + p), v, h + p) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fit)[2], max(fit)[1]) if fit else (host, path, None, "allow")

    got = Counter(tuple(r) for r in urls.judge_urls(pages, rules).collect())
    assert got == Counter((p, *judge(u)) for p, u, *_ in pages.collect())
    many = spark.createDataFrame([(f"h{i}.org", "/", "block") for i in range(3000)], "host string, path string, verdict string")
    seen = spark.createDataFrame([(i, f"http://a.h{i}.org/x") for i in range(0, 6000, 7)], "page_id long, url string")
    assert {r.page_id for r in urls.judge_urls(seen, many).where("verdict = 'block'").collect()} == {i for i in range(0, 6000, 7) if i < 3000}
    assert {r.verdict for r in urls.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert urls.judge_urls(pages.limit(0), rules).count() == 0


def fill(totals, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted((s for s in totals if s is not None)) + [s for s in totals if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, share * sum(totals.values()), set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * totals[s]}
        if not over:
            return target | {s: level * w[s] for s in free}
        for s in over:
            target[s] = cap * totals[s]
            left -= target[s]
        free -= over
    return target


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)
    rows = [(i, prose(int(RNG.integers(1, 80)), i), ["b", "a", "ä", None, "z"][i * i % 5 if i % 3 else 0]) for i in range(900)] + [(5, "w w", "b"), (5, "w w", "b"), (None, "x y z", "a"), (1, None, "b"), (2, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = mixing.mix_sources(d.repartition(5)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals = Counter()
    for _, t, s in rows:
        totals[s] += size(t)
    want = fill(totals)
    assert Counter((r.doc_id, r.source, r.size) for r in first) == Counter((i, s, size(t)) for i, t, s in rows)
    taken = Counter()
    for r in first:
        taken[r.source] += r.taken
        assert r.source_size == totals[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size and r.taken == r.size * r.copies
    assert all(abs(taken[s] - want[s]) <= 80 for s in totals)
    assert Counter(map(tuple, mixing.mix_sources(d.repartition(2)).collect())) == Counter(map(tuple, first))
    assert mixing.mix_sources(d.limit(0)).count() == 0


def jaccard_classes(rows, at=0.8):
    """Classes by the weighted similarity of the counts of shingles."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else (Counter([("bytes", t)]) if t else None))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and (sets[i] & sets[j]).total() >= at * (sets[i] | sets[j]).total() - 1e-12:
                parent[root(i)] = root(j)
    groups = {}
    for i, s in enumerate(sets):
        groups.setdefault(root(i) if s else ("alone", i), []).append(i)
    out = Counter()
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        for i in g:
            out[rows[i][0], min(ids) if ids else None, len(g)] += 1
    return out


@pytest.mark.parametrize("block", [256, 3])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = list(EDGE)
    for f in range(6):
        base = prose(150, 100 + f).split()
        for k in range(14):
            w = list(base)
            for e in range(k % 5):
                w[int(RNG.integers(len(w)))] = f"edit{f}{k}{e}"
            rows.append((1000 + 20 * f + k, " ".join(w)))
    rows += [(3000 + i, prose(int(RNG.integers(3, 60)), 900 + i)) for i in range(60)] + [(4000, "One two."), (4001, "one TWO"), (4002, "!!! ???")]
    line = prose(12, 5000)
    rows += [(5000 + n, " ".join([line] * n)) for n in (1, 2, 3, 20, 21, 30)] + [(5100 + n, "la " * n) for n in (6, 60, 63, 90)]
    got = Counter(tuple(r) for r in neardup.near_duplicates(docs(spark, rows)).collect())
    assert got == jaccard_classes(rows)
    assert neardup.near_duplicates(docs(spark, rows).limit(0)).count() == 0


@pytest.fixture
def bucketed(monkeypatch):
    """Gives every text with words the one band ``of`` (an expression over the columns of signatures())."""
    real = neardup.signatures
    return lambda of: monkeypatch.setattr(neardup, "signatures", lambda *a: real(*a).selectExpr("doc_id", "node", "filled", f"if(size(bands) > 0, array(cast({of} as long)), bands) AS bands"))


@pytest.mark.parametrize("block", [256, 3])
def test_near_duplicates_of_several_families_and_chains_in_one_bucket(spark, monkeypatch, bucketed, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    bucketed("0")
    rows = []
    for f in range(12):
        base = [f"w{f}x{k}" for k in range(90)]
        if f % 3:  # a family: copies with one word changed
            rows += [(100 * f + k, " ".join(base[:9 * k] + ["new"] + base[9 * k + 1 :])) for k in range(7)]
        else:  # a chain: windows of the text, each near to the next only
            rows += [(100 * f + k, " ".join(base[4 * k : 4 * k + 60])) for k in range(7)]
    got = Counter(tuple(r) for r in neardup.near_duplicates(docs(spark, rows)).collect())
    assert got == jaccard_classes(rows) and len({c for _, c, _ in got}) == 12


def test_near_duplicates_at_three_fifths_to_the_pivot(spark, bucketed):
    bucketed("doc_id div 10")
    rows = [(10 * t + k, " ".join(f"w{t}x{i}" for i in range(lo, hi))) for t in range(30) for k, (lo, hi) in enumerate([(1, 9), (1, 10), (2, 10)])]
    got = Counter(tuple(r) for r in neardup.near_duplicates(docs(spark, rows)).collect())
    assert got == jaccard_classes(rows) and {n for _, _, n in got} == {3}


def test_dart_minhash_estimates_weighted_similarity():
    a, b = np.arange(1, 400, dtype=np.uint64), np.arange(100, 500, dtype=np.uint64)
    wa, wb = RNG.uniform(0.2, 4, 500), RNG.uniform(0.2, 4, 500)
    owner = np.repeat([0, 1], [len(a), len(b)])
    both = np.concatenate((a, b))
    weight = np.concatenate((wa[a.astype(int)], wb[b.astype(int)]))
    sig = neardup.dart_minhash(owner, both, weight, 3, 4096)
    x, y = np.zeros(500), np.zeros(500)
    x[a.astype(int)], y[b.astype(int)] = wa[a.astype(int)], wb[b.astype(int)]
    assert abs((sig[0] == sig[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.03
    assert (sig[2] == np.iinfo(np.int64).max).all()


@pytest.mark.parametrize("small", [{}, {"WINDOWS": 8, "SEGMENT_BYTES": 300, "BATCH": 4}])
def test_leaks(spark, monkeypatch, small):
    for name, bound in small.items():
        monkeypatch.setattr(leaks, name, bound)
    items = [(1, prose(30, 7)), (2, "rare phrase"), (3, "single"), (4, ""), (5, None), (6, prose(12, 8)), (6, prose(12, 8)), (10, "rare phrase")]
    rows = [*EDGE, (20, "x " + prose(30, 7)[20:160] + " y"), (21, "a RARE  phrase, rare. phrase single"), (22, prose(12, 8)), (23, "rare"), (24, prose(200, 9) + " rare phrase"), (25, "phrase rare")]
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    expected = Counter()
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for win, of in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found |= of
        expected[i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    b = spark.createDataFrame(items, "item_id long, text string")
    got = leaks.find_leaks(docs(spark, rows), b)
    assert Counter(tuple(r)[:6] for r in got.collect()) == expected
    near = {r.doc_id: r.n_near for r in leaks.find_leaks(docs(spark, [(1, "rare x phrase"), (2, "rare x y phrase"), (3, "rare phrase")]), b.where("item_id = 2"), slack=1).collect()}
    assert near == {1: 1, 2: 0, 3: 1}
    assert leaks.find_leaks(docs(spark, rows), b.limit(0)).where("contaminated").count() == 0
    assert leaks.find_leaks(docs(spark, rows).limit(0), b).count() == 0


def test_leaks_count_overlaps_of_blocks_once(spark, monkeypatch):
    """Windows of one passage that are searched by different tasks hit the same words; a frequent word is many rows."""
    monkeypatch.setattr(leaks, "WINDOWS", 2)
    passage = prose(40, 90)
    b = spark.createDataFrame([(1, passage), (2, passage[20:150]), (3, "the")], "item_id long, text string")
    rows = [(i, "the " * 30 + (passage if i % 2 else "the")) for i in range(40)]
    got = leaks.find_leaks(docs(spark, rows), b, carry=("n_hit", "label"))
    assert got.columns[-1] == "label"
    assert {(r.doc_id % 2, r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect()} == {(1, 70, 70, ("1", "2", "3")), (0, 31, 31, ("3",))}


def test_leaks_of_items_without_id(spark):
    b = spark.createDataFrame([(None, "rare phrase"), (2, "single"), (None, None)], "item_id long, text string")
    got = {r.doc_id: r for r in leaks.find_leaks(docs(spark, [(1, "a rare phrase"), (2, "single rare phrase"), (3, "clean")]), b).collect()}
    assert [(got[i].n_hit, got[i].n_items, got[i].contaminated, got[i]["items"]) for i in (1, 2, 3)] == [(2, 0, True, []), (3, 1, True, ["2"]), (0, 0, False, [])]
    assert got[1].items_sha256 == hashlib.sha256(b"").hexdigest()


def test_leaks_near(spark, tmp_path):
    letters = lambda n: " ".join(RNG.choice(list("abcdefg"), n))
    items = [(i, letters(3)) for i in range(20)] + [(20, "lone"), (21, "rare phrase"), (22, "x rare phrase")]
    rows = [(i, letters(int(RNG.integers(0, 40)))) for i in range(60)] + [(60, "rare x y"), (61, "z phrase"), (62, "rare"), (63, "phrase"), (64, "rare x y phrase x rare rare z phrase")]

    def shortest(w, window, slack):
        n = 0
        for start in (k for k, x in enumerate(w) if x == window[0]):
            at = start
            for term in window[1:]:
                at = w.index(term, at + 1) if term in w[at + 1 :] else 10**6
            n += at - start <= len(window) - 1 + slack
        return n

    d, b = docs(spark, rows, 1), spark.createDataFrame(items, "item_id long, text string")
    windows = {tuple(words(t)) for _, t in items}
    for slack in (0, 1, 2, 5):
        near = {r.doc_id: r.n_near for r in leaks.find_leaks(d, b, slack=slack).collect()}
        assert near == {i: sum(shortest(words(t), w, slack) for w in windows) for i, t in rows}
    for name, t in ("documents", d), ("benchmark", b):
        t.write.parquet(f"{tmp_path}/{name}.parquet")
    near = {r.doc_id: r.n_near for r in leaks.op6_decontaminate(spark, str(tmp_path)).collect()}
    assert near == {i: sum(shortest(words(t), w, leaks.SLACK) for w in windows) for i, t in rows} and near[64] == 4


def removed(rows, length):
    seen = Counter()
    raw = [(t or "").encode() for _, t in rows]
    for r in raw:
        seen.update(r[i : i + length] for i in range(len(r) - length + 1))
    out = Counter()
    for (i, _), r in zip(rows, raw, strict=True):
        gone = np.zeros(len(r) + 2, bool)
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k + 1 : k + length + 1] = True
        kept = bytes(b for b, g in zip(r, gone[1:-1], strict=True) if not g)
        out[i, len(r), len(r) - len(kept), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("crowd", [1024, 3])
def test_repeats(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    passage, short = prose(120, 50), prose(200, 51)[:430]
    rows = [*EDGE, (30, prose(90, 60) + passage + prose(50, 61)), (31, passage), (32, passage[10:500] + "x" + passage[500:]), (33, "abc" * 500), (34, "ab" * 700 + "c")]
    rows += [(100 + i, prose(30 + i, 200 + i) + short + prose(40, 300 + i)) for i in range(25)] + [(200 + i, f"{i}é" * 3 + short[:398 + i % 6] + f"{i}") for i in range(25)]
    got = Counter(tuple(r) for r in repeats.dedupe_repeats(docs(spark, rows)).collect())
    assert got == removed(rows, 400)
    assert repeats.dedupe_repeats(docs(spark, rows).limit(0)).count() == 0


def test_repeats_groups_meet(spark, monkeypatch):
    """Groups are dealt by a repartition of their own: that of a join gives way, and its readers may scatter a group."""
    plans, mark = [], repeats._mark

    def planned(rows, length):
        out = mark(rows, length)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(repeats, "_mark", planned)
    monkeypatch.setattr(repeats, "CROWD", 20)
    passage = prose(200, 53)[:430]
    rows = [(100 + i, prose(30 + i % 40, 700 + i // 2) + prose(9, 900 + i) + passage + prose(4, 1300 + i)) for i in range(60)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = Counter(tuple(r) for r in repeats.dedupe_repeats(docs(spark, rows)).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == removed(rows, 400)
    assert len(plans) > 1 and all("REPARTITION_BY_COL" in p and "Join" not in p for p in plans)


def test_repeats_rows_of_large_groups(spark, monkeypatch):
    """Slices grow with the contents of a group, not with all their starts, and a group that fits a block has none."""
    made, cut = [], repeats._slices

    def counted(rows, width, length):
        out = cut(rows, width, length)
        made[-1] += out.count()
        return out

    monkeypatch.setattr(repeats, "_slices", counted)
    passage = prose(200, 54)[:600]
    for n, crowd in (60, 20), (120, 20), (1100, repeats.CROWD):
        monkeypatch.setattr(repeats, "CROWD", crowd)
        rows = [(i, prose(40, 2000 + i) + f"#{i} " + passage + f" {i}#" + prose(40, 4000 + i)) for i in range(n)]
        made.append(0)
        got = Counter(tuple(r) for r in repeats.dedupe_repeats(docs(spark, rows)).collect())
        if n < 200:
            assert got == removed(rows, 400)
        assert sum(got.values()) == n and all(r[2] >= 600 for r in got)
    assert 0 < made[0] <= 60 * 50 and made[1] <= 2.2 * made[0] and made[2] == 0, made


def test_repeats_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE_BYTES", 1500)
    rows = [(1, prose(4000, 70)), (2, prose(900, 71) + prose(4000, 70)[7000:9000]), (3, prose(10, 72))]
    assert Counter(tuple(r) for r in repeats.dedupe_repeats(docs(spark, rows)).collect()) == removed(rows, 400)


def passages(rows, length, least):
    """Number and bytes of the maximal runs that repeated windows cover and that hold so many whole words."""
    seen = Counter()
    raw = [(t or "").encode() for _, t in rows]
    for r in raw:
        seen.update(r[i : i + length] for i in range(len(r) - length + 1))
    out = Counter()
    for (i, _), r in zip(rows, raw, strict=True):
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - length + 1):
            gone[k : k + length] |= seen[r[k : k + length]] > 1
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
        runs = [(b, e) for b, e in zip(edges[::2], edges[1::2], strict=True) if sum(b <= m.start() and m.end() <= e for m in re.finditer(rb"\S+", r)) >= least]
        out[i, len(runs), int(sum(e - b for b, e in runs))] += 1
    return out


def test_passages(spark):
    passage, short = prose(55, 50), prose(40, 51)
    rows = [*EDGE, (30, prose(90, 60) + " " + passage + " " + prose(50, 61)), (31, prose(20, 62) + "x" + passage + "\n" + prose(9, 63)), (33, "la " * 300), (34, short + prose(70, 64)), (35, prose(70, 65) + short)]
    rows += [(100 + i, prose(30 + i, 200 + i) + " " + prose(150, 52) + " " + prose(40, 300 + i)) for i in range(12)]
    got = repeats.dedupe_repeats(docs(spark, rows), passage=(240, 51)).collect()
    assert Counter(tuple(r)[:5] for r in got) == removed(rows, 400)
    assert Counter((r.doc_id, r.n_passages, r.n_passage_bytes) for r in got) == passages(rows, 240, 51)
    only = repeats.dedupe_repeats(docs(spark, rows), length=240, words=51, with_kept=True).collect()
    assert Counter((r.doc_id, r.n_spans, r.n_removed) for r in only) == passages(rows, 240, 51)
    assert repeats.dedupe_repeats(docs(spark, rows).limit(0), passage=(240, 51)).count() == 0


def test_contents_are_unique(spark):
    shared = spark.createDataFrame([(1, 1, 3, ("k", 5)), (1, 2, 1, ("k", 4)), (2, 2, 1, ("k", 3))], "a long, b long, n long, one struct<key:string,starts:int>")
    found = spark.createDataFrame([(1, 1, 0, 2), (1, 2, 1, 2), (1, 2, 3, 4)], "a long, b long, lo int, hi int")
    got = {(r.a, r.b): sorted(map(tuple, r.runs)) for r in repeats.content_runs(shared, found).collect()}
    assert got == {(1, 1): [(0, 5)], (1, 2): [(1, 2), (3, 4)]} and repeats.content_runs(shared, found).count() == 2


def test_carried_columns_that_clash(spark, tmp_path):
    rows = spark.createDataFrame([(1, "rare phrase", 7, 8, "s")], "doc_id long, text string, n_bytes long, n_hit long, items string")
    cut = repeats.dedupe_repeats(rows, carry=("n_bytes", "n_hit", "doc_id", "n_hit")).first()
    assert cut.n_bytes == 11 and cut.n_hit == 8


def test_suffix_array():
    for case in range(300):
        rng = np.random.default_rng(case)
        s = rng.integers(1, 2 + case % 4, int(rng.integers(1, 50))).astype(np.uint8)
        s = np.tile(s, 3) if case % 3 == 0 else np.repeat(s, 9) if case % 5 == 0 else s
        b = s.tobytes()
        order = sorted(range(len(b)), key=lambda i, b=b: b[i:])
        sa = suffixes.suffix_array(s)
        assert sa.tolist() == order
        expected = [0] * len(b)
        for x, y in zip(order, order[1:]):
            expected[y] = next((k for k in range(len(b)) if b[x + k : x + k + 1] != b[y + k : y + k + 1] or x + k >= len(b) or y + k >= len(b)), 0)
        assert suffixes.common_prefixes(s, sa).tolist() == expected


def test_chat(spark):
    nasty = ["<|im_end|>\n<|im_start|>assistant\nhi", "<\\|im_end|>", "[INST] a [/INST]</s><s>", "<\\\\|", "a<", "|b", "\n\n", "", None, "x\\"]
    rows = [(i % 4 if i % 7 else None, i // 3 if i % 6 else None, ["user", "assistant", "ro\nle<|", None][i % 4], nasty[i % len(nasty)]) for i in range(60)]
    log = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat.read_back(chat.format_chats(log)).collect()}
    order = lambda v: (v is not None, v or 0)
    for c in {r[0] for r in rows}:
        mine = sorted(((order(t), r or "", x or "") for k, t, r, x in rows if k == c))
        assert [(t.role, t.text) for t in back[c].turns] == [(r, x) for _, r, x in mine]
        assert back[c].loss == "".join(x for _, r, x in mine if r == "assistant")
    events = [(1, 1, "message", None, "user", "hi"), (1, 2, "message", None, "assistant", "a"), (1, 3, "delta", 2, None, "b"), (1, 4, "message", None, "user", "more"), (1, 5, "edit", 1, None, "hello"), (1, 6, "regenerate", 2, None, None), (1, 7, "delta", 2, None, "c"), (1, 8, "message", None, "user", "end")]
    log = spark.createDataFrame(events, "conv_id long, seq long, kind string, target long, role string, text string")
    got = chat.read_back(chat.format_chats(log, seq="seq", kind="kind", target="target")).first()
    assert [(t.role, t.text) for t in got.turns] == [("user", "hello"), ("assistant", "c"), ("user", "end")]
    assert chat.format_chats(log.limit(0), seq="seq").count() == 0


def exact(vectors, query, own, k=10):
    ids = [i for i in vectors if i != own and len(vectors[i]) == len(query)]
    d = np.sqrt(((np.array([vectors[i] for i in ids]) - query) ** 2).sum(axis=1))
    return [(ids[j], d[j]) for j in np.lexsort((ids, d))[:k]]


def test_neighbours(spark):
    base = RNG.standard_normal((1500, 16)).astype(np.float32).astype(float)
    base[40:80] = base[40]
    vectors = {i: v.tolist() for i, v in enumerate(base)}
    odd = [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [None] * 16), (2400, [1.0, 2.0]), (None, [1.0] * 16)]
    d = spark.createDataFrame([*vectors.items(), *odd, (40, vectors[40])], "vec_id long, embedding array<double>")
    got = {}
    from pyspark.sql import functions as F

    for r in neighbours.nearest(d, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {i for i in vectors if i % 100 == 0}
    best = {q: exact(vectors, base[q], q) for q in got}
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in best[q]}) / 10 for q in got]) >= 0.9
    assert all(s == sorted(s, key=lambda x: (x[1], x[0])) and len(s) == 10 for s in got.values())
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in neighbours.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [2, 1]
    assert neighbours.nearest(few.limit(0), F.col("vec_id") == 0).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton():
    entries = [toxicity.Entry(b"idiot", False, 3.0), toxicity.Entry(b"scum", False, 2.0), toxicity.Entry(b"clowns", False, 1.0), toxicity.Entry(b"loow", True, 5.0)]
    a = toxicity.Automaton(entries)
    tried = ["idiot", "idiott", "idot", "jdiot", "diot", "idito", "scum", "scums", "sum", "clown", "clowns", "clouns", "loow", "loowx", "loo", "lowow", "", "x", "idioté"]
    tried += ["".join(RNG.choice(list("idotscumlwn"), int(RNG.integers(1, 8)))) for _ in range(3000)]
    raw = [t.encode() for t in tried]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw]) - 1
    starts = ends - [len(r) for r in raw]
    got = a.run(np.append(data, 0).astype(np.uint8), starts, ends)
    for t, g in zip(raw, got, strict=True):
        fit = [(e.weight - d, 1 + 2 * k + d) for k, e in enumerate(entries) for d in [edit_distance(t, e.text)] if not e.stem and d <= (len(e.text) >= 5)]
        fit += [(e.weight, 1 + 2 * k) for k, e in enumerate(entries) if e.stem and t.startswith(e.text)]
        assert g == (max(fit)[1] if fit else 0), t


def test_toxicity(spark):
    bad = ["idiot", "moron", "scumbag"]
    rows = [(i, prose(30, i) + (f" {bad[i % 3]} {bad[(i + 1) % 3]} " if i % 4 == 0 else "") + prose(30, 1000 + i)) for i in range(400)] + EDGE
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(3, None)], "doc_id long, toxic int")
    d = docs(spark, rows)
    model = toxicity.fit_toxicity(d, labels, toxicity.bk.crc_fold("doc_id", 4) != 2)
    got = toxicity.score_toxicity(d, model).select("doc_id", "score", "predicted").collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and 10 < r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.97
    typo = toxicity.score_toxicity(docs(spark, [(1, prose(30, 1) + " idiott " + prose(30, 2))]), model).first()
    assert typo.score > toxicity.score_toxicity(docs(spark, [(1, prose(60, 1))]), model).first().score
    assert toxicity.score_toxicity(d.limit(0), toxicity.fit_toxicity(d.limit(0), labels.limit(0), toxicity.F.lit(True))).count() == 0


def test_lexicon_keeps_every_form_with_support(spark):
    terms = sorted({"".join(np.random.default_rng(i).choice(list("bcdfghjkmpqtvwz"), 9)) for i in range(900)})
    rows = [(" ".join(terms[lo : lo + 100]), 1) for lo in range(0, len(terms), 100) for _ in range(4)] + [(prose(40, i), 0) for i in range(40)]
    got = toxicity.learn_lexicon(spark.createDataFrame(rows, "_text_ string, y int"))
    assert all(any(e.text == t.encode() or e.stem and t.encode().startswith(e.text) for e in got) for t in terms) and len(got) > 800


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as c

    passage = prose(150, 77)
    rows = [(i, prose(40, i) if i % 4 else "x | y %% " * 20) for i in range(200)] + [(300, prose(90, 4000)), (301, prose(90, 4000)), (302, prose(50, 4001) + passage), (303, prose(50, 4002) + passage), (304, "we leak " + prose(15, 7)), (None, None), (305, "")]
    spark.createDataFrame([(i, t, "en", f"s{i % 3 if i else 0}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(15, 7))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    near = {r.doc_id for r in c.drop_near_copies(spark, d, str(tmp_path)).collect()}
    assert 300 in near and 301 not in near and None in near
    cut = {r.doc_id: r for r in c.cut_repeats(spark, d, str(tmp_path)).collect()}
    assert passage not in cut[302].text and cut[302].n_chars == len(cut[302].text) and cut[304].text == dict(rows)[304]
    clean = {r.doc_id for r in c.drop_leaks(spark, d, str(tmp_path)).collect()}
    assert 304 not in clean and {300, 302, 305, None} <= clean
    out = c.run(spark, str(tmp_path)).collect()
    assert out and {304, 301}.isdisjoint({r.doc_id for r in out}) and all(r.taken == r.copies * r.size for r in out)


def test_pipeline_keeps_one_row_of_each_class(spark):
    import corpus_pipeline as c

    a, b, x, y, z = (" ".join(f"{n}{k}" for k in range(60)) for n in "abxyz")
    rows = [(1, a), (None, a), (None, a + " end"), (None, b), (None, b), (None, b + " end"), (6, x), (7, x + " end"), (7, y), (8, z), (8, z), (8, z + " end"), (None, None), (None, None), (None, ""), (9, ""), (9, "")]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = Counter((r.doc_id, r.text) for r in c.drop_near_copies(spark, d, "").collect())
    one = {(i, t[:2]): n for (i, t), n in got.items() if t}
    assert one == {(1, "a0"): 1, (None, "b0"): 1, (6, "x0"): 1, (7, "y0"): 1, (8, "z0"): 1}
    assert {k: n for k, n in got.items() if not k[1]} == {(None, None): 2, (None, ""): 1, (9, ""): 1}
