"""Jaccard join, decontamination, HTML, Ogg and WARC: brute force, exact round trips, odd input."""

import hashlib
import itertools
import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from windrill.llm import decontam, html_main, jaccard, ogg, warc
from windrill.llm.shared import work_folder
from windrill.llm.textnum import shingles, word_hashes


def sets_by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(map(tuple, [w])) if w else frozenset()


def jaccard_by_hand(rows):
    sets = [sets_by_hand(t) for _, t in rows]
    near = {i: set() for i in range(len(rows))}
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 60 * len(sets[i] | sets[j]):
            near[i].add(j)
            near[j].add(i)
    out = []
    for i, (doc, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        out.append((doc, len(sets[i]), len(near[i]), min(rows[k][0] for k in seen)))
    return sorted(out)


def corpus(seed=5, groups=14):
    """Copies, near copies at all distances around the threshold, chains, shared passages, odd texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 4)))
    passage = [word() for _ in range(60)]
    texts = ["", None, " \t\n", "one", "ONE", "one two", "one two", "Ünë Ünë", "ünë ünë", " ", "a b a b a b"]
    for g in range(groups):
        base = [word() for _ in range(r.choice([3, 8, 30, 120]))] + (passage if g % 3 == 0 else [])
        for k in range(r.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(int(len(copy) * 0.03 * k)):
                copy[r.randrange(len(copy))] = word()
            texts += [" ".join(copy)] * r.choice([1, 1, 3])
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts))


def test_jaccard_join_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"sig": F.lit("clash"), "n": F.lit(1), "root": F.lit(0), "component": F.lit(None).cast("string")})
    got = sorted((r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in jaccard.jaccard_join(df).collect())
    assert got == jaccard_by_hand(rows)


def test_jaccard_join_in_blocks_and_many_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "REGION", 4)
    monkeypatch.setattr(jaccard, "COLLECT", 0)
    monkeypatch.setattr(jaccard, "KEYS_PER_PART", 500)
    rows = corpus(9, 8)
    got = sorted((r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == jaccard_by_hand(rows)


def test_jaccard_join_without_rows_or_ids(spark):
    assert jaccard.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (7, "q r s")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_similar, r.component_id) for r in jaccard.jaccard_join(df).collect()) == [(-1, 2, 4), (4, 2, 4), (4, 2, 4), (7, 0, 7)]


@pytest.mark.parametrize("leaf", [4, 16, 256])
def test_region_join_is_exact_at_every_leaf_size(leaf):
    r = np.random.default_rng(leaf)
    base = [np.unique(r.integers(0, 1 << 40, n)).astype(np.uint64) for n in (5, 40, 41, 60, 200)]
    sets = []
    for b in base:
        for k in range(25):
            s = b.copy()
            n = int(len(s) * k * 0.02)
            s[r.permutation(len(s))[:n]] = r.integers(0, 1 << 40, n)
            sets.append(np.unique(s))
    side = r.integers(0, 2, len(sets))
    want = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if (c := len(np.intersect1d(sets[i], sets[j]))) * 100 >= 60 * (len(sets[i]) + len(sets[j]) - c)]
    assert list(zip(*map(list, jaccard.region_join(sets, leaf=leaf)))) == want
    assert list(zip(*map(list, jaccard.region_join(sets, side, leaf=leaf)))) == [(i, j) for i, j in want if side[i] != side[j]]


def test_one_large_region_and_a_hot_shingle(spark):
    """5,200 near copies in a chain of versions, and as many unrelated texts that share one shingle; counts by brute force on bits."""
    r = random.Random(11)
    base = [f"w{i}" for i in range(30)]
    rows = []
    for k in range(5200):
        if k % 40 == 0:
            base[r.randrange(30)] = f"v{k}"
        copy = list(base)
        copy[r.randrange(30)] = f"x{k}"
        rows.append((k, " ".join(copy)))
    rows += [(10_000 + k, f"hot shingle a{k} b{k} c{k} d{k}") for k in range(5200)]
    got = {x.doc_id: (x.n_similar, x.component_id) for x in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    number: dict = {}
    sets = [np.array(sorted({number.setdefault(g, len(number)) for g in sets_by_hand(t)})) for _, t in rows[:5200]]
    many = np.zeros((5200, len(number)), np.float32)
    for k, s in enumerate(sets):
        many[k, s] = 1
    size = many.sum(1)
    near = np.zeros(5200, int)
    for k in range(0, 5200, 400):
        c = many[k : k + 400] @ many.T
        near[k : k + 400] = (100 * c >= 60 * (size[k : k + 400, None] + size[None, :] - c)).sum(1) - 1
    assert [got[k][0] for k in range(5200)] == near.tolist() and {got[k][1] for k in range(5200)} == {0}
    assert all(got[10_000 + k] == (0, 10_000 + k) for k in range(5200))


def test_region_join_divides_unrelated_clusters():
    r = np.random.default_rng(3)
    base = [np.unique(r.integers(0, 1 << 40, 60)).astype(np.uint64) for _ in range(12)]
    sets = [np.unique(np.r_[b[r.permutation(len(b))[:55]], r.integers(0, 1 << 40, 3).astype(np.uint64)]) for b in base for _ in range(20)]
    done = {"divided": 0, "bounds": 0, "compared": 0}
    x, _ = jaccard.region_join(sets, done=done)
    assert len(x) == 12 * 190 and done["divided"] == 240 and done["compared"] + done["bounds"] < 240 * 239 / 2 / 3


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_jaccard_join_with_and_without_broadcast_members(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard, "BROADCAST_MEMBERS", most)
    monkeypatch.setattr(jaccard, "LABELLED", most)
    rows = corpus(21, 9)
    got = sorted((r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == jaccard_by_hand(rows)


def test_long_texts_that_share_a_few_rare_shingles_stay_apart(spark):
    """Each text of 1,500 words shares a rarest passage of 10 words with the next, around a ring, and others with two texts each; none are linked."""
    many, r = 60, random.Random(6)
    pieces = [p for p in range(many * 148 // 3) for _ in range(3)]
    r.shuffle(pieces)
    texts = [pieces[k::many] + [many * 1000 + k, many * 1000 + (k + 1) % many] for k in range(many)]
    rows = [(k, " ".join(f"p{p}x{i}" for p in t for i in range(10))) for k, t in enumerate(texts)]
    assert all(x[2] == 0 for x in jaccard_by_hand(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    counters = spark.sparkContext.broadcast(jaccard.shingle_counters(docs))
    met = jaccard.meetings(jaccard.replicas(docs, counters, 5), 5)
    assert met.count() > 0 and jaccard.edges(met).count() == 0


def test_jaccard_join_of_long_texts_at_the_threshold(spark):
    """Pairs at and just below the threshold: the part of a long text, and equal lengths; what a pair shares is common, what it doesn't is rare."""
    rows = []
    for g, n in enumerate((100, 333, 700, 2000, 9000)):
        base = [f"g{g}x{i}" for i in range(n + 1)]
        part, half = -(-n * 6 // 10), n * 3 // 4
        for words in (base, base[: part + 1], base[:part], base[n - part :], base[: half + 1] + [f"r{g}x{i}" for i in range(n - half)], base[:half] + [f"s{g}x{i}" for i in range(n - half + 1)]):
            rows.append((len(rows), " ".join(words)))
    for most in (3, 40):
        got = sorted((r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(most)).collect())
        assert got == jaccard_by_hand(rows) and len({x[2] for x in got}) > 2


def test_packed_sets_take_11_bytes_each():
    """Whatever the numbers, at the ends of what 2 bytes and 1 hold too."""
    r = np.random.default_rng(2)
    size, many = r.integers(1, 300, 1000), r.integers(1, 9, 1000)
    sig = r.integers(1, 1 << 62, 1000)
    assert len(jaccard.pack_sets(sig, size, many)) == 11_004
    size[[1, 5, 7]], many[[0, 5, 9, 11]] = (65534, 65535, 4_000_000_000), (254, 255, 256, 70_000)
    for n in (0, 1, 6, 1000):
        for got, want in zip(jaccard.unpack_sets(jaccard.pack_sets(sig[:n], size[:n], many[:n])), (sig, size, many)):
            assert got.tolist() == want[:n].tolist()


def test_jaccard_sql_agrees_with_brute_force():
    rows = [r for r in corpus(2, 6)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.execute(jaccard.OP3_SQL).fetchall()) == jaccard_by_hand(rows)


def test_word_hashes_depend_on_the_word_alone():
    texts = [b"the cat", b"", b"A the\ncat  CAT", b"x" * 5000]
    runs = [(a, h, at) for a, h, at in word_hashes(texts)]
    h, at = runs[0][1], runs[0][2]
    assert np.diff(at).tolist() == [2, 0, 4, 1] and h[0] == h[3] and h[1] == h[4] == h[5] and len(set(h.tolist())) == 4
    assert len(shingles(h[:0])) == 0 and len(shingles(h[:1])) == 1 and len(shingles(h[:2])) == 1


def test_leaks_are_found_and_clean_documents_left(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(3000)] + ["the", "of"] * 300
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [words(n) for n in (15, 30, 45, 60)]
    docs, want = [], set()
    for k in range(120):
        text = words(r.choice([20, 300, 900]))
        if k % 4 == 0:
            i = k // 4 % 4
            leak = list(items[i])
            if k % 8 == 0:  # a paraphrase: some words replaced
                for _ in range(len(leak) // 8):
                    leak[r.randrange(len(leak))] = r.choice(vocabulary)
            at = r.randrange(len(text))
            text[at:at] = leak
            want.add((k, i))
        docs.append((k, (", ".join(text)).upper() if k % 3 == 0 else " ".join(text)))
    df = spark.createDataFrame([*docs, (500, None), (501, ""), (0, docs[0][1])], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(9, None), (10, "!!"), (None, "x")], "item_id long, text string")
    rows = decontam.find_items(df, bench).collect()
    assert {(x.doc_id, x.item_id) for x in rows} == want and len(rows) == len(want)
    assert decontam.find_items(df.limit(0), bench).count() == 0 and decontam.find_items(df, bench.limit(0)).count() == 0


def test_paraphrases_are_found_up_to_the_share(spark):
    """Rare words replaced, answer words kept: whatever keeps SHARE of the item in order is found."""
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7))) for _ in range(4000)]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    words = lambda n: r.choices(vocabulary, weights, k=n)
    plain = [(k, words(r.choice([100, 300]))) for k in range(300)]
    items = [words(r.choice([20, 35, 60])) for _ in range(30)]
    freq, n, _ = decontam.document_frequencies(spark.createDataFrame([(k, " ".join(t)) for k, t in plain], "doc_id long, text string"))
    idf = np.log((n + 1) / (freq + 1)) + 1e-3
    docs, want = list(plain), set()
    for i, item in enumerate(items):
        (_, h, _), = decontam.sequences([" ".join(item)])
        rank = np.argsort(-idf[decontam.bucket(h)], kind="stable")
        answers = list(dict.fromkeys(h[rank].tolist()))[: 2 * decontam.ANSWERS]
        free = [j for j in rank.tolist() if h[j] not in answers]
        for share in (0.2, 0.3, 0.4):
            leak = list(item)
            for j in free[: int(share * len(item) + 1e-9)]:
                leak[j] = r.choice(vocabulary)
            text = words(200)
            at = r.randrange(len(text))
            docs.append((len(docs), text[:at] + leak + text[at:]))
            want.add((len(docs) - 1, i))
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontam.find_items(df, bench).collect()} == want


def _made(seed=5, documents=600):
    """(word hashes of documents over a Zipf vocabulary, a space of them, counts, the generator)."""
    r = np.random.default_rng(seed)
    vocabulary = r.integers(0, 1 << 63, 6000).astype(np.uint64) * np.uint64(2)
    share = 1 / np.arange(10, 6010)
    draw = lambda n: r.choice(vocabulary, n, p=share / share.sum())
    texts = [draw(int(r.integers(60, 700))) for _ in range(documents)]
    counts, df = np.zeros(decontam.VOCABULARY), np.zeros(decontam.VOCABULARY)
    for t in texts:
        counts += np.bincount(decontam.bucket(t), minlength=decontam.VOCABULARY)
        df[np.unique(decontam.bucket(t))] += 1
    idf = np.log((documents + 1) / (df + 1)) + 1e-3
    y = np.concatenate([decontam.sketched(decontam.bucket(t[k : k + 64]), np.zeros(len(t[k : k + 64]), int), idf[decontam.bucket(t[k : k + 64])], 1, decontam._places()) for t in texts for k in range(0, len(t), 64)])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    value, vector = np.linalg.eigh((y - y.mean(0)).T @ (y - y.mean(0)))
    some = np.argsort(-value)[: decontam.RANK]
    return texts, decontam.Space(idf, vector[:, some], counts), counts, draw, r


def test_paraphrases_are_retrieved_by_the_cosine():
    """Items of 15 to 400 words, 35 % of the words replaced at random places, others inserted up to 1.5 times the length: at least
    0.9 are found, and the cosine leaves 95 % of all (passage, item) pairs of this corpus, whose words are few and skewed."""
    texts, space, counts, draw, r = _made()
    words = [draw(n) for n in (15, 20, 30, 45, 60, 120, 200, 400) for _ in range(8)]
    items = decontam.Items(list(range(len(words))), words, space, counts)
    found = {n: [] for n in (15, 20, 30, 45, 60, 120, 200, 400)}
    for k, w in enumerate(words):
        n = len(w)
        for _ in range(5):
            leak = w.copy()
            leak[r.permutation(n)[: int(0.35 * n)]] = draw(int(0.35 * n))
            leak = np.insert(leak, np.sort(r.integers(1, n, int(0.5 * n))), draw(int(0.5 * n)))
            h = np.concatenate([draw(int(r.integers(0, 300))), leak, draw(int(r.integers(0, 300)))])
            found[n].append(any(i == k for _, i, *_ in items.search(h, np.array([0, len(h)]), decontam._places())))
    for n, hits in found.items():
        assert np.mean(hits) >= 0.85, (n, np.mean(hits))
    assert np.mean(sum(found.values(), [])) >= 0.9
    h = np.concatenate(texts[:200])
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts[:200]])])
    passing = sum(len(c) for _, _, c, _, _ in items.candidates(h, at, decontam._places()))
    assert passing < 0.05 * len(words) * len(decontam._starts(at, decontam.BLOCK)[0])


def test_candidates_equal_brute_force_on_all_passages(monkeypatch):
    """Runs of few blocks and few items at once give the passages that a loop over all of them gives."""
    texts, space, counts, draw, r = _made(7, 60)
    words = [draw(n) for n in (15, 40, 90)]
    monkeypatch.setattr(decontam, "RUN", 16)
    monkeypatch.setattr(decontam, "SIDE", 2)
    items = decontam.Items([1, 2, 3], words, space, counts)
    h = np.concatenate(texts[:12])
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts[:12]])])
    got = {(int(k), int(a), int(z)) for k, _, _, first, end in items.candidates(h, at, decontam._places()) for a, z in zip(first, end)}
    want, close = set(), set()
    for t in range(12):
        for k in range(3):
            wide = items.blocks[k] * decontam.BLOCK
            for a in range(at[t], max(at[t] + 1, at[t + 1] - (at[t + 1] - at[t] - 1) % decontam.BLOCK - wide + decontam.BLOCK), decontam.BLOCK):
                z = min(at[t + 1], a + wide)
                v = space.words(decontam.bucket(h[a:z])).sum(0)
                c = v @ items.vector[k] / np.linalg.norm(v)
                (want if c >= items.threshold[k] else set()).add((k, int(a), int(z)))
                if abs(c - items.threshold[k]) < 1e-4:
                    close.add((k, int(a), int(z)))
    assert want and got - close == want - close


@pytest.mark.parametrize("rank", [0, 40, 384, 512])
def test_latent_lengths_equal_those_of_projected_sums(monkeypatch, rank):
    """In the space or by the directions left out, whichever are fewer, and in tiles."""
    monkeypatch.setattr(decontam, "TILE", 7)
    r = np.random.default_rng(rank)
    turn = np.linalg.qr(r.normal(size=(decontam.SKETCH, decontam.SKETCH)))[0][:, :rank]
    space = decontam.Space(np.ones(decontam.VOCABULARY), turn, np.ones(decontam.VOCABULARY))
    assert space.narrow.shape[1] == min(rank, decontam.SKETCH - rank)
    y = r.normal(size=(40, decontam.SKETCH)).astype(np.float32)
    for wide, got in space.lengths(y, 33, [1, 3, 4, 12]).items():
        want = [float(((y[k : k + wide].sum(0) @ turn) ** 2).sum()) for k in range(33)]
        assert np.allclose(got, want, rtol=1e-4, atol=1e-6 * decontam.SKETCH)


def test_longest_common_subsequence_by_brute_force():
    r = random.Random(2)
    for _ in range(300):
        a, b = [r.randrange(6) for _ in range(r.randint(1, 12))], [r.randrange(6) for _ in range(r.randint(0, 14))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert decontam.lcs_within(a, b, 100)[0] == t[-1][-1]


def test_latent_space_is_the_exact_one_of_the_sketch(spark):
    r = random.Random(3)
    topics = [["".join(r.choice("abcdef") for _ in range(5)) for _ in range(30)] for _ in range(6)]
    rows = [(k, " ".join(r.choice(topics[k % 6]) for _ in range(64))) for k in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    freq, n, counts = decontam.document_frequencies(df)
    idf = np.log((n + 1) / (freq + 1)) + 1e-3
    space = decontam.latent_space(df, idf, counts)
    y = []
    for _, t in rows:
        (_, h, _), = decontam.sequences([t])
        word = decontam.bucket(h)
        w = idf[word] / np.linalg.norm(idf[word])
        y.append(decontam.sketched(word, np.zeros(len(word), int), w, 1, decontam._places())[0])
    y = np.array(y)
    u, s, vt = np.linalg.svd(y - y.mean(0), full_matrices=False)
    assert n == 240 and counts.sum() == 240 * 64
    turned = (y - y.mean(0)) @ space.turn
    assert np.allclose(np.abs(np.sum(turned[:, :5] * u[:, :5], axis=0)), s[:5], rtol=1e-2)
    # passages of one topic lie together
    cos = (turned[:, :5] / np.linalg.norm(turned[:, :5], axis=1, keepdims=True)) @ (turned[:, :5] / np.linalg.norm(turned[:, :5], axis=1, keepdims=True)).T
    same = np.arange(240)[:, None] % 6 == np.arange(240)[None, :] % 6
    assert cos[same].min() > cos[~same].max()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy</div>
<article><h1>A &amp; B</h1><p><b>One   two&nbsp;x<br><p>Three<br>four <i>f</i>ive.</p><div class="share-buttons">Share</div><ul><li>x<li>y</ul><table><tr><td>1<td>2</table><aside>Side</aside><form>Q</form><section class="comments"><p>First!</p></section></article><footer>&copy; F</footer></body></html>"""


def test_main_text():
    assert html_main.extract(PAGE) == "A & B\nOne two x\nThree four five.\nx\ny\n1\n2"
    assert html_main.extract("<p>a<p>b &am") == "a\nb &am"
    assert html_main.extract("<div><p>q &lt;p&gt; &#233;</div><!-- <p>no</p> -->") == "q <p> é"
    for odd in (None, "", "<", "<p", "<a href='x", "</p></article>", "<!--", "<script>", "plain", "<p>a\0b"):
        html_main.extract(odd)
    assert html_main.extract("<main><p>in</p></main><p>out</p>") == "in"


@pytest.mark.parametrize("page, text", [
    ('<body><p class="notice">Old site<p>article one<p>two</body>', "article one\ntwo"),
    ('<ul><li class="share">Send it<li>first<li>second</ul><p>end', "first\nsecond\nend"),
    ('<table><tr><td class="ad">Buy<td>cell<tr><td>next</table>tail', "cell\nnext\ntail"),
    ('<table><tr class="ad"><td>Buy<tr><td>next</table>tail', "next\ntail"),
    ('<table><tbody class="ad"><tr><td>Buy<tbody><tr><td>next</table>tail', "next\ntail"),
    ('<dl><dt class="ad">Buy<dd>meaning</dl>', "meaning"),
    ('<body><section><p>a</p><div class="ad">Buy</section><p>after</p></body>', "a\nafter"),
    ('<div><p>a<span class="ad">Buy<p>b</div>c', "a\nb\nc"),
    ('<p>a<button><p>Go</p></button>b', "a b"),
    ('<ul><li>a<nav><li>Home</nav> b<li>c</ul>', "a\nb\nc"),
    ('<div class="ad"><div>x</div><div/><script>"</div>"</script>y</div><p>z', "z"),
    ('<div class="ad"><p>x<p>y</div>z', "z"),
])
def test_dropped_elements_end_as_others_do(page, text):
    assert html_main.extract(page) == text


def test_templates_go_and_articles_stay(spark):
    pages = []
    for k in range(40):
        pages.append((k, "http://h.example/a", f"<body><div><p>Menu we show always</p></div><div><p>Text {k} here</p><p>More {k}</p></div></body>"))
        pages.append((100 + k, f"http://copies.example/{k}", "<body><div><p>Menu we show always</p></div><div><p>one article</p></div></body>"))
    pages += [(500, None, None), (501, "nonsense", ""), (502, "HTTP://H.example:80/x", "<p>Menu we show always</p><p>z</p>"), (0, pages[0][1], pages[0][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4).withColumns({"host": F.lit(1), "text": F.lit(2)})
    for limit in (1000, 0):  # by broadcast, and by join
        got = {r.page_id: r.text for r in html_main.main_texts(df, broadcast_rows=limit).collect()}
        assert got[7] == "Text 7 here\nMore 7" and got[502] == "z" and got[500] == got[501] == ""
        assert got[103] == "Menu we show always\none article"  # copies of one page are no template
    assert html_main.main_texts(df.limit(0)).count() == 0


def test_no_class_word_removes_the_wrapper_of_the_main_text():
    assert html_main.extract('<div class="layout with-sidebar"><div class="sidebar">s</div><article><p>The text</p></article></div>') == "The text"
    assert html_main.extract('<div class="sidebar-left"><h1>T</h1><p>The long text of the page</p><div class="sidebar">s</div></div><div class="ad">Buy</div>') == "T\nThe long text of the page"
    assert html_main.extract('<div class="widget"><p>All there is</p></div>') == "All there is"
    assert html_main.extract("<article>teaser</article><div>main story</div>") == "teaser\nmain story"


def test_deep_pages_take_linear_time():
    for page in ("<b>" * 50_000 + "</i>" * 50_000, "<b>" * 50_000 + "<h1>x</h1>" * 20_000, "<div>" * 50_000 + "x" + "</div>" * 50_000, "<b><article>" + "<i>" * 20_000 + "</b>" * 20_000, '<div class="ad">' * 20_000 + "x"):
        began = time.process_time()
        html_main.extract(page)
        assert time.process_time() - began < 3


def test_templates_by_counts_alone(spark):
    """Pages without an article or a telling name: a fixed menu, a notice and an advert whose words change, on 12 pages a host."""
    r = random.Random(2)
    words = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows, want = [], {}
    for host in range(3):
        for k in range(12):
            text = [words(r.randint(15, 40)) for _ in range(r.randint(3, 6))]
            page = f'<body><div class="k1"><ul><li>Home<li>News{host}</ul></div><section class="k2">{words(4)}</section><div class="k3"><h2>{text[0]}</h2>{"".join(f"<p>{t}" for t in text[1:])}</div><section class="k4"><p>{words(3)}<p>All rights</section></body>'
            rows.append((len(rows), f"http://h{host}.example/{k}", page))
            want[len(rows) - 1] = "\n".join(text)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for limit in (1000, 0):
        assert {x.page_id: x.text for x in html_main.main_texts(df, broadcast_rows=limit).collect()} == want
    # the counts by brute force
    pages: dict = {}
    for _, url, page in rows:
        w = html_main.Walk(page)
        host = url.split("/")[2]
        context = w.main_text()
        for x in (x for x in w.nodes if x.exact and not x.inside):
            pages.setdefault((host, 0, x.exact), set()).add(context)
            pages.setdefault((host, "layout", x.layout), set()).add(context)
        for f in w.candidates():
            pages.setdefault((host, 1, f), set()).add(context)
    layout = {(url.split("/")[2], x.exact): x.layout for _, url, page in rows for x in html_main.Walk(page).nodes}
    brute = {(h, k, f) for (h, k, f), c in pages.items() if k != "layout" and len(c) >= html_main.MIN_PAGES and (k == 1 or len(c) >= html_main.SHARE * len(pages[h, "layout", layout[h, f]]))}
    found = html_main.find_templates(df.select(F.regexp_extract("url", "//([^/]*)", 1).alias("host"), "html")).collect()
    assert {(x.host, x.kind, x.subtree) for x in found} == brute and len(found) == len(brute)


@pytest.mark.parametrize("others", [20, 400])
def test_templates_of_one_section_go_at_every_size(spark, others):
    """A neutral menu and notice on 10 pages of a host; sentences that articles share stay."""
    said = "A sentence that some articles share."
    page = lambda k, top="": f'<body>{top}<div class="text"><p>Text {k} here</p>{f"<p>{said}</p>" if k % 10 == 0 else ""}<p>More {k}</p></div></body>'
    top = '<div class="k1"><ul><li>One<li>Two</ul></div><p class="k2">Closed on Monday</p>'
    rows = [(k, f"http://h.example/s/{k}", page(k, top)) for k in range(1, 11)] + [(k, f"http://h.example/{k}", page(k)) for k in range(11, 11 + others)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for limit in (1000, 0):
        got = {r.page_id: r.text for r in html_main.main_texts(df, broadcast_rows=limit).collect()}
        assert all(got[k] == "\n".join([f"Text {k} here", *[said] * (k % 10 == 0), f"More {k}"]) for k, *_ in rows)


def test_ogg_round_trip_and_damage():
    def slow(b):
        c = 0
        for x in b:
            c ^= x << 24
            for _ in range(8):
                c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        return c

    for n in (0, 1, 575, 576, 577, 60_000, 200_000):
        size, payload = ogg.payload_of("é" * (n // 2) + "x" * (n % 2))
        raw = ogg.write_ogg(payload)
        back, feature = ogg.features(raw)
        assert size == n and back == payload and len(payload) % 576 == 0 and len(payload) >= max(576, n)
        for serial, number, flags, granule, lacing, body in ogg.read_pages(raw):
            assert sum(lacing) == len(body)
        streams = ogg.read_ogg(raw)
        assert set(streams) == {ogg.SAMPLES, ogg.MARKS} and ogg.packet_times(streams[ogg.SAMPLES][1:])[-1] == len(payload) / ogg.RATE
    assert ogg.page_crc(raw[:200]) == slow(raw[:200])
    for at in (3, 30, len(raw) // 2, len(raw) - 1):
        with pytest.raises(ValueError):
            ogg.read_ogg(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :])
    with pytest.raises(ValueError):
        ogg.read_ogg(raw[: len(raw) // 2])


def test_ogg_packets_across_pages():
    packets = [(b"h", 0), (b"a" * 255, 1), (b"", 2), (bytes(range(256)) * 300, 3), (b"z" * 510, 4)]
    for segments in (1, 3, 255):
        raw = b"".join(p for _, p in ogg.stream_pages(5, packets, segments))
        assert [p for p, _ in ogg.read_ogg(raw)[5]] == [p for p, _ in packets]


def test_ogg_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "y" * 3000), (3, "y" * 3000)], "doc_id long, text string").withColumn("media", F.lit("clash"))
    rows = ogg.decode_media(ogg.encode_media(df)).collect()
    assert [r.n_bytes for r in rows] == [0, 0, 1, 3000, 3000] and rows[3][1:] == rows[4][1:] and rows[0][1:] == rows[1][1:]
    assert rows[2].payload_sha256 == hashlib.sha256(b"x" + b"\xff" * 575).hexdigest() and ogg.decode_media(ogg.encode_media(df.limit(0))).count() == 0


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 900
    rows = [(1, "http://a/ b", big), (5, "http://a/2", big), (3, None, big), (7, "http://c", "<p>small"), (8, "http://c", "<p>small"), (9, "u", None), (None, "v", big), (5, "http://a/2", big), (11, "w", "q" * 999), (12, "w", "q" * 999), (13, "w", "r" * 1000), (14, "w", "r" * 1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumn("refers_to", F.lit("clash"))
    manifest = warc.write_archives(df, work_folder(spark, "w"))
    records = warc.read_records(manifest, 3, with_payload=True)
    assert records.count() == 3 * len(rows)
    captures = warc.assemble(records).collect()
    assert len(captures) == len(rows) and all(c.request and c.metadata and c.response for c in captures)
    got = sorted((c.response.page_id or 0, c.response.kind, c.response.refers_to, c.response.payload_bytes) for c in captures)
    want = [(0, "response", None), (1, "revisit", 5), (3, "revisit", 5), (5, "response", None), (5, "response", None), (7, "response", None), (8, "response", None), (9, "response", None), (11, "response", None), (12, "response", None), (13, "revisit", 14), (14, "response", None)]
    assert [g[:3] for g in got] == want and got[0][3] == 1803
    full = next(c.response for c in captures if c.response.page_id == 7)
    assert bytes(full.payload) == b"<p>small" and full.payload_digest == hashlib.sha1(b"<p>small").hexdigest()
    assert {c.response.url for c in captures if c.response.page_id == 3} == {None}
    assert warc.read_records(warc.write_archives(df.limit(0), work_folder(spark, "w")), 1).count() == 0


def test_payloads_of_one_page_id_are_told_apart(spark):
    rows = [(1, "u", "a" * 1000), (1, "u", "b" * 1000), (1, "u", "c" * 1500), (9, "v", "a" * 1000), (8, "w", "b" * 1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    captures = warc.assemble(warc.read_records(warc.write_archives(df, work_folder(spark, "w")), 1)).collect()
    got = sorted((c.response.page_id, c.response.payload_digest, c.response.kind, c.response.refers_to) for c in captures)
    digest = lambda c, n: hashlib.sha1(c * n).hexdigest()
    assert got == sorted([(1, digest(b"a", 1000), "revisit", 9), (1, digest(b"b", 1000), "revisit", 8), (1, digest(b"c", 1500), "response", None), (9, digest(b"a", 1000), "response", None), (8, digest(b"b", 1000), "response", None)], key=lambda r: r[:2])


def test_damaged_archives_are_refused():
    raw = warc.capture(1, "u", b"x" * 100, None)
    assert [h["warc-type"] for h, _ in warc.parse(raw)] == ["response", "request", "metadata"] or len(list(warc.parse(raw))) == 3
    with pytest.raises(Exception):
        list(warc.parse(raw[:-5]))
