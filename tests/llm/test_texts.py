"""Toxicity, language identification, PII, SentencePiece and token files: brute force, round trips, held-out accuracy, odd input."""

import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from windrill.llm import langid, pii, piece, spans, token_file, toxicity, wordbpe
from windrill.llm.shared import work_folder

SF = "/root/testdata/sf0.01"
WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a", "it's we'll don'tx 'sabc !'s ''s 'LL", "<|endoftext|> a<|startoftext|>b <s> </s> <0x0A>", "İstanbul ŒUVRE ﬁ éx", "a b　c\x1cd\x85e​f", "x" * 300, "日本語 한국 ١٢٣ ½ ² 🙂", "a\x00b", "▁x ▁▁ y", " " * 40 + "z" + " " * 9, "A" * 5000 + " b" * 3000, "\r\n\t"]
# clashing names of further columns must not matter
EXTRA = {"score": "x", "lang_pred": 1, "n": 2, "spans": 3, "ids": 4, "start": 5, "part": 6}


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "en", "s") for k, t in enumerate(ODD)] + [(100, None, None, None), (None, "no id 5", "de", None), (3, ODD[3], "en", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({k: F.lit(v) for k, v in EXTRA.items()})


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_word_bpe_equals_the_library():
    c = wordbpe.WordBpe(WORD_BPE)
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab'sTt1. éß-\n") for _ in range(60)) for _ in range(200)]
    at = 0
    for ids, n in c.encode(texts, 2000):
        upto = np.concatenate([[0], np.cumsum(n)])
        for k in range(len(n)):
            assert ids[upto[k] : upto[k + 1]].tolist() == c.library.encode(texts[at], add_special_tokens=False).ids, texts[at][:50]
            at += 1
    assert at == len(texts)


def test_pieces_equal_the_library_and_round_trip():
    from sentencepiece import SentencePieceProcessor

    sp, p = SentencePieceProcessor(model_file=PIECES), piece.Pieces(PIECES)
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("abt heinr ▁éω字\n") for _ in range(rng.randint(0, 90))) for _ in range(300)]
    at = 0
    for ids, n in p.encode(texts, 3000):
        decoded, upto = p.decode(ids, n), np.concatenate([[0], np.cumsum(n)])
        for k in range(len(n)):
            assert ids[upto[k] : upto[k + 1]].tolist() == sp.encode(texts[at]), texts[at][:50]
            assert decoded[k] == texts[at].replace("▁", " ")
            at += 1
    assert at == len(texts)


def test_viterbi_of_a_unigram_model_is_the_best_path():
    p = piece.Pieces(PIECES)
    p.unigram = True
    rng = np.random.default_rng(1)
    p.weight = -rng.random(p.size) * 10 - 0.1
    for word in ("▁theories", "▁another", "▁banana"):
        units = spans.code_points(word).reshape(1, -1)
        out, count = p.viterbi(units)
        got = [i for i in out[0] if i >= 0][-count[0] :]
        best = [(0.0, [])] + [(-1e18, [])] * len(word)
        for i in range(1, len(word) + 1):
            for s in range(max(0, i - p.longest), i):
                k = p.id_of.get(word[s:i])
                if k is not None and best[s][0] + p.weight[k] > best[i][0]:
                    best[i] = (best[s][0] + p.weight[k], [*best[s][1], k])
        assert got == best[-1][1]


def test_pieces_of_odd_rows(spark, odd):
    rows = piece.encode_and_decode(odd, PIECES).collect()
    assert len(rows) == odd.count() and all(r.round_trip for r in rows)
    assert next(r for r in rows if r.doc_id == 100).n_pieces == 0
    back = piece.decode_table(piece.encode_table(odd.where("doc_id = 7"), PIECES), PIECES).first()
    assert back.text == ODD[7] and piece.encode_and_decode(odd.limit(0), PIECES).count() == 0


def test_variable_length_codes():
    values = np.array([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], np.uint32)
    for n in range(len(values) + 1):
        control, data = token_file.pack(values[:n])
        assert len(control) == -(-n // 4)
        back, at = token_file.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n)
        assert back.tolist() == values[:n].tolist() and at[-1] == len(data)


def test_token_files(spark, odd):
    library = wordbpe.coder(WORD_BPE).library
    token_file.PARTITION_IDS, kept = 700, token_file.PARTITION_IDS  # several range partitions
    try:
        manifest, table = token_file.write_files(odd, WORD_BPE, work_folder(spark, "t"), ids_per_file=500)
    finally:
        token_file.PARTITION_IDS = kept
    assert manifest.count() > 2
    got = sorted(map(tuple, token_file.read_documents(manifest, table, 3, with_ids=True).collect()), key=lambda r: r[1])
    texts = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for (doc, start, n, crc, ids), (want, text) in zip(got, texts):
        own = library.encode(text, add_special_tokens=False).ids + [1]
        assert (doc, start, n) == (want, at, len(own)) and list(struct.unpack(f"<{n}I", ids)) == own and crc == zlib.crc32(ids)
        at += n
    empty, table = token_file.write_files(odd.limit(0), WORD_BPE, work_folder(spark, "t"))
    assert token_file.read_documents(empty, table, 1).count() == 0


def base_brute(t):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_base_spans_are_the_patterns(documents):
    rng = random.Random(1)
    for t in ["".join(rng.choice("a.@1-+ ()29") for _ in range(rng.randint(0, 40))) for _ in range(5000)] + [r.text for r in documents.collect()]:
        assert pii.base_spans(t) == base_brute(t)
    long = "a." * 100_000 + "1" * 100_000
    assert pii.base_spans(long) == []


def test_added_spans_and_odd_rows(spark, odd):
    text = "call me (212) 555-0100 on 2024-01-05, IBAN DE89370400440532013000, +1 212 555 0100"
    ((base, every),) = pii.all_spans([text])
    assert base == [("phone", text.index("+1"), len(text))] and set(base) < set(every)
    assert {k for k, _, _ in every} >= {"account", "phone"} and not any("2024" in text[s:e] for _, s, e in every)
    assert pii.redact(text, every).endswith("[PHONE]")
    assert pii.all_spans(["", "no data here", "order 12345678"]) == [([], [])] * 3
    rows = pii.find(odd).collect()
    assert len(rows) == odd.count() and all(r.n_email == 0 for r in rows) and pii.find(odd.limit(0)).count() == 0
    assert pii.redact_table(odd).columns == odd.columns


def test_planted_personal_data_is_found(documents):
    """Spans of forms that the made-up passages don't have, put in real documents: precision and recall of what the trees add."""
    r = random.Random(12)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    forms = [
        lambda: ("e-mail ", f"kim{d(2)}.larsen (at) post{d(1)} (dot) example (dot) org"), lambda: ("mail: ", f"office [at] shop-{d(2)}.example.com"), lambda: ("call ", f"0{d(2)}-{d(3)}-{d(4)}"), lambda: ("Telefon ", f"0049 {d(3)} {d(3)} {d(4)}"),
        lambda: ('token = "', hexes(40)), lambda: ("api_key: ", hexes(32).upper()), lambda: ("password: ", f"Tiger{d(3)}!{hexes(4)}"), lambda: ("host ", ":".join(hexes(4) for _ in range(8))), lambda: ("SSN ", f"{r.randint(100, 700)}-{r.randint(10, 99)}-{d(4)}"),
    ]
    texts = [t for t in (x.text for x in documents.select("text").orderBy("doc_id").limit(600).collect()) if t and "token" not in t.lower()]
    plain = pii.all_spans(texts)
    wrong = sum(len(every) - len(base) for base, every in plain)
    planted, truth = [], []
    for t in texts:
        words = t.split(" ")
        at = r.randrange(len(words) + 1)
        cue, span = r.choice(forms)()
        head = " ".join([*words[:at], cue])
        planted.append(head + span + ("\" " if cue.endswith('"') else " ") + " ".join(words[at:]))
        truth.append((len(head), len(head) + len(span)))
    hits = sum(any(s <= a and z <= e or s < z and a < e and e - s >= 0.8 * (z - a) for _, s, e in every) for (_, every), (a, z) in zip(pii.all_spans(planted), truth))
    assert hits / len(truth) >= 0.9 and wrong <= 0.02 * len(texts), (hits, len(truth), wrong)


def test_selection_equals_brute_force():
    """Of all candidates that reach their threshold, the best free one again and again; base spans stay, what lies within one is left."""
    texts = ["mail ann@a.example.com, token = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\" tel. 030/123 4567", "card 4111 1111 1111 1111 0000 x", "call +1 (826) 555-4081 190.137.223.204, IBAN DE89 3704 0044 0532 0130 00", "password: hunter2222 write to joe at mail dot example dot com"]
    trees, curve, threshold = fitted = pii.model()
    for t, (base, every) in zip(texts, pii.all_spans(texts, fitted)):
        assert base == pii.base_spans(t)
        pool = []
        for k, s, e in pii.candidates(t):
            if not any(bs <= s and e <= be for _, bs, be in base):
                touches = any(s < be and bs < e for _, bs, be in base)
                q = float(pii.calibrated(curve, trees.score(np.array([pii.describe(t, k, s, e, touches)], float)))[0])
                if q >= threshold[k]:
                    pool.append((-q, s, pii.KINDS.index(k), e))
        chosen = []
        while pool:
            best = min(pool)
            chosen.append((pii.KINDS[best[2]], best[1], best[3]))
            pool = [x for x in pool if x[3] <= best[1] or best[3] <= x[1]]
        assert every == sorted(base + chosen, key=lambda v: (v[1], pii.KINDS.index(v[0]), v[2]))
    assert sum(len(e) - len(b) for b, e in pii.all_spans(texts, fitted)) >= 4


@pytest.mark.parametrize("address", ["JOE.DOE (AT) EXAMPLE (DOT) COM", "Joe.Doe[AT]example[DOT]com", "joe.doe At example Dot com", "joe.doe (at) example (dot) com"])
def test_spelled_out_addresses_of_any_case(address):
    text = f"WRITE TO {address}"
    ((base, every),) = pii.all_spans([text])
    assert base == [] and pii.candidates(text)
    assert pii.redact(text, every) == "WRITE TO [EMAIL]"


def test_luhn_and_isotonic():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    s, p = pii.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert list(p) == sorted(p)


def test_fold_and_lexicon():
    assert toxicity.fold("You 1d10t, $tupid mоron 1234 m0ron! 50%") == "you idiot, stupid moron 1234 moron! 50%"
    lx = toxicity.Lexicon({("idio", False): 4.0, ("trash", True): 3.0}, ["trash can"], (-3.0, 1.0, 1.0))
    assert [m[2] for m in lx.matches(toxicity.fold("1diotic trash, trashy videotrash, trash can"))] == [4.0, 3.0]
    assert lx.scores(["", "fine words", "idiot trash"]).round(3).tolist()[:2] == [0.047, 0.047] and lx.scores(["idiot trash"])[0] > 0.9


def test_toxicity_on_held_out_labels(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.op9_toxicity(spark, SF).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    clean_kept = [r.predicted for r in rows if r.toxic == 0]
    assert right > 0.93 and sum(clean_kept) <= 0.02 * len(clean_kept)


def test_toxicity_of_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    lx = toxicity.fit(odd, none, F.lit(True))
    assert lx.entries == {} and [r.score for r in toxicity.score(odd, lx).collect()] == [0.0] * odd.count()
    some = spark.createDataFrame([(1, None), (2, 1), (None, 1), (3, 0), (3, 0)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    toxicity.fit(odd, some, F.lit(True))
    kept = toxicity.drop_toxic(odd, toxicity.Lexicon({("no", True): 9.0}, curve=(-1.0, 1.0, 0.0)))
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1


def test_language_on_held_out_documents(spark, documents):
    rows = langid.op10_language_id(spark, SF).join(documents.select("doc_id", "lang", "text"), "doc_id").where("held_out and length(text) > 20").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_language_of_odd_rows(spark, odd):
    langs, protos = langid.fit(odd.where("lang is not null"))
    assert langs == ["de", "en"]
    rows = {r.doc_id: r for r in langid.identify(odd, langs, protos).collect()}
    assert len(rows) == 16 and rows[100].lang_pred == rows[0].lang_pred == rows[1].lang_pred == rows[13].lang_pred == "und" and rows[100].score == 0
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert langid.fit(odd.limit(0))[0] == [] and langid.predict_texts(["abc"], [], np.zeros((0, langid.DIM)))[0] == ["und"]


def test_trigram_counts_by_brute_force():
    texts = ["Hello, wörld! a", "", "x\0y", "12 3"]
    counts, points = langid.trigram_counts(texts)
    for k, t in enumerate(texts):
        words = re.findall(r"[^\W\d_]+", t.lower())
        s = "_" + "_".join(words) + "_" if words else ""
        want = {}
        for i in range(len(s) - 2):
            if s[i + 1] != "_":
                want[s[i : i + 3]] = want.get(s[i : i + 3], 0) + 1
        got = {"".join(chr(c) if c else "_" for c in p): int(n) for p, n in zip(points, counts[k]) if n}
        assert got == want
