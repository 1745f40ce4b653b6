"""Filter interaction audit, token alignment and language-model scores: brute force and hard rows."""

import dataclasses
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tendril.llm import attention_lm, byte_level, interaction_audit, shared_cuts
from tests.conftest import SF001
from tests.llm.conftest import HARD

JSON, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SPACE = "[^\x20\x09-\x0d]+"


def read(spark, name):
    return spark.read.parquet(f"{SF001}/{name}.parquet")


# ---- filter interaction audit ---------------------------------------------------------


def plain_audit(docs, labels):
    """By applying the filters one after the other to all documents, for every order."""
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    rows = defaultdict(list)
    for i, t, source in docs:
        t = t or ""
        w = re.findall(SPACE, t)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and i > first[t],
        }
        rows[source or ""].append((fails, i in good, i in toxic))
    out = {}
    for part, all_ in rows.items():
        removed_by = Counter()
        for order in permutations("ABCDE"):
            here, gone = list(all_), []
            for step, f in enumerate(order, 1):
                lost = [x for x in here if x[0][f]]
                here = [x for x in here if not x[0][f]]
                redundant = sum(x[0][f] for x in gone)
                gone += lost
                alone = sum(x[0][f] and sum(x[0].values()) == 1 for x in all_)
                good_lost, toxic_lost = sum(x[1] for x in lost), sum(x[2] for x in lost)
                out[part, "".join(order), step] = [len(here), len(lost), redundant, alone, good_lost, toxic_lost]
                removed_by[f] += len(lost)
        for (p, order, step), x in out.items():
            if p == part:
                x.append(removed_by[order[step - 1]])
    return {k: tuple(x) for k, x in out.items()}


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in df.collect()}


def test_audit_equals_applying_every_order(spark, make_docs):
    rnd = random.Random(5)
    texts = [
        " ".join(rnd.choice(["alpha", "BETA", "c%", "d", f"w{rnd.randint(0, 400)}"]) for _ in range(rnd.choice([3, 49, 50, 80])))
        for _ in range(40)
    ]
    rows = [(i, rnd.choice(texts), "en", rnd.choice(["x", "x", "y", None, ""])) for i in range(150)]
    rows += [(7, texts[0], "en", "x"), (None, texts[0], "en", "x"), (900, None, "en", "x"), (901, "", "en", None)]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 150, 2)] + [(4, 1, 0), (None, 1, 1)]
    got = audited(interaction_audit.audit(make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == plain_audit([(i, t, s) for i, t, _, s in rows], labels)
    assert len(got) == 600 * 3


def test_audit_on_hard_rows(spark, hard_docs, no_docs):
    labels = spark.createDataFrame([(5, 1, 1), (5, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = audited(interaction_audit.audit(hard_docs, labels))
    plain = [(r[0], r[1], (*r, None, "en", "src1")[len(r) + 2] if len(r) < 4 else r[3]) for r in HARD]
    assert got == plain_audit([(i, t, s if len(r) == 4 else "src1") for (i, t, s), r in zip(plain, HARD)], [(5, 1, 1)])
    assert interaction_audit.audit(no_docs, labels).count() == 0


def test_packed_counters_do_not_run_over():
    n = (1 << 62) // 5
    total = interaction_audit.packed(0b1100101) * n + interaction_audit.packed(0b0011111) * n
    want = (interaction_audit.outcomes(0b1100101) + interaction_audit.outcomes(0b0011111)).astype(object) * n
    assert (interaction_audit.unpacked(total).astype(object) == want).all()


# ---- alignment --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoders():
    a = Tokenizer.from_file(JSON)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    bytes_a = {i: raw for raw, i in byte_level.vocabulary(JSON).items()}
    return a, b, bytes_a, shared_cuts.piece_bytes(b)


def plain_tokens(text, encoders):
    """Ids of both sides, or none, by the libraries on the whole text."""
    a, b, bytes_a, bytes_b = encoders
    if not text:
        return [], []
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw = (" " + text).encode()
    same = b"".join(bytes_a.get(i, b"?") for i in x) == raw and b"".join(bytes_b[i] for i in y) == raw
    return (x, y) if same else ([], [])


def plain_alignment(text, encoders):
    """Groups and links from all byte offsets."""
    _, _, bytes_a, bytes_b = encoders
    x, y = plain_tokens(text, encoders)
    ends_a, ends_b = np.cumsum([len(bytes_a[i]) for i in x]), np.cumsum([len(bytes_b[i]) for i in y])
    common, groups, i, j = sorted(set(ends_a.tolist()) & set(ends_b.tolist())), [], 0, 0
    for c in common:
        k, m = int(np.searchsorted(ends_a, c)) + 1, int(np.searchsorted(ends_b, c)) + 1
        groups.append((x[i:k], y[j:m]))
        i, j = k, m
    links = []
    for gx, gy in groups:
        at = 0
        for p in gx:
            to, bt = at + len(bytes_a[p]), 0
            for q in gy:
                if at < bt + len(bytes_b[q]) and bt < to:
                    links.append((p, q))
                bt += len(bytes_b[q])
            at = to
    return x, y, groups, links


def plain_digests(texts, encoders):
    all_ = [plain_alignment(t, encoders) for t in texts]
    n = Counter(p for *_, links in all_ for p in set(links))
    most = defaultdict(int)
    for (p, _), c in n.items():
        most[p] = max(most[p], c)
    out = []
    for x, y, groups, links in all_:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        best = sum(n[p] == most[p[0]] for p in links)
        out.append((len(x), len(y), len(groups), len(links), best, sum(n[p] for p in links), sha))
    return out


ODD = ["", " ", "  two  spaces ", "a\n b", "tab\t x", "▁piece", "<|endoftext|> x", "<s> </s> <unk>", "É è ﬁ １２", "漢字 かな",
       "😀 👩‍👧 x", "a\x00b", "\x1c y", "don't we'll I'M", "x" * 3000, "ab " * 500, "  nbsp", "​ zw", "1234567 89", "\x85 n", "é f"]


def test_units_encode_as_whole_texts(encoders):
    rnd, units = random.Random(2), shared_cuts.Units(JSON, PIECES)
    letters = [chr(c) for c in range(0x250)] + list("漢😀▁​　ﬁก") + [" "] * 300 + list("etaoins") * 40
    texts = ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(4000)]
    for i in range(0, len(texts), 500):
        x = shared_cuts.aligned(units, texts[i : i + 500])
        a, b = np.split(x["a"], np.cumsum(x["n_a"])), np.split(x["b"], np.cumsum(x["n_b"]))
        for t, got_a, got_b in zip(texts[i : i + 500], a, b):
            assert (got_a.tolist(), got_b.tolist()) == tuple(map(list, plain_tokens(t, encoders))), repr(t)


def test_shared_cuts_find_every_common_end():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 1000, 20_000):
        for share in (0.0, 0.01, 0.5, 1.0):
            ends = np.sort(rnd.choice(10 * n, n, replace=False)) + 1
            other = np.unique(np.append(np.where(rnd.random(n) < share, ends, ends * 10 * n + 7)[:-1] % (10 * n), ends[-1]))
            got = shared_cuts.shared_cuts(ends, other[other <= ends[-1]], np.array([0]), np.array([n]))
            assert (ends[got - 1] == np.intersect1d(ends, other)).all()


@pytest.mark.parametrize("hot", [0, 50, shared_cuts.HOT_PAIRS])
def test_alignment_equals_brute_force(spark, make_docs, encoders, hot):
    texts = [r["text"] for r in read(spark, "documents").select("text").collect()] + ODD + [None, "same text", "same text"]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = shared_cuts.alignment_digests(make_docs(rows).repartition(5), JSON, PIECES, hot)
    got = {r["doc_id"]: tuple(r)[1:] for r in df.collect()}
    assert [got[i] for i in range(len(texts))] == plain_digests(texts, encoders)


def test_alignment_on_hard_rows(hard_docs, no_docs, encoders):
    got = sorted(map(tuple, (r[1:] for r in shared_cuts.alignment_digests(hard_docs, JSON, PIECES).collect())))
    assert got == sorted(plain_digests([r[1] for r in HARD], encoders))
    assert shared_cuts.alignment_digests(no_docs, JSON, PIECES).count() == 0


def test_groups_of_a_text(make_docs, encoders):
    (r,) = shared_cuts.alignments(make_docs([(1, "tokenizers overlap, twice")]), JSON, PIECES).collect()
    assert [(list(g["a"]), list(g["b"])) for g in r["groups"]] == plain_alignment("tokenizers overlap, twice", encoders)[2]


# ---- language model ---------------------------------------------------------------------


def plain_words(t):
    return [w.encode() for w in re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]


def plain_base(rows):
    counts, n_docs = Counter(), 0
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(plain_words(t))
            n_docs += 1
    n, v = sum(counts.values()) + n_docs, len(counts) + (n_docs > 0)
    out = []
    for i, t in rows:
        c = [counts[w] for w in plain_words(t)] + [n_docs]
        score = sum(math.log10((x + 1) / (n + v + 1)) for x in c)
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(c), sum(x > 0 for x in c), n, score))
    return out


def plain_log10(model, words, text):
    """One id at a time: a plain forward pass over the ids that its window lets it see."""
    ids = [i for w in plain_words(text) for i in words.encode([w])[0]] + [model.end]
    before, total = [model.end, *ids[:-1]], 0.0
    for t, i in enumerate(ids):
        slot = t % attention_lm.STEP
        start = max(0, t - slot - attention_lm.CONTEXT)
        seen = np.array(before[start : t + 1])
        far = model.near[slot, : attention_lm.CONTEXT + slot + 1][-len(seen) :]
        a = np.maximum(model.key[seen].astype(float) @ model.query[before[t]] + far, attention_lm.LEAST) ** attention_lm.POWER
        h = (a / a.sum()) @ model.value[seen] + model.embed[before[t]]
        z = np.maximum(h @ model.out, attention_lm.LEAST) ** attention_lm.POWER
        total += math.log(z[model.class_of[i]] / z.sum()) + model.within[i]
    return total / math.log(10)


@pytest.mark.parametrize("hot", [0, 20, attention_lm.HOT_WORDS])
def test_base_scores_equal_brute_force(make_docs, hot):
    long = "y" * 200
    rows = [(i, t) for i, t, *_ in HARD] + [(100 + i, f"the the cat {long} {i} {'the ' * (i % 5)}{'Only' * (i % 3)}") for i in range(40)]
    docs = make_docs(rows).repartition(4)
    fitted = attention_lm.fit(docs.where(~attention_lm.held_out(docs["doc_id"])), JSON)
    got = attention_lm.score(docs, fitted, JSON, hot).collect()
    want = plain_base(rows)
    assert fitted.train_tokens == want[0][4]
    key = lambda r: (r[0] is None, r[0], r[1])
    pairs = list(zip(sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"]) for r in got), key=key),
                     sorted(((r[0], r[2], r[3], r[5]) for r in want), key=key)))
    assert len(pairs) == len(rows)
    for g, w in pairs:
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], abs=1e-6)


def test_model_scores_equal_one_id_at_a_time(spark, make_docs):
    docs = read(spark, "documents")
    fitted = attention_lm.fit(docs, JSON)
    words = attention_lm.Words(JSON)
    texts = ["", "one", " ".join(f"word{i}" for i in range(16)), "the end of " * 100, "Größe 漢字 😀"]
    texts += [r["text"] for r in docs.orderBy("doc_id").limit(5).collect()]
    got = {r["doc_id"]: r["score"] for r in attention_lm.score(make_docs(list(enumerate(texts))), fitted, JSON).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain_log10(fitted.model, words, t), rel=1e-4, abs=1e-3)


def test_every_id_is_scored_once_with_its_context():
    rnd = np.random.default_rng(3)
    sizes = rnd.integers(1, 200, 50)
    ids = rnd.integers(0, 1000, sizes.sum()).astype(np.int32)
    inputs, nexts, n = attention_lm.windows_of(ids, sizes, 1000)
    assert (nexts[nexts >= 0] == ids).all() and n.sum() == len(inputs)
    at = 0
    for text, k in zip(np.split(ids, np.cumsum(sizes)[:-1]), n):
        before = np.concatenate([[1000], text[:-1]])
        for w in range(k):
            start = w * attention_lm.STEP - attention_lm.CONTEXT
            seen = [before[p] if 0 <= p < len(before) else 1001 for p in range(start, start + attention_lm.SPAN)]
            assert inputs[at + w].tolist() == seen
        at += k


def test_model_is_a_distribution_and_uses_its_context():
    rnd = np.random.default_rng(4)
    follows = rnd.permutation(50)
    ids = np.empty((400, attention_lm.STEP), np.int64)
    ids[:, 0] = rnd.integers(0, 50, 400)
    for k in range(1, attention_lm.STEP):
        ids[:, k] = np.where(rnd.random(400) < 0.9, follows[ids[:, k - 1]], rnd.integers(0, 50, 400))
    inputs, nexts, _ = attention_lm.windows_of(ids.ravel(), np.full(400, attention_lm.STEP), 60)
    model = attention_lm.train(np.concatenate([inputs, nexts], 1)[:300], np.bincount(ids.ravel(), minlength=61))
    every = np.full((61, attention_lm.STEP), -1)
    every[:, 5] = np.arange(61)
    p = attention_lm.log_probabilities(model, np.repeat(inputs[:1], 61, 0), every)
    assert np.exp(p).sum() == pytest.approx(1, abs=1e-4)
    new = attention_lm.log_probabilities(model, inputs[300:], nexts[300:]).mean() / attention_lm.STEP
    assert new > math.log(1 / 50) + 0.5  # far better than any model without context


def test_gradients_equal_differences():
    rnd = np.random.default_rng(6)
    n, d = 20, attention_lm.DIMS
    inputs, nexts, _ = attention_lm.windows_of(rnd.integers(0, n - 2, 47), np.array([40, 7]), n - 2)
    class_of, _ = attention_lm.classes(rnd.integers(0, 9, n - 1))
    shapes = {"embed": (n, d), "far": (attention_lm.SPAN,), "out": (d, attention_lm.CLASSES)} | {k: (d, d) for k in "qkv"}
    p = {k: rnd.normal(0, 0.5, s) for k, s in shapes.items()}
    p["embed"][:, -1], p["embed"][-1], p["v"][:, -1] = 1, 0, 0

    def loss():
        copy = {k: x.copy() for k, x in p.items()}
        return -attention_lm.log_probabilities(attention_lm.model_of(copy, class_of, np.zeros(n - 1)), inputs, nexts).sum() / 47

    g = attention_lm._gradients(p, np.concatenate([inputs, nexts], 1), class_of, n - 1)
    for k, x in p.items():
        for _ in range(8):
            at = tuple(rnd.integers(0, s) for s in x.shape)
            if k == "embed" and (at[0] == n - 1 or at[1] == d - 1) or k == "v" and at[1] == d - 1:
                assert g[k][at] == 0
                continue
            old = x[at]
            x[at] = old + 1e-4
            up = loss()
            x[at] = old - 1e-4
            down = loss()
            x[at] = old
            assert g[k][at] == pytest.approx((up - down) / 2e-4, rel=1e-3, abs=1e-6), (k, at)


def plain_gradients(p, windows, class_of, none):
    """All slots and classes of every window, shares and their gradients in full."""
    lm = attention_lm
    ids, nexts = windows[:, : lm.SPAN], windows[:, lm.SPAN :]
    x = p["embed"][ids]
    last = x[:, lm.CONTEXT :]
    scale = lm.DIMS**-0.5
    q, k, v = last @ p["q"] * scale, x @ p["k"], x @ p["v"]
    s = 1 + (q @ k.transpose(0, 2, 1) + p["far"][lm.FAR]) / lm.POWER
    seen = lm.BEFORE & (ids != none)[:, None, :]
    a = np.clip(s, lm.LEAST, lm.MOST) ** lm.POWER * seen
    a /= np.maximum(a.sum(-1, keepdims=True), 1e-300)
    h = last + a @ v
    t = 1 + h @ p["out"] / lm.POWER
    y = np.clip(t, lm.LEAST, lm.MOST) ** lm.POWER
    dz = y / y.sum(-1, keepdims=True) - np.eye(lm.CLASSES)[class_of[nexts]]
    dz *= (t > lm.LEAST) / np.clip(t, lm.LEAST, lm.MOST) * (nexts >= 0)[..., None] / (nexts >= 0).sum()
    dh = dz @ p["out"].T
    da = dh @ v.transpose(0, 2, 1)
    ds = a * (da - (da * a).sum(-1, keepdims=True)) * (s > lm.LEAST) / np.clip(s, lm.LEAST, lm.MOST)
    dq, dk, dv = ds @ k * scale, ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ dh
    g = {n: np.einsum("wid,wie->de", y, z) for n, y, z in [("q", last, dq), ("k", x, dk), ("v", x, dv), ("out", h, dz)]}
    g["far"] = np.array([ds[:, (lm.FAR == i) & lm.BEFORE].sum() for i in range(lm.SPAN)])
    dx = dk @ p["k"].T + dv @ p["v"].T
    dx[:, lm.CONTEXT :] += dq @ p["q"].T + dh
    g["embed"] = np.zeros_like(p["embed"])
    np.add.at(g["embed"], ids, dx)
    g["embed"][:, -1], g["embed"][none], g["v"][:, -1] = 0, 0, 0
    return g


@pytest.mark.parametrize("size", [0.4, 3.0])  # roots within their bounds, and beyond them
def test_gradients_in_parts_equal_those_of_whole_batches(size):
    rnd = np.random.default_rng(8)
    n, d = 40, attention_lm.DIMS
    sizes = rnd.integers(1, 150, 15)
    inputs, nexts, _ = attention_lm.windows_of(rnd.integers(0, n - 2, sizes.sum()), sizes, n - 2)
    windows = np.concatenate([inputs, nexts], 1)
    assert len(windows) > 2 * attention_lm.PART_WINDOWS and len(windows) % attention_lm.PART_WINDOWS
    class_of, _ = attention_lm.classes(rnd.integers(0, 9, n - 1))
    shapes = {"embed": (n, d), "far": (attention_lm.SPAN,), "out": (d, attention_lm.CLASSES)} | {k: (d, d) for k in "qkv"}
    p = {k: rnd.normal(0, size, s) for k, s in shapes.items()}
    p["embed"][:, -1], p["embed"][-1], p["v"][:, -1] = 1, 0, 0
    got, want = attention_lm._gradients(p, windows, class_of, n - 1), plain_gradients(p, windows, class_of, n - 1)
    for k, x in want.items():
        assert np.abs(got[k] - x).max() < 1e-9 * max(1, np.abs(x).max()), k


def test_words_go_through_together():
    words = attention_lm.Words(JSON)
    rnd = random.Random(9)
    parts = ["a", "É", "\xa0", "\u3000", "\x1c", "\x85", "'s", "!", "7", "😀", "word", "the"]
    some = ["".join(rnd.choices(parts, k=rnd.randint(1, 6))).encode() for _ in range(3000)] + [b"\xff\xfe", b"a\xe2\x82", b"\xc3", b"b"]
    ids, sizes = words.pieces(some)
    want = words.encode(some)
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    calls = []

    class Coder:
        def encode_ordinary(self, text, own=words.coder):
            calls.append(text)
            return own.encode_ordinary(text)

    words.coder = Coder()
    texts = [f"word{i} and the {i % 7}".encode() for i in range(500)] + [None, b"", b" \n"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["text"])
    ((_, distinct, places, n),) = attention_lm._chunks(iter([batch]))
    ids, sizes = words.of_texts(distinct, places, n)
    assert len(calls) == 1 and n.tolist() == [4] * 500 + [0] * 3 and sizes[500:].tolist() == [1] * 3
    plain = [[i for w in plain_words(t.as_py().decode() if t.as_py() else "") for i in words.encode([w])[0]] + [words.ids] for t in batch["text"]]
    assert ids.tolist() == [i for x in plain for i in x]


def test_windows_are_dealt_by_words_whatever_goes_through_together(monkeypatch):
    monkeypatch.setattr(attention_lm, "CHUNK_WORDS", 100)
    texts = [f"some words of text {i} " * (i % 9) for i in range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array([t.encode() for t in texts[i : i + 25]], pa.binary())], ["text"]) for i in (0, 25, 50)]
    want = list(attention_lm._windows(iter(batches), JSON))
    monkeypatch.setattr(attention_lm, "CHUNK_BYTES", 300)
    got = list(attention_lm._windows(iter(batches), JSON))
    assert len(got) == len(want) and all(np.array_equal(x, y) for x, y in zip(got, want))
    words, dealt, n = attention_lm.Words(JSON), [0], 0
    for i, t in enumerate(texts):
        n += len(t.split()) + 1
        dealt[-1] += -(-(sum(map(len, words.encode(plain_words(t)))) + 1) // attention_lm.STEP)
        if n >= 100 or i in (24, 49):
            dealt, n = [*dealt, 0], 0
    assert [len(x) for x in want] == [k for k in dealt if k]


def test_training_goes_over_documents_that_it_does_not_start_from(spark, make_docs, monkeypatch):
    """The documents that training starts from have words of their own; the others' words follow each other."""
    monkeypatch.setattr(attention_lm, "SAMPLE_DOCS", 8)
    ids = spark.range(400).selectExpr("id", f"pmod(xxhash64(id, 11), {400 // 8}) = 0 AS first").collect()
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("ad", "en", "ing", "or", "us")]
    rows = []
    for i, first in ids:
        rows.append((i, "one two " * 400 if first else " ".join((words * 60)[i % 30 : i % 30 + 900])))
    fitted = attention_lm.fit(make_docs(rows).coalesce(1), JSON)
    assert 0 < sum(r["first"] for r in ids) < 40
    (r,) = attention_lm.score(make_docs([(1000, " ".join(words * 30))]), fitted, JSON).collect()
    start = attention_lm.first_windows(make_docs(rows).selectExpr("doc_id", "cast(text AS binary) AS text"), 400, JSON)
    counts = attention_lm.id_counts(fitted.counts, JSON)
    counts[-1] = 400
    other = dataclasses.replace(fitted, model=attention_lm.train(start, counts))
    (s,) = attention_lm.score(make_docs([(1000, " ".join(words * 30))]), other, JSON).collect()
    assert r["score"] / r["n_tokens"] > s["score"] / s["n_tokens"] + 0.2


def test_changes_of_tasks_are_averaged_by_weight():
    cells = lambda i, w, x: (np.array(i, "<i4").tobytes(), np.array(w, "<f8").tobytes(), np.array(x, "<f4").tobytes())
    ones = np.ones(attention_lm.DIMS)
    tasks = [cells([1, 5], [1, 2], [4 * ones, 1 * ones]), cells([5, 7], [6, 1], [5 * ones, 9 * ones])]
    table = pa.table({"block": [0, 0], "task": [1, 0], **{n: [t[k] for t in tasks] for k, n in enumerate(["ids", "weights", "rows"])}})
    got = attention_lm._averaged(table)
    assert np.frombuffer(got["ids"][0].as_py(), "<i4").tolist() == [1, 5, 7]
    rows = np.frombuffer(got["rows"][0].as_py(), "<f4").reshape(3, -1)
    assert (rows == rows[:, :1]).all() and rows[:, 0].tolist() == [4, 4, 9]


def test_lm_scores_on_hard_rows(hard_docs, no_docs, make_docs):
    rows = [(i, t) for i, t, *_ in HARD]
    got = {}
    for r in attention_lm.lm_scores(hard_docs, JSON).collect():
        got.setdefault(r["doc_id"], []).append(r)
    want = plain_base(rows)
    assert sum(map(len, got.values())) == len(rows)
    for i, held, n, known, total, base in want:
        r = got[i][0]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, abs=1e-6) and math.isfinite(r["score"]) and r["score"] < 0
    assert attention_lm.lm_scores(no_docs, JSON).count() == 0
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = attention_lm.lm_scores(make_docs([(alone, "held out only")]), JSON).collect()
    assert (r["train_tokens"], r["n_known"], r["held_out"]) == (0, 0, True) and r["base_score"] == 0.0


def test_queries_match_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    want = {tuple(r[:3]): tuple(r[3:]) for r in con.sql(interaction_audit.oracle()).fetchall()}
    assert audited(interaction_audit.audit(read(spark, "documents"), read(spark, "labels"))) == want
