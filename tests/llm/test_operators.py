"""Every operator on awkward rows, on an empty table, and against the plain way."""

import math
import sys
import zlib
from collections import Counter
from hashlib import sha256
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from fleetwatt.llm import bpe, components, embeddings, language, licenses, minhash, mixing, queries, repeats, secrets  # noqa: E402
from fleetwatt.llm.text import pieces, shingles, word_hashes  # noqa: E402

OPS = sorted(queries.QUERIES)


def bag(rows):
    return Counter(map(repr, rows))


def docs_of(spark, folder, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select(*columns).collect()]


def got(spark, name, folder, *columns):
    return [tuple(r) for r in queries.QUERIES[name](spark, folder).select(*columns).collect()]


@pytest.mark.parametrize("name", OPS)
def test_empty_table(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


def test_pipeline_on_empty_table(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_embeddings(spark, hard):
    rows = [tuple(r) for r in spark.read.parquet(f"{hard}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert bag(got(spark, "op1_embedding_grid", hard, "vec_id", "n_links", "component_id")) == bag(brute.cosines(rows, 0.9))


def test_embeddings_in_small_blocks(spark, hard, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    monkeypatch.setattr(embeddings, "LEAF", 4)
    test_embeddings(spark, hard)


def test_boxes_skip_distant_leaves():
    x = np.zeros((64, 3))
    y = np.zeros((64, 3))
    x[32:, 0] = 5
    y[:, 0] = 5
    assert list(embeddings.leaf_pairs(x, y - 10, 0.5)) == []
    assert sum((b - a) * (d - c) for a, b, c, d in embeddings.leaf_pairs(x, y, 0.5)) >= 32 * 64


@pytest.mark.parametrize("percent", [85, 80])
def test_minhash(spark, hard, percent):
    rows = docs_of(spark, hard, "doc_id", "text")
    found = minhash.groups(spark.read.parquet(f"{hard}/documents.parquet"), percent).select("id", "n_shingles", "component_id").collect()
    assert bag(tuple(r) for r in found) == bag(brute.near(rows, percent))


def test_minhash_in_small_chunks(spark, hard, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK_SETS", 2)
    test_minhash(spark, hard, 85)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for n, common in ((1, 1), (7, 6), (200, 150), (3000, 2000)):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[:common], rng.integers(0, 1 << 63, n - common, dtype=np.uint64)])
        x, y = (minhash.sketch(np.unique(v), 2000) for v in (a, b))
        assert (x != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        assert abs((x == y).mean() - common / (2 * n - common)) < 0.06


def test_components(spark):
    rows = [(1, 2), (2, 3), (3, 1), (9, 8), (8, 7), (5, 5), (None, 4), *[(i, i + 1) for i in range(100, 160)], *[(200, i) for i in range(201, 240)]]
    found = dict(map(tuple, components.components(spark.createDataFrame(rows, "a bigint, b bigint")).collect()))
    assert {found[i] for i in (1, 2, 3)} == {1} and {found[i] for i in (7, 8, 9)} == {7}
    assert {found[i] for i in range(100, 161)} == {100} and {found[i] for i in range(200, 240)} == {200} and found.get(5, 5) == 5


def test_secrets(spark, hard):
    rows = docs_of(spark, hard, "doc_id", "text")
    want = []
    for i, t in rows:
        s = brute.secrets(t)
        digest = sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest()
        want.append((i, *(sum(x[0] == k for x in s) for k in ("assign", "access", "hex")), digest))
    assert bag(got(spark, "op3_secrets", hard, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")) == bag(want)


def test_base_spans_stay_and_added_ones_are_apart(spark, sf):
    texts = dict(docs_of(spark, sf, "doc_id", "text"))
    for i, spans in got(spark, "op3_secrets", sf, "doc_id", "spans"):
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)]
        base = brute.secrets(texts[i])
        assert [s for s in spans if s[0] != "crf"] == base
        assert all(b <= x or a >= y for k, a, b in spans if k == "crf" for _, x, y in base)


def test_field_prunes_without_loss():
    rng = np.random.default_rng(3)
    field = secrets.Field(rng.normal(0, 2, (secrets.SLOTS, 3)).astype(np.float32), rng.normal(0, 1, (3, 3)))
    slots, doc = rng.integers(0, secrets.SLOTS, (400, 4)).astype(np.int32), np.repeat([0, 1, 2], [150, 1, 249])
    e = field.emissions(slots).astype(float)
    whole = [t for d in range(3) for t in field.viterbi(e[doc == d], False, False)]
    assert list(field.tags(slots, doc)) == whole


def test_field_learns_and_finds_held_out_secrets(spark):
    import random

    rnd = random.Random(4)
    rows = []
    for i in range(300):
        words = [rnd.choice("alpha beta gamma delta house tree".split()) for _ in range(30)]
        if i % 3 == 0:
            words.insert(rnd.randrange(30), f'token = "{rnd.getrandbits(160):040x}"')
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    field = secrets.learn(docs)
    good = 0
    for _ in range(50):
        secret = f"{rnd.getrandbits(160):040x}"
        raw = np.frombuffer(f'alpha beta token = "{secret}" gamma'.encode(), np.uint8)
        b, e, doc, slots = secrets.tokens(raw, np.array([0, len(raw)]))
        tags = field.tags(slots, doc)
        good += [bytes(raw[x:y]).decode() for x, y, t in zip(b, e, tags, strict=True) if t] == [secret]
    assert good >= 45


def test_redaction(spark):
    df = spark.createDataFrame([("a token=abcdefgh b", [("assign", 2, 16), ("hex", 8, 16)]), (None, []), ("é", [])], "t string, s array<struct<kind:string,start:bigint,end:bigint>>")
    assert [r[0] for r in df.select(secrets.redact_column("t", df["s"])).collect()] == ["a [SECRET] b", None, "é"]


@pytest.mark.parametrize("crowd", [2000, 1])
def test_repeats(spark, hard, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rows = docs_of(spark, hard, "doc_id", "text")
    assert bag(got(spark, "op4_repeats", hard, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == bag(brute.repeats(rows))


def test_tokens(spark, hard):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in docs_of(spark, hard, "doc_id", "text"):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert bag(got(spark, "op5_bpe", hard, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) == bag(want)


def test_tokens_of_all_characters_and_odd_runs():
    import random

    rnd = random.Random(2)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder = bpe.Coder(bpe.load(public_tokenizers.path("byte_bpe_50k.json")))
    texts = ["".join(chr(c) for c in range(k, k + 400) if not 0xD800 <= c < 0xE000) for k in range(0, 0x30000, 400)]
    texts += ["".join(rnd.choice(["the", "ing", " ", "ation", "er", "aaaa", "'s", "\n", "zz", "1", "%%", "  "]) for _ in range(50)) for _ in range(300)]
    for t in texts:
        ids = coder.encode(t)
        assert ids == lib.encode(t, add_special_tokens=False).ids
        assert coder.decode(ids) == t


def test_tokens_as_columns(spark):
    automaton = bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    df = spark.createDataFrame([("hello world",), ("",), (None,)], "t string").select("t", bpe.encode_column(spark, automaton, "t").alias("ids"))
    assert [tuple(r) for r in df.select(bpe.decode_column(spark, automaton, "ids")).collect()] == [("hello world",), ("",), ("",)]


@pytest.mark.parametrize("folder", ["hard", "sf"])
def test_lm(spark, request, folder):
    folder = request.getfixturevalue(folder)
    rows = docs_of(spark, folder, "doc_id", "text")
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    c = Counter()
    for (i, t), h in zip(rows, held, strict=True):
        if i is not None and not h:
            c.update([*brute.tokens(t), None])
    n, v = sum(c.values()), len(c)
    want = []
    for (i, t), h in zip(rows, held, strict=True):
        w = [*brute.tokens(t), None]
        want.append((i, h, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4)))
    found = got(spark, "op6_mixture_lm", folder, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    assert bag((*r[:5], round(r[5], 4)) for r in found) == bag(want)
    assert all(math.isfinite(r[6]) and r[6] < 0 for r in found)


def test_lm_gives_probabilities(spark):
    from fleetwatt.llm import mixture_lm

    docs = spark.createDataFrame([(i, "abab cd " * (3 + i % 5)) for i in range(200)], "node bigint, text string")
    mixer = mixture_lm.train(docs)
    context = np.uint64(0x6261622020)
    every = (np.arange(256, dtype=np.uint64)) | (context << np.uint64(8))
    p = 10 ** mixer.log10(every)
    assert abs(p.sum() - 1) < 1e-6 and p[ord("a")] > 0.2


def test_lm_counts_are_exact_and_all_texts_teach(spark):
    import random

    from fleetwatt.llm import mixture_lm

    rnd = random.Random(6)
    texts = ["".join(rnd.choice("abcdefgh \u00e9\U0001f600") for _ in range(5500)) for _ in range(6)]
    model = mixture_lm.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    # texts of more than 5000 characters teach weights and map too
    w, seen, hits = model.mixer.weights, model.mixer.seen, model.mixer.hits
    bodies = [t.encode() + b"\0" for t in texts]
    assert np.abs(w - mixture_lm.START).max() > 0.05
    assert seen.sum() == 4 * seen.size + 8 * sum(map(len, bodies))
    count = Counter()
    for body in bodies:
        body = bytes(5) + body
        for i in range(5, len(body)):
            for o in range(6):
                for k in range(8):
                    count[body[i - o : i], (256 | body[i]) >> (8 - k), body[i] >> (7 - k) & 1] += 1
    asked = [bytes(5) + bodies[0][:1], *(bodies[1][i : i + 6] for i in range(0, 300, 7)), *(bodies[2][i : i + 5] + b"z" for i in range(40)), b"zzzzza", b"zzz ab"]
    want = []
    for a in asked:
        total = 0.0
        for k in range(8):
            node, bit, x, gate = (256 | a[5]) >> (8 - k), a[5] >> (7 - k) & 1, [0.0] * 6, k * 7
            for o in range(6):
                zero, one = (count[a[5 - o : 5], node, b] for b in (0, 1))
                if zero + one:
                    x[o], gate = max(-12, min(12, math.log((one + 0.1) / (zero + 0.1)))), k * 7 + o + 1
            logit = max(-15, min(15, float(np.dot(w[gate], x))))
            step = min(32, max(0, round(logit * 2) + 16))
            p = min(1 - 1e-5, max(1e-5, (1 / (1 + math.exp(-logit)) + hits[node, step] / seen[node, step]) / 2))
            total += math.log10(p if bit else 1 - p)
        want.append(total)
    found = model.log10(np.array([int.from_bytes(a, "big") for a in asked], np.uint64))
    assert np.allclose(found, want, atol=1e-4)


def test_languages(spark, sf):
    truth = dict(docs_of(spark, sf, "doc_id", "lang"))
    held = [(truth[i], p) for i, h, p in got(spark, "op7_language_id", sf, "doc_id", "held_out", "lang_pred") if h]
    assert len(held) > 20 and sum(a == b for a, b in held) >= 0.95 * len(held)


def test_languages_of_hard_rows(spark, hard):
    rows = Counter((i, t) for i, t in docs_of(spark, hard, "doc_id", "text"))
    found = queries.QUERIES["op7_language_id"](spark, hard).collect()
    assert len(found) == sum(rows.values()) and all(0 <= r["score"] <= 1 for r in found)
    und = {r["doc_id"] for r in found if r["lang_pred"] == language.UNKNOWN}
    assert und == {i for i, t in rows if t is None or not any(ch.isalpha() for ch in t)}
    assert {r["lang_pred"] for r in found} <= {"en", "de", language.UNKNOWN}


def test_grams_the_plain_way():
    texts = ["It is 1 word", "", "é--é x", "99"]
    raw = [t.lower().encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    codes, ends = language.grams(data, at)
    for k, body in enumerate(raw):
        words = bytes(b if 97 <= b < 123 or b >= 128 else 32 for b in body).split()
        want = Counter()
        for w in words:
            padded = b" " + w + b" "
            for n in range(1, language.LONGEST + 1):
                want.update(int.from_bytes(padded[i : i + n], "big") for i in range(len(padded) - n + 1) if padded[i : i + n] != b" ")
        assert Counter(codes[(ends[k - 1] if k else 0) : ends[k]].tolist()) == want


def test_mixing_hard_rows(spark, hard):
    rows = docs_of(spark, hard, "doc_id", "text", "source")
    found = queries.QUERIES["op8_mixing"](spark, hard).collect()
    assert bag((r["doc_id"], r["source"], r["n_tokens"]) for r in found) == bag((i, s, len(brute.tokens(t))) for i, t, s in rows)
    assert all(r["copies"] >= 0 for r in found)


@pytest.mark.parametrize("limits", [{"max_repeats": 1.5, "budget_x": None}, {"max_repeats": 1.3}, {"target_entropy": 0.9}, {"target_entropy": 0.99, "max_repeats": 1.2, "budget_x": 0.7}])
def test_mixing_keeps_its_limits(spark, limits):
    sizes = {"a": 300, "b": 60, "c": 20, None: 7}
    rows = [(1000 * k + i, "w " * (1 + i % 7), s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = mixing.mixed(docs, **limits).collect()
    total, taken, part = sum(r["n_tokens"] for r in found), Counter(), Counter()
    for r in found:
        taken[r["source"]] += r["n_tokens"] * r["copies"]
        part[r["source"]] += r["n_tokens"]
    if limits.get("budget_x", 1.0) is None:
        assert all(r["copies"] >= 1 for r in found)
    else:
        assert 0.9 * total * limits.get("budget_x", 1.0) - 30 <= sum(taken.values()) <= total * limits.get("budget_x", 1.0)
    if "max_repeats" in limits:
        assert all(taken[s] <= limits["max_repeats"] * part[s] + 8 for s in part)
    if "target_entropy" in limits and "max_repeats" not in limits:
        w = {r["source"]: r["weight"] for r in found}
        assert -sum(x * math.log(x) for x in w.values()) >= limits["target_entropy"] * math.log(len(w)) - 1e-4
    again = Counter(r["doc_id"] for r in mixing.mixed_rows(docs, **limits).collect())
    assert again == Counter({r["id"]: r["copies"] for r in found if r["copies"]})


def test_quality_hard_rows(spark, hard):
    rows = docs_of(spark, hard, "doc_id", "text")
    want = []
    for i, t in rows:
        t = t or ""
        w = t.encode().split()
        g = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = Counter(g)
        lines = [x for x in t.split("\n") if x.encode().split()]
        again = len({k + j for k, x in enumerate(g) if n[x] > 1 for j in range(5)})
        want.append((i, len(w), sum(len(x.decode()) for x in w), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), again, len(w) < 10 or 100 * again > 20 * len(w)))
    assert bag(got(spark, "op9_quality", hard, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == bag(want)


def test_quality_keeps_clean_documents(spark, sf):
    con = duckdb.connect()
    labels = dict(con.execute(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall())
    found = [(labels[i], kept) for i, failed, kept in got(spark, "op9_quality", sf, "doc_id", "base_failed", "kept") if i in labels and not failed]
    assert all(kept for q, kept in found if q == 1)
    bad = [kept for q, kept in found if q == 0]
    assert sum(bad) <= 0.1 * len(bad)


def test_licenses(spark, hard):
    found = {r["doc_id"]: r for r in queries.QUERIES["op10_licenses"](spark, hard).collect()}
    texts = dict(docs_of(spark, hard, "doc_id", "text"))
    hits = [i for i, r in found.items() if r["n_matches"]]
    assert len(hits) == 1 and found[hits[0]]["best_license"] == "MIT" and found[hits[0]]["best_dice"] == 1.0
    _, a, b = found[hits[0]]["spans"].split(":")
    assert texts[hits[0]][int(a) : int(b)] == "Released under the MIT License"


def test_every_template_finds_itself(spark):
    rows = [(n, f"Élan some words before.\n{t.upper()}\nand words after it") for n, t in licenses.TEMPLATES.items()]
    df = spark.createDataFrame(rows, "n string, t string")
    for r in df.select("n", licenses.license_column(spark, "t").alias("m")).collect():
        assert (r["n"], 1.0) in [(m["license"], m["dice"]) for m in r["m"]]


def test_licenses_the_plain_way():
    rng = np.random.default_rng(8)
    for _ in range(60):
        code = rng.integers(0, 9, 40).astype(np.uint64)
        wanted = np.unique(rng.integers(0, 9, 5).astype(np.uint64))
        best = max(((2 * len(set(code[a:b]) & set(wanted)) / (len(set(code[a:b])) + len(wanted))) for a in range(40) for b in range(a + 1, 41)), default=0)
        found = licenses.best_passages(code, wanted, 0.8)
        assert (max(f[0] for f in found) == best) if best >= 0.8 else not found


def test_license_passages_are_those_of_all_pairs():
    rng = np.random.default_rng(9)
    for kinds in (3, 6, 9, 14) * 60:
        code = rng.integers(0, kinds, 60).astype(np.uint64)
        wanted = np.unique(rng.integers(0, kinds, 6).astype(np.uint64))
        n = len(wanted)
        every = [(2 * len(set(code[a : b + 1]) & set(wanted)) / (len(set(code[a : b + 1])) + n), a, b) for a in range(60) for b in range(a, 60) if {code[a], code[b]} <= set(wanted)]
        want = []
        for f in sorted((f for f in every if f[0] >= 0.8), key=lambda f: (-f[0], f[1], f[2])):
            if all(f[2] < k[1] or f[1] > k[2] for k in want):
                want.append(f)
        assert licenses.best_passages(code, wanted, 0.8) == want


def test_license_notice_repeated_often(spark):
    df = spark.createDataFrame([("Released under the MIT License.\n" * 20_000,)], "t string")
    found = df.select(licenses.license_column(spark, "t").alias("m")).collect()[0]["m"]
    assert len(found) == 20_000 and {(m["license"], m["dice"]) for m in found} == {("MIT", 1.0)}
    assert [(m["begin"], m["end"]) for m in found] == [(32 * k, 32 * k + 30) for k in range(20_000)]


def test_words_and_shingles():
    import pyarrow as pa

    texts = ["A b c D e f", None, "", " one ", "x\x1fy z\x0bq", "a b c d e"]
    for limit in (1, 100):
        n = [0] * len(texts)
        for i, j, data, at in pieces(pa.array(texts, pa.string()), limit):
            h, doc = word_hashes(data, at)
            s, of = shingles(h, doc, j - i, 5)
            for d in of:
                n[i + d] += 1
        assert n == [2, 0, 0, 1, 1, 1]


def test_pipeline_keeps_one_of_each_group(spark, hard):
    docs = spark.read.parquet(f"{hard}/documents.parquet").filter("doc_id is not null and doc_id <> 3 and text is not null")
    rows = list({r["doc_id"]: r["text"] for r in docs.collect()}.items())
    told = dict(corpus_pipeline.STAGES)["language"](spark, docs, hard)
    letters = {i for i, t in rows if any(ch.isalpha() for ch in t)}
    assert {r["doc_id"] for r in told.collect()} == letters and told.columns == docs.columns
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, hard)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _, c in brute.near(rows, 80) if i == c)
    clean = dict(corpus_pipeline.STAGES)["secrets"](spark, docs, hard).collect()
    assert len(clean) == docs.count() and not any(brute.secrets(r["text"]) for r in clean)


def test_pipeline(spark, hard):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "secrets", "mixing", "tokens"]
    out = corpus_pipeline.run(spark, hard)
    assert {"doc_id", "n_tokens", "ids_sha256"} <= set(out.columns) and out.count() > 0
